"""Splitting documents into chunks.

Every chunker maps ``(doc_id, source, text)`` to ``(doc_id, source, chunk_index,
text)`` and none of them shuffles: a document is one row, and its chunks are made
in the task that reads it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions import text as tx
from contextmill.functions.vectors import matrix, norms, row_cosine
from contextmill.operators.models import Model, hashed_embedder
from contextmill.session import bounded_batches

# Overlapping windows, semantic threshold, window and size.
WINDOW_TOKENS = 512
WINDOW_OVERLAP = 50
SEMANTIC_THRESHOLD = 0.8
SEMANTIC_WINDOW = 3
SEMANTIC_CHARS = 500
RECURSIVE_CHARS = 2048

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def pack_spans(sizes: np.ndarray, cap: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Greedy runs (first, count) of neighbours whose sizes stay within the cap.

    An item above the cap stands alone. With ``overlap`` a run starts with the
    trailing items of the run before it, as far as they fit the overlap and leave
    room for the next item.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    spans, first = [], 0
    while first < len(sizes):
        end = max(int(np.searchsorted(total, total[first] + cap, side="right")) - 1, first + 1)
        spans.append((first, end - first))
        if end == len(sizes):
            break
        room = min(overlap, cap - int(sizes[end]))
        back = int(np.searchsorted(total, total[end] - room, side="left")) if room > 0 else end
        first = max(back, first + 1)
    return spans


def _pack(sizes: Column, cap: int, overlap: int = 0) -> Column:
    """``pack_spans`` per row; only the integer sizes go to Python."""

    @F.arrow_udf(SPANS)
    def spans(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(rows.value_lengths()))
        packed = [pack_spans(r, cap, overlap) for r in np.split(flat, ends[:-1])]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int32)
        pairs = np.array([pair for p in packed for pair in p], dtype=np.int32).reshape(-1, 2)
        entries = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "n"])
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return spans(sizes)


def _explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    kept = [c for c in docs.columns if c in ("doc_id", "source")]
    return docs.select(*kept, F.posexplode(chunks).alias("chunk_index", "text"))


def _spans_to_chunks(docs: DataFrame, pieces: Column, size: Callable[[Column], Column],
                     cap: int, overlap: int = 0) -> DataFrame:
    """Chunks from pieces of the text, greedily packed up to ``cap``."""
    split = docs.filter(F.length("text") > 0).withColumn("pieces", pieces)
    packed = split.withColumn("spans", _pack(F.transform("pieces", size), cap, overlap))
    joined = F.transform(
        "spans", lambda s: F.array_join(F.slice("pieces", s["first"] + 1, s["n"]), "")
    )
    return _explode_chunks(packed, joined)


def _split_long(pieces: Column, pattern: str, cap: int) -> Column:
    def split(piece: Column) -> Column:
        return F.when(F.length(piece) <= cap, F.array(piece)).otherwise(tx.split_pieces(piece, pattern))

    return F.flatten(F.transform(pieces, split))


def recursive_pieces(text: Column, cap: int = RECURSIVE_CHARS) -> Column:
    """Pieces of at most ``cap`` characters, cut at the coarsest level that works:
    blank line, line, sentence, whitespace, character."""
    pieces = F.array(text)
    for pattern in (tx.PARAGRAPH, tx.LINE, tx.SENTENCE, tx.WORD, f"(?s).{{1,{cap}}}"):
        pieces = _split_long(pieces, pattern, cap)
    return F.filter(pieces, lambda p: F.length(p) > 0)


def recursive_chunks(docs: DataFrame, cap: int = RECURSIVE_CHARS) -> DataFrame:
    """Hierarchical splitting, then neighbouring pieces packed up to ``cap`` characters."""
    return _spans_to_chunks(docs, recursive_pieces(F.col("text"), cap), F.length, cap)


def overlapping_chunks(docs: DataFrame, size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Windows of ``size`` whitespace tokens, each sharing ``overlap`` with the last."""
    step = size - overlap
    tokens = docs.withColumn("tokens", tx.split_pieces(F.col("text"), tx.SPACED_TOKEN))
    fresh = F.greatest(F.size("tokens") - overlap - 1, F.lit(0))
    last = F.floor(fresh / step).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: tx.strip(F.array_join(F.slice("tokens", i * step + 1, F.lit(size)), "")),
    )
    # Filtering the windows, not the tokens, keeps the split out of the scan's filter.
    return _explode_chunks(tokens, windows).filter(F.length("text") > 0)


def overlapping_sentence_chunks(docs: DataFrame, size: int = WINDOW_TOKENS,
                                overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Overlapping windows that only cut between sentences."""
    return _spans_to_chunks(docs, tx.sentences(F.col("text")), tx.token_count, size, overlap)


def sentence_rows(docs: DataFrame) -> DataFrame:
    """One row per sentence, in text order."""
    kept = [c for c in docs.columns if c in ("doc_id", "source")]
    return docs.select(*kept, F.posexplode(tx.sentences(F.col("text"))).alias("position", "sentence"))


def trailing_similarity(rows: np.ndarray, groups: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each row with the mean of up to ``window`` rows before it in its group.

    ``groups`` numbers the groups of the ordered rows. Returns the similarities and
    a mask of the rows that have a predecessor.
    """
    wide = rows.astype(np.float64)
    before = np.zeros_like(wide)
    for back in range(1, window + 1):
        same = groups[back:] == groups[:-back]
        before[back:][same] += wide[:-back][same]
    has = np.zeros(len(rows), dtype=bool)
    has[1:] = groups[1:] == groups[:-1]
    # The sum points the same way as the mean, and cosine ignores length.
    return row_cosine(wide, before), has


def _sizes(sentences: pa.Array, unit: str) -> np.ndarray:
    count = pc.utf8_length(sentences) if unit == "chars" else pc.count_substring_regex(sentences, tx.WHITESPACE_TOKEN)
    return count.to_numpy().astype(np.int64)


def _starts(cuts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """Where chunks begin: at each cut, and where a chunk would exceed the cap."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    opens = np.flatnonzero(cuts | (np.arange(len(cuts)) == 0))
    ends = np.append(opens[1:], len(cuts))
    long = np.flatnonzero(total[ends] - total[opens] > cap)
    # What fits from one cut to the next is a chunk; the others are packed one by one.
    more = []
    for at, end in zip(opens[long].tolist(), ends[long].tolist()):
        sums = total[at : end + 1].tolist()
        first = at
        while True:
            first = max(at + bisect_right(sums, sums[first - at] + cap) - 1, first + 1)
            if first >= end:
                break
            more.append(first)
    return np.sort(np.concatenate((opens, np.array(more, opens.dtype)))) if more else opens


def _semantic_pack(dim: int, threshold: float, cap: int, window: int, unit: str, schema: pa.Schema):
    """Chunks out of the ordered sentences of whole documents.

    Works over the batches of one task with the open chunk and the last vectors carried over, so
    memory does not grow with the document. Columns: document columns, position,
    sentence, vector.
    """
    n_keys = len(schema) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: np.ndarray | None = None
        open_rows: pa.Table | None = None
        open_sizes, last, index = np.zeros(0, np.int64), -1, 0

        def chunks(rows: pa.Table, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.append(starts, rows.num_rows), pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, rows.column(n_keys + 1).combine_chunks()), "")
            keys = [rows.column(i).combine_chunks().take(pa.array(starts)) for i in range(n_keys)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), texts], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            position = batch.column(n_keys).to_numpy()
            if ((position != 0) & (position != np.concatenate(([last], position[:-1])) + 1)).any():
                raise ValueError("sentences of a document are not in order")
            last = position[-1]
            vectors = matrix(batch.column(n_keys + 2), dim)
            group = np.cumsum(position == 0)
            held = 0 if tail is None else len(tail)
            stacked = vectors if not held else np.concatenate([tail, vectors])
            groups = np.concatenate([np.zeros(held, dtype=group.dtype), group])
            sims, has = (x[held:] for x in trailing_similarity(stacked, groups, window))
            tail = stacked[groups == groups[-1]][-window:]

            rows = pa.Table.from_batches([batch]).select(range(n_keys + 2))
            cuts, sizes = ~has | (sims < threshold), _sizes(batch.column(n_keys + 1), unit)
            if open_rows is not None:
                rows = pa.concat_tables([open_rows, rows])
                cuts = np.concatenate((np.arange(len(open_sizes)) == 0, cuts))
                sizes = np.concatenate((open_sizes, sizes))
            starts = _starts(cuts, sizes, cap)
            place = np.arange(len(starts))
            opening = rows.column(n_keys).to_numpy()[starts] == 0
            first = np.maximum.accumulate(np.where(opening, place, -1))
            numbers = np.where(first < 0, place + index, place - first)
            if len(starts) > 1:
                yield chunks(rows.slice(0, starts[-1]), starts[:-1], numbers[:-1])
            open_rows, open_sizes, index = rows.slice(starts[-1]), sizes[starts[-1] :], int(numbers[-1])
        if open_rows is not None:
            yield chunks(open_rows, np.array([0]), np.array([index]))

    return run


def semantic_chunks(
    docs: DataFrame,
    embedder: Model | None = None,
    dim: int = 64,
    threshold: float = SEMANTIC_THRESHOLD,
    cap: int = SEMANTIC_CHARS,
    window: int = SEMANTIC_WINDOW,
    unit: str = "chars",
) -> DataFrame:
    """Neighbouring sentences of like meaning, up to ``cap`` characters or, by ``unit``, tokens.

    A sentence starts a new chunk where its similarity to the sentences before it
    is under the threshold or the chunk would exceed the cap; a longer sentence
    stays whole. Sentence vectors never leave the task that made them.
    """
    embed = embedder or hashed_embedder(dim)
    return pack_sentences(sentence_rows(docs), embed, dim, threshold, cap, window, unit)


def pack_sentences(
    rows: DataFrame, embed: Model, dim: int, threshold: float = SEMANTIC_THRESHOLD, cap: int = SEMANTIC_CHARS,
    window: int = SEMANTIC_WINDOW, unit: str = "chars",
) -> DataFrame:
    """Chunks of ``(doc_id, source, position, sentence)``, each document's rows together and in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if unit not in ("chars", "tokens"):
        raise ValueError("a chunk is measured in chars or tokens")
    rows = rows.withColumn("vector", embed(F.col("sentence")))
    kept = [c for c in rows.columns if c in ("doc_id", "source")]
    rows = rows.select(*kept, "position", "sentence", "vector")
    out = T.StructType(
        [rows.schema[c] for c in kept]
        + [T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())]
    )
    return rows.mapInArrow(_semantic_pack(dim, threshold, cap, window, unit, to_arrow_schema(out)), out)


CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "recursive": recursive_chunks,
    "semantic": semantic_chunks,
    "overlap": overlapping_chunks,
    "overlap_sentences": overlapping_sentence_chunks,
}


def chunk_documents(docs: DataFrame, chunkers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every document through every chunker, labelled, with stable ids and sizes."""
    bounded_batches(docs.sparkSession)
    out = None
    for label, chunker in chunkers.items():
        part = chunker(docs).withColumn("chunker", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return describe(out)


def describe(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        chunk_id().alias("chunk_id"),
        "doc_id",
        "source",
        "chunker",
        "chunk_index",
        "text",
        F.length("text").alias("n_chars"),
        tx.token_count(F.col("text")).alias("n_tokens"),
    )


def chunk_id() -> Column:
    """The same id for the same chunk on every run and retry."""
    parts = ("source", "doc_id", "chunker", "chunk_index")
    return F.sha2(F.concat_ws("\u0001", *[F.col(p).cast("string") for p in parts]), 256)


def chunk_stats(docs: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of documents: chunk count and sizes, zero where there are none.

    ``keys`` are columns of both tables, such as source.
    """
    sizes = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg("n_chars").alias("avg_chars"),
        F.avg("n_tokens").alias("avg_tokens"),
        F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"),
    )
    groups = docs.select(*keys).distinct()
    return groups.join(sizes, keys, "left").fillna(
        0, ["chunks", "avg_chars", "avg_tokens", "min_chars", "max_chars"]
    )
