"""Substring deduplication with a count-min prefilter over windows of words.

First pass: each task sketches its windows, and the sketches are merged. A sketch never counts
too little, so windows it estimates as single are single. Second pass: the windows estimated
as repeated, and only they, are grouped exactly. Last, their words are removed.

A window is counted by its minimiser, the smallest hash of any 25 consecutive words in it:
equal windows have equal minimisers, so the estimate still is an upper bound, and neighbouring
windows mostly share one, which makes about one sketch entry for thirteen words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.words import Words, blank_separated, mix, slices, tidy
from contextmill.session import materialise

WINDOW, SEED_WORDS = 50, 25
#: Cells of each of the sketch's rows: the merged sketch takes DEPTH * 2**WIDTH_BITS / 8 bytes
#: (16 MB), which is what is broadcast at any input size. A fuller sketch lets more windows
#: into the exact pass and loses none.
WIDTH_BITS, DEPTH = 26, 2
_BLOCK_BITS = 18
#: Entries after which a task hands on its sketch and begins another.
_FLUSH = 4_000_000
_SALTS = 64


def minimisers(words: Words, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of windows, minimiser of each)."""
    at = words.fits(window)
    low = words.windows(hashes, seed)
    done, span = 1, window - seed + 1
    while done < span:  # the least of ``done`` neighbours, doubled until it spans the window
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return at, low[at]


def cells(values: np.ndarray, depth: int, width_bits: int) -> np.ndarray:
    seed = np.uint64((0xA0761D6478BD642F * (2 * depth + 1)) % (1 << 64))
    return (mix(values ^ seed) >> np.uint64(64 - width_bits)).astype(np.int64)


def _sketch(values: np.ndarray, width_bits: int, block_bits: int) -> Iterator[dict]:
    """Two bits a cell, one for "counted" and one for "counted twice", block by block."""
    pack = zstandard.ZstdCompressor(level=1)
    for depth in range(DEPTH):
        cell, n = np.unique(cells(values, depth, width_bits), return_counts=True)
        blocks, begin = np.unique(cell >> block_bits, return_index=True)
        for block, a, b in zip(blocks.tolist(), begin.tolist(), [*begin[1:].tolist(), len(cell)]):
            low, more = cell[a:b] & ((1 << block_bits) - 1), n[a:b] > 1
            once, twice = np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)
            once[low] = True
            twice[low[more]] = True
            yield {"depth": depth, "block": block, "once": pack.compress(np.packbits(once)), "twice": pack.compress(np.packbits(twice))}


def _merged(table: pa.Table) -> tuple[bytes, bytes]:
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    once = twice = None
    for a, b in zip(table.column("once"), table.column("twice")):
        a = np.frombuffer(unpack.decompress(a.as_py()), np.uint8)
        b = np.frombuffer(unpack.decompress(b.as_py()), np.uint8)
        twice = b if twice is None else twice | b | (once & a)
        once = a if once is None else once | a
    return pack.compress(once.tobytes()), pack.compress(twice.tobytes())


def repeated_cells(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, width_bits: int = WIDTH_BITS
) -> list[np.ndarray]:
    """Per row of the sketch, a bitmap of the cells that count two or more."""
    block_bits = min(_BLOCK_BITS, width_bits)
    fields = [("depth", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]
    kind = "depth int, block int, once binary, twice binary"

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=pa.schema(fields))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held, n = blank_separated(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                at, low = minimisers(words, words.hashes(), window, seed)
                if len(at):
                    # Once a document: a run of windows with one minimiser, and its returns.
                    of = words.text_of(at)
                    fresh = np.flatnonzero((np.diff(low, prepend=~low[:1]) != 0) | (np.diff(of, prepend=-1) != 0))
                    low, of = low[fresh], of[fresh]
                    order = np.lexsort((low, of))
                    low, of = low[order], of[order]
                    low = low[(np.diff(low, prepend=~low[:1]) != 0) | (np.diff(of, prepend=-1) != 0)]
                    held.append(low)
                    n += len(low)
                if n > _FLUSH:
                    yield rows(list(_sketch(np.concatenate(held), width_bits, block_bits)))
                    held, n = [], 0
        if n:
            yield rows(list(_sketch(np.concatenate(held), width_bits, block_bits)))

    def merge(table: pa.Table) -> pa.Table:
        once, twice = _merged(table)
        first = {"depth": table.column("depth")[0].as_py(), "block": table.column("block")[0].as_py()}
        return pa.Table.from_pylist([{**first, "once": once, "twice": twice}], schema=pa.schema(fields))

    parts = docs.select("text").mapInArrow(tidy(count), kind)
    # In two steps, so that a group holds few sketches however many tasks there are.
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    merged = salted.groupBy("depth", "block", "salt").applyInArrow(merge, kind)
    final = merged.groupBy("depth", "block").applyInArrow(merge, kind).select("depth", "block", "twice")
    out = [np.zeros(max(1, (1 << width_bits) // 8), np.uint8) for _ in range(DEPTH)]
    unpack, size = zstandard.ZstdDecompressor(), (1 << block_bits) // 8
    for depth, block, twice in final.toLocalIterator():
        out[depth][block * size : (block + 1) * size] = np.frombuffer(unpack.decompress(bytes(twice)), np.uint8)
    return out


def _estimated_repeated(low: np.ndarray, bitmaps: list[np.ndarray], width_bits: int) -> np.ndarray:
    keep = np.ones(len(low), bool)
    for depth, bits in enumerate(bitmaps):
        cell = cells(low, depth, width_bits)
        keep &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return keep


def _digests(words: Words, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """A 128-bit digest of the words from ``first`` to ``last`` each, joined by single spaces."""
    data, starts, ends = words.canonical()
    spans = zip(starts[first].tolist(), ends[last].tolist())
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans]


def _rows(part: pa.RecordBatch, words: Words, digests: list[bytes], at: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    of = words.text_of(at)
    columns = {
        "digest": pa.array(digests, pa.binary()),
        "doc_id": part.column("doc_id").take(pa.array(of)),
        "text_hash": part.column("text_hash").take(pa.array(of)),
        "start": pa.array(at - words.first[of], pa.int32()),
        **more,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _first_seen(found: DataFrame) -> DataFrame:
    """``found`` with ``first``: the least doc_id with the same digest, NULL if it is the only one."""
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return found.join(firsts.filter("first < last").drop("last"), "digest", "left")


def repeated_ranges(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, width_bits: int = WIDTH_BITS
) -> DataFrame:
    """(doc_id, text_hash, ranges): word ranges of windows that start in a smaller doc_id, too.

    ``docs`` has doc_id, text, text_hash. Windows estimated as repeated are grouped in two steps,
    by digests of all their words. First runs of windows that share a minimiser: a run that is in
    a smaller document goes as a whole. Then the single windows of each distinct run, in the
    first document that has it, which is all that copies of a run could add.
    """
    bitmaps = repeated_cells(docs, window, seed, width_bits)
    held = docs.sparkSession.sparkContext.broadcast(bitmaps)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = blank_separated()
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                at, low = minimisers(words, words.hashes(), window, seed)
                if len(at):
                    keep = _estimated_repeated(low, held.value, width_bits)
                    at, low = at[keep], low[keep]
                if not len(at):
                    continue
                of = words.text_of(at)
                fresh = (np.diff(at, prepend=-2) != 1) | (np.diff(low, prepend=~low[:1]) != 0) | (np.diff(of, prepend=-1) != 0)
                begin = np.flatnonzero(fresh)
                n = np.diff(np.append(begin, len(at)))
                at = at[begin]
                yield _rows(part, words, _digests(words, at, at + n + window - 2), at, n=pa.array(n, pa.int32()))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = blank_separated()
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                lists = part.column("own")
                count = np.asarray(pc.list_value_length(lists), np.int64)
                flat = lists.flatten()
                at = np.asarray(flat.field("start"), np.int64) + np.repeat(words.first[:-1], count)
                n = np.asarray(flat.field("n"), np.int64)
                at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(at):
                    yield _rows(part, words, _digests(words, at, at + window - 1), at)

    kind = f"digest binary, doc_id {id_type}, text_hash bigint, start int"
    source = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_hash", "text")
    found = _first_seen(materialise(source.mapInArrow(tidy(runs), f"{kind}, n int"), "runs"))
    placed = materialise(
        found.select("doc_id", "text_hash", "start", "n", F.coalesce(F.col("first") == F.col("doc_id"), F.lit(True)).alias("own")), "placed")
    own = placed.filter("own").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("own"))
    windows = materialise(source.join(own, ["doc_id", "text_hash"]).mapInArrow(tidy(singles), kind), "windows")
    later = _first_seen(windows).filter("first < doc_id")
    span = lambda n: F.struct("start", (F.col("start") + n).cast("int").alias("end"))
    gone = placed.filter("not own").select("doc_id", "text_hash", span(F.col("n") + window - 1).alias("range"))
    gone = gone.union(later.select("doc_id", "text_hash", span(F.lit(window)).alias("range")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("range").alias("ranges"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
    seed: int = SEED_WORDS, width_bits: int = WIDTH_BITS,
) -> DataFrame:
    """One row per document row: doc_id, kept (words joined by one space), n_words, n_removed.

    Words are runs of anything but ASCII white space. NULL and empty texts have no words; texts
    shorter than a window lose none. Rows that repeat a doc_id are one document for "smaller".
    A NULL doc_id is neither smaller nor larger than another. Other columns are not read. A text is read
    as a whole: one very long text is a slice of its own and takes some 30 times its bytes in its task.
    """
    if not 0 < seed <= window:
        raise ValueError("a minimiser's words lie within a window")
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    marks = repeated_ranges(hashed, window, seed, width_bits)
    joined = hashed.join(marks, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = blank_separated()
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                lists = part.column("ranges")
                base = np.repeat(words.first[:-1], np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
                flat = lists.flatten()
                at, to = (np.asarray(flat.field(x), np.int64) + base for x in ("start", "end"))
                gone = words.covered(at, to)
                data, starts, ends = words.canonical()
                removed, kept = words.per_text(gone), []
                for t in range(part.num_rows):
                    a, b = words.first[t], words.first[t + 1]
                    if a == b:
                        kept.append("")
                    elif not removed[t]:
                        kept.append(data[starts[a] : ends[b - 1]].decode())
                    else:
                        left = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join(data[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.string()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())],
                    ["doc_id", "kept", "n_words", "n_removed"],
                )

    return joined.mapInArrow(
        tidy(cut), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, kept string, n_words bigint, n_removed bigint"
    )
