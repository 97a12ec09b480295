"""Benchmark decontamination: a broadcast set of normalised test n-grams, verified hits.

The windows of the benchmark are written and broadcast in blocks of bounded size. One block is one
scan over the documents, which are neither shuffled nor joined. Of several blocks only one is held
at a time: its scan writes the hits, before the next is built, and at the end the documents are
joined with all hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.words import Words, alphanumeric, slices, tidy
from contextmill.session import materialise

#: Words of a window; an item with fewer is one window as a whole.
WINDOW = 10
#: Bytes of benchmark windows in one broadcast.
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20


def benchmark_windows(benchmark: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """Distinct (window, n, hash, item): normalised words joined by a space, and the item's id."""
    item = F.col(key).cast("string").alias("item")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = alphanumeric()
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                hashes, (data, starts, ends) = words.hashes(), words.canonical()
                items, out = part.column("item").to_pylist(), ([], [], [], [])
                for n in {int(min(c, window)) for c in words.counts if c}:
                    found = words.windows(hashes, n)
                    at = words.fits(n)
                    of = words.text_of(at)
                    whole = np.minimum(words.counts[of], window) == n
                    for i, t in zip(at[whole].tolist(), of[whole].tolist()):
                        row = (data[starts[i] : ends[i + n - 1]], n, int(found[i].astype(np.int64)), items[t])
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int32(), pa.int64(), pa.string()))],
                    ["window", "n", "hash", "item"],
                )

    source = benchmark.select(item, F.col(text).alias("text"))
    return source.mapInArrow(tidy(cut), "window binary, n int, hash bigint, item string").distinct()


class WindowSet:
    """Benchmark windows by length and hash, with a small filter in front of the lookup."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for window, n, value, item in rows:
            own = self.items.setdefault(bytes(window), [])
            if item is not None:  # the window counts, but has no id to tell
                own.append(item)
            hashes.setdefault(n, set()).add(value)
        self.hashes = {n: np.sort(np.array(list(v), np.int64).astype(np.uint64)) for n, v in hashes.items()}
        self.filters = {}
        for n, v in self.hashes.items():
            self.filters[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[n][v >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(word, n, items) of each place where a window really stands."""
        canonical = None
        for n, known in self.hashes.items():
            found = words.windows(hashes, n)
            maybe = np.flatnonzero(self.filters[n][found >> np.uint64(64 - _FILTER_BITS)])
            if not len(maybe):
                continue
            spot = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
            maybe = maybe[known[spot] == found[maybe]]
            if not len(maybe):
                continue
            if canonical is None:
                canonical = words.canonical()
            data, starts, ends = canonical
            first = words.first
            of = words.text_of(maybe)
            for i in maybe[maybe + n <= first[of + 1]].tolist():
                items = self.items.get(data[starts[i] : ends[i + n - 1]])
                if items is not None:  # the hash alone decides nothing
                    yield i, n, items


def _count_blocks(windows: DataFrame, block_bytes: int) -> int:
    size = F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 100)
    total = windows.agg(size.alias("bytes")).first()["bytes"] or 0
    return -(-total // block_bytes)


def _blocks(windows: DataFrame, blocks: int) -> Iterator[WindowSet]:
    """The windows in blocks of about the same size, made one by one."""
    for b in range(blocks):
        # The items of a window may be in several blocks: very many may share one.
        own = F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b
        yield WindowSet(windows.filter(own).orderBy("window", "item").collect())


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hits (word ranges, disjoint, in order) and items (distinct ids).

    NULL and empty texts have no words and no hits; items without words have no
    windows; those with a NULL id hit words, but are not told; repeated items and repeated ids of one window count once. Columns of ``docs`` with
    the three new names are replaced. Without benchmark windows nothing is hit. If the windows
    take several blocks, ``docs`` must yield its rows in the same partitions each time, as a written
    table does. A text is read as a whole: one very long text is a slice of its own and takes
    some 30 times its bytes in its task.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(
        *kept,
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    schema, context = out.schema, docs.sparkSession.sparkContext
    windows = materialise(benchmark_windows(benchmark, item, item_text, window), "windows")
    blocks = _count_blocks(windows, block_bytes)
    if blocks <= 1:
        held = context.broadcast(next(_blocks(windows, blocks), WindowSet([])))
        return out.mapInArrow(tidy(_scan(held, text)), schema)
    mark = "__contextmill_row"
    numbered = out.withColumn(mark, F.monotonically_increasing_id())
    narrow = numbered.select(mark, f"`{text}`", "n_words", "hits", "items")
    parts = []
    for each in _blocks(windows, blocks):
        held = context.broadcast(each)
        marked = narrow.mapInArrow(tidy(_scan(held, text)), narrow.schema).filter(F.size("hits") > 0)
        parts.append(materialise(marked.select(mark, F.col("hits").alias("new_hits"), F.col("items").alias("new_items")), "hits"))
        held.destroy()
    found = reduce(DataFrame.union, parts).groupBy(mark).agg(
        F.flatten(F.collect_list("new_hits")).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("new_items"))).alias("__items"))
    joined = numbered.join(found, mark, "left").withColumns(
        {"hits": F.coalesce("__hits", "hits"), "items": F.coalesce("__items", "items")}).select(*[f"`{c}`" for c in schema.names])
    # A scan without windows joins ranges that overlap across blocks and counts the words.
    return joined.mapInArrow(tidy(_scan(context.broadcast(WindowSet([])), text)), schema)


def _scan(held, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = alphanumeric()
        windows: WindowSet = held.value
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for part in slices(batch, text):
                words = splitter.split(part.column(text))
                old_hits, old_items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                starts = [words.first[t] + s["start"] for t, row in enumerate(old_hits) for s in row]
                ends = [words.first[t] + s["end"] for t, row in enumerate(old_hits) for s in row]
                items = [set(x) for x in old_items]
                for i, n, found in windows.hits(words, words.hashes()):
                    starts.append(i)
                    ends.append(i + n)
                    items[int(words.text_of(np.array([i]))[0])].update(found)
                hits: list[list[dict]] = [[] for _ in items]
                if starts:
                    # Ranges of neighbouring texts touch, so a text's end always ends a range.
                    cover = words.covered(np.array(starts), np.array(ends)).astype(np.int8)
                    for t in np.unique(words.text_of(np.array(starts))).tolist():
                        own = cover[words.first[t] : words.first[t + 1]]
                        turns = np.flatnonzero(np.diff(own, prepend=0, append=0)).tolist()
                        hits[t] = [{"start": s, "end": e} for s, e in zip(turns[0::2], turns[1::2])]
                columns = {name: part.column(name) for name in part.schema.names}
                columns["n_words"] = pa.array(words.counts, pa.int64())
                columns["hits"] = pa.array(hits, pa.list_(span))
                columns["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return scan


def n_hit():
    """Words in hit ranges."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options
) -> DataFrame:
    """``docs`` without contamination, in the columns of ``docs``.

    ``remove="documents"`` leaves out documents with any hit; ``"spans"`` keeps every document
    and cuts the hit words, from the first byte of a range's first word to the last of its last.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    columns = [f"`{c}`" for c in docs.columns]
    carried = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in ("n_words", "hits", "items")})
    marked = mark_contamination(carried, benchmark, text, **options)
    if remove == "documents":
        marked = marked.filter(F.size("hits") == 0)
    else:
        schema = marked.schema

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splitter = alphanumeric()
            for batch in batches:
                for part in slices(batch, text):
                    words, hits = splitter.split(part.column(text)), part.column("hits").to_pylist()
                    texts = part.column(text).to_pylist()
                    for t, row in enumerate(hits):
                        if row:
                            raw, base, first = texts[t].encode(), words.begin[t], words.first[t]
                            at, pieces = 0, []
                            for s in row:
                                pieces.append(raw[at : words.starts[first + s["start"]] - base])
                                at = words.ends[first + s["end"] - 1] - base
                            texts[t] = (b"".join(pieces) + raw[at:]).decode()
                    columns = {name: part.column(name) for name in part.schema.names}
                    columns[text] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        marked = marked.mapInArrow(tidy(cut), schema)
    back = marked.drop("n_words", "hits", "items").withColumnsRenamed(
        {f"__own_{c}": c for c in ("n_words", "hits", "items")})
    return back.select(*columns)
