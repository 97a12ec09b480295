"""Words of whole Arrow batches as NumPy arrays: spans, hashes, windows of words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are looked at together, few enough for a processor's cache; a longer text
#: is looked at alone, whole.
SLICE_BYTES = 1 << 18

_M, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd number mod 2**64 and their inverses, made as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            made = []
            for base in (self.base, self.inverse):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                made.append(np.multiply.accumulate(row))
            self.up, self.down = made
        return self.up, self.down


class Splitter:
    """Finds the words of texts: runs of bytes that are none of ``breaks``, hashed as 64 bits.

    With ``fold`` letters A-Z count as a-z. UTF-8 bytes above 127 belong to words.
    """

    def __init__(self, breaks: bytes, fold: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(breaks)] = False
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M)) | np.uint64(1)
        self.lower = bytes(b + 32 if fold and 65 <= b <= 90 else b for b in range(256))
        self.value = self.value[list(self.lower)]
        self.bytes, self.words = Powers(_M), Powers(_Q)

    def split(self, texts: pa.Array) -> Words:
        return Words(self, texts)


#: Words of letters and digits, lower-cased: everything else in ASCII breaks them.
def alphanumeric() -> Splitter:
    return Splitter(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True)


#: Words between ASCII white space, unchanged.
def blank_separated() -> Splitter:
    return Splitter(b" \t\n\v\f\r", fold=False)


class Words:
    """The words of a few texts: ``starts``/``ends`` in ``data``, ``first`` word of each text."""

    def __init__(self, splitter: Splitter, texts: pa.Array):
        self.splitter = splitter
        blobs = pc.fill_null(texts, "").cast(pa.binary())
        lengths = np.asarray(pc.binary_length(blobs), np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(blobs)], blobs), b" ")[0]
        self.data = np.frombuffer(joined.as_buffer(), np.uint8)
        self.inside = splitter.inside[self.data]
        edges = np.flatnonzero(np.diff(self.inside, prepend=False, append=False))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))  # where each text begins
        self.first = np.searchsorted(self.starts, self.begin)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        values = self.splitter.value[self.data[self.inside]]
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        up, down = self.splitter.bytes.to(len(values))
        sums = np.add.reduceat(values * up[: len(values)], at[:-1])
        return mix(sums * down[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash for the ``size`` words from each word on; those past the end are missing."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.splitter.words.to(len(hashes))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
        return mix((sums[size:] - sums[:-size]) * down[:n])

    def fits(self, size: int) -> np.ndarray:
        """Positions of words whose text has ``size`` words from there on."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.counts)[:n]
        return np.flatnonzero(np.arange(n) + size <= last)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The number of the text that each of these words is in."""
        return np.searchsorted(self.first, words, "right") - 1

    def canonical(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where they begin and end there."""
        keep = self.inside.copy()
        keep[self.ends[self.ends < len(keep)]] = True
        data = np.where(self.inside, self.data, 32)[keep].astype(np.uint8)
        lengths = self.ends - self.starts
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(lengths)]
        return data.tobytes().translate(self.splitter.lower), starts, starts + lengths

    def covered(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words lie in any of the word ranges [start, end)."""
        steps = np.zeros(len(self) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, ends, -1)
        return np.cumsum(steps)[:-1] > 0

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked words each text has."""
        sums = np.concatenate(([0], np.cumsum(marks)))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``size`` bytes of text, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task``, giving memory back after each batch: its worker lives on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from task(each())
        give_back()

    return run


#: Rows of an Arrow batch, where the session has left Spark's own 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Spark send ``BATCH_ROWS`` rows of text at a time to Python, unless the session's owner chose a number."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def commonest(counted: DataFrame, key: str, most: int, least: int = 1) -> DataFrame:
    """About ``most`` rows of (key, n, ...), those of largest ``n``, and at most that many but for chance.

    Counts are compared by their logarithms in sixteenths, so the driver gets some hundred rows whatever the
    corpus; of the last such step a share is taken by a hash of the key. ``n`` is at least ``least``.
    """
    counted = counted.filter(F.col("n") >= least)
    step = F.floor(F.log2("n") * 16)
    left, last, share = most, None, 0.0
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        last, share = r.step, min(1.0, left / r["count"])
        left -= r["count"]
        if left <= 0:
            break
    if last is None:
        return counted
    draw = F.pmod(F.xxhash64(F.lit("common"), key), F.lit(1 << 30))
    return counted.filter((step > last) | ((step == last) & (draw < int(0.99 * share * (1 << 30)) if share < 1 else step == last)))
