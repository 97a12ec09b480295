"""Chunks of documents that come in parts, equal to those of the whole text.

``parts(doc_id, source, part, text)`` are what ``assemble_parts`` makes: joined by newlines in order and stripped, they
are the document. Parts go to the task of their document, sorted, and text is cut as it comes: what is held is
one piece that is not yet over, the open chunk and one batch, whatever the length of the document. Chunking
is sequential, so one document is one task's work, but never a row of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions import text as tx
from contextmill.operators import chunking
from contextmill.operators.models import Model, hashed_embedder

_BLANK = r"[ \n\t\r]"
#: Where a piece of each level ends, and what at the end of a text may be the beginning of such an end.
_ENDS = {
    "paragraph": (r"\n\n+", r"\n+\Z"),
    "line": (r"\n+", r"\n+\Z"),
    "sentence": (rf"[.!?]+{_BLANK}+|\n+", rf"[.!?]*{_BLANK}*\Z"),
    "word": (rf"{_BLANK}+", rf"{_BLANK}+\Z"),
}


class Stripped:
    """The text of a document without white space around it, as it comes."""

    def __init__(self):
        self.begun, self.held = False, ""

    def feed(self, text: str) -> str:
        if not self.begun:
            text = text.lstrip(tx.STRIP_CHARS)
            self.begun = bool(text)
        text = self.held + text
        body = text.rstrip(tx.STRIP_CHARS)
        self.held = text[len(body) :]
        return body


class Pieces:
    """Pieces of one level: as they are, or, with a level below, cut there if they exceed ``cap``.

    A piece has at least one character before its end, as in the patterns for whole texts.
    """

    def __init__(self, kind: str, cap: int | None = None, below: Pieces | Exactly | None = None):
        end, self.tail = _ENDS[kind][0], re.compile(_ENDS[kind][1])
        self.first, self.later = re.compile(f"(?s).+?(?:{end})"), re.compile(f"(?s).*?(?:{end})")
        self.cap, self.below = cap, below
        self.held, self.spilled = "", False

    def feed(self, text: str, over: bool = False) -> Iterator[str]:
        """The pieces that are complete with ``text``; all that is left if the text is ``over``."""
        self.held += text
        at = 0
        while at < len(self.held):
            found = (self.later if self.spilled else self.first).match(self.held, at)
            if found is None or (found.end() == len(self.held) and not over):
                break
            yield from self._piece(self.held[at : found.end()])
            at = found.end()
        self.held = self.held[at:]
        if over:
            if self.held or self.spilled:
                yield from self._piece(self.held)
            self.held = ""
        elif self.below is not None:
            sure = self.tail.search(self.held)
            body = self.held[: sure.start()] if sure else self.held
            if self.spilled or len(body) > self.cap:
                self.spilled = self.spilled or bool(body)
                self.held = self.held[len(body) :]
                yield from self.below.feed(body)

    def _piece(self, piece: str) -> Iterator[str]:
        if self.spilled or (self.below is not None and len(piece) > self.cap):
            yield from self.below.feed(piece, True)
        else:
            yield piece
        self.spilled = False


class Exactly:
    """Pieces of ``cap`` characters."""

    def __init__(self, cap: int):
        self.cap, self.held = cap, ""

    def feed(self, text: str, over: bool = False) -> Iterator[str]:
        self.held += text
        at = 0
        while len(self.held) - at > self.cap or (over and at < len(self.held)):
            yield self.held[at : at + self.cap]
            at += self.cap
        self.held = self.held[at:]


class Packed:
    """Chunks of pieces as ``pack_spans`` makes them, the open one held."""

    def __init__(self, pieces: Pieces, size: Callable[[str], int], cap: int, overlap: int = 0):
        self.pieces, self.size, self.cap, self.overlap = pieces, size, cap, overlap
        self.held: list[str] = []
        self.sizes: list[int] = []

    def feed(self, text: str, over: bool = False) -> Iterator[str]:
        fresh = list(self.pieces.feed(text, over))
        self.held += fresh
        self.sizes += map(self.size, fresh)
        if not self.held:
            return
        spans = chunking.pack_spans(np.array(self.sizes, np.int64), self.cap, self.overlap)
        left = 0
        for first, n in spans:
            left = first
            if first + n == len(self.held) and not over:
                break  # the next piece may belong to it
            yield "".join(self.held[first : first + n])
        self.held, self.sizes = ([], []) if over else (self.held[left:], self.sizes[left:])


class Windows:
    """Windows of ``size`` white-space tokens that share ``overlap`` with the last."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.token = re.compile(tx.SPACED_TOKEN)
        self.text, self.tokens, self.made = "", [], False

    def feed(self, text: str, over: bool = False) -> Iterator[str]:
        self.text += text
        found = list(self.token.finditer(self.text))
        if found and not over:
            found.pop()  # it may go on
        self.tokens += [m[0] for m in found]
        self.text = self.text[found[-1].end() :] if found else self.text
        while len(self.tokens) > self.size or (over and len(self.tokens) > (self.overlap if self.made else 0)):
            window = "".join(self.tokens[: self.size]).strip(tx.STRIP_CHARS)
            self.made = True
            self.tokens = self.tokens[self.size - self.overlap :]
            if window:
                yield window


def _cut_parts(parts: DataFrame, make: Callable[[], object], index: str, text: str) -> DataFrame:
    """Rows (doc_id, source, index, text) of what ``make`` cuts the documents into."""
    kept = [c for c in ("doc_id", "source") if c in parts.columns]
    out = T.StructType([*(parts.schema[c] for c in kept), T.StructField(index, T.IntegerType()), T.StructField(text, T.StringType())])
    names = out.names
    # One document is one task's; range partitions would cut it.
    ordered = parts.select(*kept, "part", "text").repartition(*kept).sortWithinPartitions(*kept, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stripped, cutter, n = None, None, None, 0

        def rows(keys: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
            columns = [pc.take(keys.column(c), pa.array([0] * len(found))) for c in kept]
            return pa.RecordBatch.from_arrays([*columns, pa.array(range(n, n + len(found)), pa.int32()), pa.array(found, pa.string())], names)

        last = None
        for batch in batches:
            for i, row in enumerate(batch.select([*kept, "text"]).to_pylist()):
                key = tuple(row[c] for c in kept)
                if key != now or cutter is None:
                    if cutter is not None and (found := list(cutter.feed("", True))):
                        yield rows(last, found)
                    now, stripped, cutter, n = key, Stripped(), make(), 0
                    fresh = row["text"] or ""
                else:
                    fresh = "\n" + (row["text"] or "")
                last = batch.slice(i, 1)
                if found := list(cutter.feed(stripped.feed(fresh))):
                    yield rows(last, found)
                    n += len(found)
        if cutter is not None and (found := list(cutter.feed("", True))):
            yield rows(last, found)

    return ordered.mapInArrow(run, out)


def recursive_chunks(parts: DataFrame, cap: int = chunking.RECURSIVE_CHARS) -> DataFrame:
    """``chunking.recursive_chunks`` of the documents whose parts these are."""

    def make() -> Packed:
        level: Pieces | Exactly = Exactly(cap)
        for kind in ("word", "sentence", "line", "paragraph"):
            level = Pieces(kind, cap, level)
        return Packed(level, len, cap)

    return _cut_parts(parts, make, "chunk_index", "text")


def overlapping_chunks(parts: DataFrame, size: int = chunking.WINDOW_TOKENS, overlap: int = chunking.WINDOW_OVERLAP) -> DataFrame:
    """``chunking.overlapping_chunks`` of the documents whose parts these are."""
    return _cut_parts(parts, lambda: Windows(size, overlap), "chunk_index", "text")


def overlapping_sentence_chunks(parts: DataFrame, size: int = chunking.WINDOW_TOKENS, overlap: int = chunking.WINDOW_OVERLAP) -> DataFrame:
    """``chunking.overlapping_sentence_chunks`` of the documents whose parts these are."""

    def make() -> Packed:
        token = re.compile(tx.WHITESPACE_TOKEN)
        return Packed(Pieces("sentence"), lambda s: sum(1 for _ in token.finditer(s)), size, overlap)

    return _cut_parts(parts, make, "chunk_index", "text")


def sentence_rows(parts: DataFrame) -> DataFrame:
    """``chunking.sentence_rows`` of the documents whose parts these are."""
    return _cut_parts(parts, lambda: Pieces("sentence"), "position", "sentence")


def semantic_chunks(parts: DataFrame, embedder: Model | None = None, dim: int = 64, **how) -> DataFrame:
    """``chunking.semantic_chunks`` of the documents whose parts these are."""
    return chunking.pack_sentences(sentence_rows(parts), embedder or hashed_embedder(dim), dim, **how)


def into_parts(docs: DataFrame, lines: int) -> DataFrame:
    """Documents as numbered parts of ``lines`` lines."""
    kept = [c for c in ("doc_id", "source") if c in docs.columns]
    every = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / lines).cast("int"))
    split = docs.withColumn("rows", every)
    part = F.transform(starts, lambda i: F.array_join(F.slice("rows", i * lines + 1, F.lit(lines)), "\n"))
    return split.select(*kept, F.posexplode(part).alias("part", "text"))
