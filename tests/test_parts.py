"""Chunks of documents in parts equal those of the whole texts."""

import random

import pytest

from contextmill.operators import chunking, parts

WHOLE = "doc_id long, source string, text string"
PART = "doc_id long, source string, part long, text string"


def texts(r, n=60):
    odd = ["\n", "\n\n", " ", ".", ". ", "?!", "! ", "a", "word", "\t", "\r\n", "é", "\xa0", "...", "x" * 30, "Sentence one", "?\n", "\n\n\n"]
    made = ["".join(r.choices(odd, k=r.randrange(1, 120))) for _ in range(n)]
    return [*made, "", "\n \n", "a", "\n\na", "a\n\n", "x" * 500, "a " * 400, "no end " * 90 + "\n\n" + "y" * 200, ". . .\n. \n\n!"]


def cut(r, text):
    """The text's parts at random newlines, which go."""
    lines = text.split("\n")
    out, at = [], 0
    while at < len(lines):
        n = r.choice([1, 1, 2, 5])
        out.append("\n".join(lines[at : at + n]))
        at += n
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


CASES = {
    "recursive": (chunking.recursive_chunks, parts.recursive_chunks, {"cap": 40}),
    "recursive, small": (chunking.recursive_chunks, parts.recursive_chunks, {"cap": 7}),
    "tokens": (chunking.overlapping_chunks, parts.overlapping_chunks, {"size": 9, "overlap": 3}),
    "tokens, no overlap": (chunking.overlapping_chunks, parts.overlapping_chunks, {"size": 4, "overlap": 0}),
    "sentences": (chunking.overlapping_sentence_chunks, parts.overlapping_sentence_chunks, {"size": 12, "overlap": 4}),
    "semantic": (chunking.semantic_chunks, parts.semantic_chunks, {"threshold": 0.3, "cap": 60}),
    "semantic by tokens": (chunking.semantic_chunks, parts.semantic_chunks, {"threshold": 0.1, "cap": 9, "unit": "tokens"}),
}


@pytest.mark.parametrize("name", CASES)
def test_equal_at_random_cuts(spark, setting, name):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    whole, by_parts, how = CASES[name]
    r = random.Random(name)
    strip = chunking.tx.STRIP_CHARS
    docs = [(i, f"s{i % 3}", t) for i, t in enumerate(texts(r))]
    pieces = [(i, s, p, x) for i, s, t in docs for p, x in enumerate(cut(r, t))]
    r.shuffle(pieces)
    want = rows(whole(spark.createDataFrame([(i, s, t.strip(strip)) for i, s, t in docs], WHOLE), **how))
    got = by_parts(spark.createDataFrame(pieces, PART).repartition(5), **how)
    assert rows(got) == want and len(want) > 100


def test_sentences_of_parts(spark):
    r = random.Random(5)
    docs = [(i, "s", t) for i, t in enumerate(texts(r))]
    pieces = [(i, s, p, x) for i, s, t in docs for p, x in enumerate(cut(r, t))]
    want = rows(chunking.sentence_rows(spark.createDataFrame([(i, s, t.strip(chunking.tx.STRIP_CHARS)) for i, s, t in docs], WHOLE)))
    assert rows(parts.sentence_rows(spark.createDataFrame(pieces, PART))) == want


def test_null_parts_and_no_parts(spark):
    made = spark.createDataFrame([(1, "s", 0, None), (1, "s", 1, "a"), (2, "s", 0, None)], PART)
    assert rows(parts.recursive_chunks(made)) == [(1, "s", 0, "a")]
    assert rows(parts.semantic_chunks(made.filter("false"))) == []


def test_what_is_held_does_not_grow():
    """A text of one paragraph without an end: memory is bounded by the cap, not by the text."""
    cutter = parts.Pieces("paragraph", 50, parts.Pieces("line", 50, parts.Pieces("sentence", 50, parts.Pieces("word", 50, parts.Exactly(50)))))
    n = 0
    for _ in range(300):
        n += sum(map(len, cutter.feed("word " * 40)))
        level, held = cutter, 0
        while level is not None:
            held += len(level.held)
            level = getattr(level, "below", None)
        assert held < 400
    n += sum(map(len, cutter.feed("", True)))
    assert n == 300 * 200


def test_parts_of_lines(spark):
    docs = spark.createDataFrame([(1, "s", "a\nb\nc\n\nd"), (2, "t", "x")], WHOLE)
    got = {}
    for r in parts.into_parts(docs, 2).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["a\nb", "c\n", "d"], 2: ["x"]}
