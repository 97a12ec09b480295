import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.functions import text as tx
from contextmill.operators import chunking as ch
from contextmill.operators.models import hashed_embedder

TEXTS = [
    "One. Two! Three?\nFour",
    "para one line.\n\npara two.\n\n\npara three",
    "a\r\nb\r\nc. d",
    "x" * 50,
    "w " * 40,
    "Ends with break.\n",
    "é ü ñ. ß.",
    "...",
    "long sentence without any stop " * 8,
    "a. b. c. d. e. f. g. h. i. j.",
]


def docs(spark, texts=TEXTS):
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def by_doc(chunks, column="text", order="chunk_index"):
    out = {}
    for r in chunks.orderBy("doc_id", order).collect():
        out.setdefault(r.doc_id, []).append(r[column])
    return out


def random_texts(n=40, seed=5):
    rng = random.Random(seed)
    ends = [". ", "! ", "\n", "\n\n", " ", " ", "  ", ".", "? \n"]
    words = ["alpha", "be", "gamma", "d", "épsilon", "zeta" * 6]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 120))).strip() for _ in range(n)]


def greedy(sizes, cap):
    out, first, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > first and total + s > cap:
            out.append((first, i - first))
            first, total = i, 0
        total += s
    return [*out, (first, len(sizes) - first)] if sizes else []


def overlapping(sizes, cap, overlap):
    """Greedy runs that begin with as many trailing items as the overlap allows."""
    out, first = [], 0
    while first < len(sizes):
        end, total = first, 0
        while end < len(sizes) and (end == first or total + sizes[end] <= cap):
            total += sizes[end]
            end += 1
        out.append((first, end - first))
        if end == len(sizes):
            break
        start, back = end, 0
        while start - 1 > first and back + sizes[start - 1] <= min(overlap, cap - sizes[end]):
            start -= 1
            back += sizes[start]
        first = start
    return out


def test_pack_against_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        cap = rng.randint(5, 80)
        array = np.array(sizes, dtype=np.int32)
        assert ch.pack_spans(array, cap) == greedy(sizes, cap)
        overlap = rng.randint(0, cap // 2)
        assert ch.pack_spans(array, cap, overlap) == overlapping(sizes, cap, overlap)


def test_sentences_are_lossless(spark):
    texts = TEXTS + random_texts()
    got = by_doc(ch.sentence_rows(docs(spark, texts)), "sentence", "position")
    assert {i: "".join(p) for i, p in got.items()} == dict(enumerate(texts))
    assert got[0] == ["One. ", "Two! ", "Three?\n", "Four"]


@pytest.mark.parametrize("cap", [7, 40, 2048])
def test_recursive_is_lossless_and_within_the_cap(spark, cap):
    texts = TEXTS + random_texts()
    got = by_doc(ch.recursive_chunks(docs(spark, texts), cap))
    assert {i: "".join(p) for i, p in got.items()} == dict(enumerate(texts))
    assert max(len(c) for p in got.values() for c in p) <= cap


def test_recursive_prefers_coarse_cuts(spark):
    got = by_doc(ch.recursive_chunks(docs(spark, ["aaaa bbbb.\n\ncccc dddd. eeee ffff."]), 12))
    assert got[0] == ["aaaa bbbb.\n\n", "cccc dddd. ", "eeee ffff."]


def test_missing_and_empty_texts_give_no_chunks(spark):
    for chunker in ch.CHUNKERS.values():
        assert chunker(docs(spark, [None, "", "a."])).select("doc_id").distinct().count() == 1


@pytest.mark.parametrize("n", [1, 49, 50, 51, 511, 512, 513, 974, 975, 2000])
def test_overlapping_windows(spark, n):
    tokens = [f"t{i}" for i in range(n)]
    got = by_doc(ch.overlapping_chunks(docs(spark, [" ".join(tokens)])))[0]
    want, start = [], 0
    while True:
        want.append(" ".join(tokens[start : start + 512]))
        if start + 512 >= n:
            break
        start += 462
    assert got == want


def test_overlapping_sentences(spark):
    texts = random_texts()
    got = by_doc(ch.overlapping_sentence_chunks(docs(spark, texts), 20, 6))
    for i, text in enumerate(texts):
        pieces = re.findall(r"(?s).+?(?:[.!?]+[ \n\t\r]+|\n+|\Z)", text)
        sizes = [len(re.findall(r"[^ \n\t\r]+", p)) for p in pieces]
        assert got[i] == ["".join(pieces[f : f + k]) for f, k in overlapping(sizes, 20, 6)]


def brute_semantic(pieces, vectors, threshold, cap):
    out = []
    for i, piece in enumerate(pieces):
        cut = i == 0
        if not cut:
            mean = np.mean(vectors[max(0, i - 3) : i], axis=0)
            scale = np.linalg.norm(mean) * np.linalg.norm(vectors[i])
            cut = (round(float(vectors[i] @ mean / scale), 9) if scale else 0.0) < threshold
        if cut or len(out[-1]) + len(piece) > cap:
            out.append("")
        out[-1] += piece
    return out


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_semantic_against_brute_force(spark, setting, batch):
    """Also where sentences of a document fall into several batches of a task."""
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    texts = TEXTS + random_texts()
    given = docs(spark, texts).repartition(3, "doc_id")
    embed = hashed_embedder(16)
    rows = ch.sentence_rows(given).withColumn("v", embed(F.col("sentence")))
    vectors = by_doc(rows, "v", "position")
    pieces = by_doc(rows, "sentence", "position")
    got = by_doc(ch.semantic_chunks(given, embed, 16, 0.6, 60))
    for i in range(len(texts)):
        assert got[i] == brute_semantic(pieces[i], np.array(vectors[i], dtype=float), 0.6, 60), texts[i]


def test_semantic_oversize_sentence_stays_whole(spark):
    got = by_doc(ch.semantic_chunks(docs(spark, ["y" * 700 + ". short."]), threshold=-1.0))
    assert got[0] == ["y" * 700 + ". ", "short."]


def test_same_chunks_for_any_partitioning(spark):
    texts = random_texts()
    for chunker in ch.CHUNKERS.values():
        results = {
            n: sorted(map(tuple, chunker(docs(spark, texts).repartition(n)).collect())) for n in (1, 4, 16)
        }
        assert results[1] == results[4] == results[16]


def test_ids_are_stable_and_unique(spark):
    chunks = ch.chunk_documents(docs(spark), {"recursive": ch.recursive_chunks, "overlap": ch.overlapping_chunks})
    first = {r.chunk_id for r in chunks.collect()}
    again = {r.chunk_id for r in chunks.repartition(5).collect()}
    assert first == again and len(first) == chunks.count()


def test_stats_with_an_empty_group(spark):
    given = docs(spark, ["a b. c.", ""])
    chunks = ch.chunk_documents(given, {"recursive": ch.recursive_chunks})
    stats = {r.source: r for r in ch.chunk_stats(given, chunks, ["source"]).collect()}
    assert (stats["s0"].chunks, stats["s0"].avg_tokens, stats["s0"].max_chars) == (1, 3.0, 7)
    assert (stats["s1"].chunks, stats["s1"].avg_chars, stats["s1"].min_chars) == (0, 0.0, 0)


def test_strip_equals_python(spark):
    cases = ["", " ", " a ", "\x1ca b\x85", "\n\ta\r\n", "b​"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.t for r in rows.select("i", tx.strip(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [c.strip() for c in cases]


@pytest.mark.parametrize("batch", ["1", "2", "10000"])
def test_semantic_cap_in_tokens(spark, setting, batch):
    """A cap in tokens, with chunks that go on over batches and documents that follow each other."""
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = [(1, "s", "a b. a b. a b. a b. a b."), (2, "s", "a b. " * 4), (3, "s", "a b c d e f g.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)
    out = ch.semantic_chunks(docs, cap=4, unit="tokens", threshold=-1.0).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.text.split())) for r in out] == [
        (1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 4), (2, 1, 4), (3, 0, 7)]
    with pytest.raises(ValueError):
        ch.semantic_chunks(docs, unit="words")


def test_split_patterns_give_the_pieces_of_their_definition(spark):
    """Taken possessively, up to the first separator, as the lazy patterns of the SQL do."""
    import random

    from pyspark.sql import functions as F

    from contextmill.functions import text as tx

    lazy = {"PARAGRAPH": r"\n\n+", "LINE": r"\n+", "SENTENCE": r"[.!?]+[ \n\t\r]+|\n+", "WORD": r"[ \n\t\r]+"}
    r = random.Random(1)
    texts = ["".join(r.choice("ab.!?\n\n \t\ré😀.") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["a" * 100_000, "." * 1000, "a. " * 20_000]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for name, end in lazy.items():
        old, new = (tx.split_pieces(F.col("text"), p) for p in (f"(?s).+?(?:{end}|\\z)", getattr(tx, name)))
        assert df.filter(~old.eqNullSafe(new)).count() == 0


def test_words_are_cut_and_hashed_many_at_once():
    """Texts up to U+00FF by their bytes, as the pattern cuts them; numbers of MD5 for words of all lengths, of slices, too."""
    import unicodedata
    from hashlib import md5

    import pyarrow as pa

    from contextmill.operators.models import latin_words, md5_numbers

    r = random.Random(1)
    texts = ["".join(chr(r.randrange(256)) for _ in range(r.randrange(50))) for _ in range(400)] + ["", "a", "\u00c3", "\u00d7"]
    spaced = ["".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower()).split() for t in texts]
    words, counts = latin_words(pa.array(["x y", *texts, "z"]).slice(1, len(texts)))
    assert [w.decode() for w in words.to_pylist()] == [w for t in spaced for w in t] and counts.tolist() == [len(t) for t in spaced]
    assert len(latin_words(pa.array([], pa.string()))[0]) == 0
    some = [bytes(r.randrange(256) for _ in range(n)) for n in range(130)]
    want = [int(md5(w).hexdigest()[:8], 16) for w in some]
    assert md5_numbers(pa.array(some, pa.binary())).tolist() == want
    assert md5_numbers(pa.array(some, pa.binary()).slice(50, 9)).tolist() == want[50:59]


def test_embedder_counts_words_of_any_script(spark):
    from hashlib import md5

    words = {"\u00c4pfel \u00dcber 3\u00b2": ["\u00e4pfel", "\u00fcber", "3\u00b2"], "\u0391\u0392 ab": ["\u03b1\u03b2", "ab"], "\u4e2d\u6587, x": ["\u4e2d\u6587", "x"], "": [], None: []}
    rows = spark.createDataFrame([(t,) for t in words], "t string").coalesce(1)
    for r in rows.select("t", hashed_embedder(8)(F.col("t")).alias("v")).collect():
        want = [0.0] * 8
        for w in words[r.t]:
            want[int(md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        assert r.v == want


def test_starts_of_chunks_between_cuts():
    def plain(cuts, sizes, cap):
        starts, held = [], 0
        for i, (cut, size) in enumerate(zip(cuts, sizes)):
            if not i or cut or held + size > cap:
                starts.append(i)
                held = 0
            held += size
        return starts

    rng = np.random.default_rng(3)
    for n in (1, 2, 40):
        for share in (0.0, 0.2, 1.0):
            for _ in range(60):
                cuts, sizes = rng.random(n) < share, rng.choice([0, 1, 5, 30], n)
                assert ch._starts(cuts, sizes, 10).tolist() == plain(cuts, sizes, 10)
