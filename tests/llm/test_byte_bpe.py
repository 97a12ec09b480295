"""Byte-level BPE against the library that the ranks are for."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F
from whole import table

from contextmill.llm import byte_bpe, pretokens
from contextmill.llm.queries import QUERIES

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    r = random.Random(5)
    some = ["'s", "'S", "'re", "'", "''", " ", "  ", "\n", "\t", " ", " ", "don't", "we'll", "l", "1", "12", "٣", "é", "é", "漢字",
            "\U0001f600", "!", "?!", "-", "the", "Thing", "_", "\x00", "\x85", "ſ", "<|endoftext|>", "\r\n", "²"]
    texts = [None, "", " ", "   a", "a   ", " 's", "x's", "!'s", "''s", "'see", "'s't", "\n's", "  's", "1's", "'lll", "a\n\nb", "a\n b", "a \nb"]
    texts += ["".join(r.choices(some, k=r.randrange(1, 25))) for _ in range(400)]
    texts += ["a" * 5000, " " * 3000 + "x", "ab" * 900 + " " + "".join(r.choices("abcdefgh", k=4000)), "\n" * 500, "é" * 200, "word " * 20_000]
    return texts


def test_pretokens_are_those_of_the_pattern():
    import regex

    classes = pretokens.character_classes()
    texts = [t or "" for t in odd_texts()]
    cut = pretokens.Pretokens(texts, classes, spaced=True)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert [cut.word(j) for j in range(cut.first[i], cut.first[i + 1])] == pattern.findall(t), repr(t)
    everything = [f"a{chr(c)}1 {chr(c)}b  {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(everything), 50_000):
        some = everything[at : at + 50_000]
        cut = pretokens.Pretokens(some, classes, spaced=True)
        assert [cut.word(j) for j in range(len(cut))] == [w for t in some for w in pattern.findall(t)]


def test_long_words_merge_alike():
    r = random.Random(2)
    for n in (1, 2, 3, 50, 2000):
        for letters in ("a", "ab", "etaoin", bytes(range(256)).decode("latin-1")):
            word = "".join(r.choices(letters, k=n)).encode()
            assert byte_bpe.merge_long(word, RANKS) == LIBRARY._encode_single_piece(word)


@pytest.mark.parametrize("memo", [1 << 20, 40, 0])
def test_round_trip(spark, memo):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(4)
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, memo_words=memo), RANKS).collect()
    assert len(out) == len(texts)
    for r in out:
        want = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want), repr(r.text)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    once = byte_bpe.encode(df, RANKS, memo_words=memo, decoded=True)
    assert once.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in once.collect()} == {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out}


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "a b", "l")], "doc_id int, text string, ids string")
    back = byte_bpe.round_trip(df, RANKS)
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    assert byte_bpe.encode(df.filter("false"), RANKS).count() == 0


def test_fold_alone(spark):
    words = ["", "a", " the", "hello", "zxqj", "é漢", " " * 20, "aaaaaaaaaaaaaaaa", "\U0001f600"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", byte_bpe.merged_ids(F.col("w"), RANKS))
    for w, ids in df.collect():
        assert ids == (LIBRARY._encode_single_piece((w or "").encode()) if w else [])


def test_query(spark):
    want = {}
    for i, t in table("documents", "doc_id", "text"):
        ids = LIBRARY.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rows = QUERIES["op8_byte_bpe"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)


def test_words_are_cut_into_bytes_without_patterns(spark):
    """Every byte, also line ends, NUL and parts of longer characters, is a piece of its own to begin with."""
    ranks = {bytes([b]): b for b in range(256)} | {b"\x00\n": 256, "é".encode(): 257, b"\n\r": 258}
    words = ["\x00\n\r\x85", "".join(map(chr, range(256))), "é€😀", "", "a", "\n\r"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    made = df.select("i", byte_bpe.merged_ids(F.col("word"), ranks).alias("ids"))
    assert {r.i: r.ids for r in made.collect()} == {i: byte_bpe.merge_long(w.encode(), ranks) for i, w in enumerate(words)}
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
