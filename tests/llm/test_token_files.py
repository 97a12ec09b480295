"""Token files: ids of the library, order, random access, and broken files."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from test_byte_bpe import odd_texts
from tokenizers import Tokenizer
from whole import table

from contextmill.llm import pretokens, token_files
from contextmill.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    with open(PATH, encoding="utf-8") as f:
        own = token_files.WordTokenizer(f.read(), pretokens.character_classes())
    texts = [t or "" for t in odd_texts()] + ["ΑΣ ΣΑΣ", "İi", "Å Å", "͸ x", "a͸", "１２", "’s don’t", "​x"]
    r = random.Random(4)
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x600), r.randrange(0x2000, 0x2100)])) for _ in range(60)) for _ in range(300)]
    for got, text in zip(own.encode(texts), texts):
        assert got.tolist() == library_ids(text), repr(text)
    assert [x.tolist() for x in own.encode(texts[:9])] == [library_ids(t) for t in texts[:9]]


def test_query(spark):
    rows = QUERIES["op2_token_files"](spark, SMALL).collect()
    want, start = set(), 0
    for i, t in sorted(table("documents", "doc_id", "text")):
        ids = np.array([*library_ids(t), 2], "<u4")
        want.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_files(spark, tmp_path):
    docs = [(5, "b"), (5, "a"), (5, "a"), (None, "null id"), (-3, None), (0, ""), (9, "word " * 3000), (7, "x")]
    docs += [(100 + i, f"text number {i}") for i in range(50)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, hash string").repartition(5)
    folder = str(tmp_path / "t")
    manifest = token_files.write_tokens(df, PATH, 2, folder)
    rows = sorted(token_files.read_tokens(folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d[0] for d in docs), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = sorted((str(k), tuple([*library_ids(t), 2])) for k, t in docs)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    # One document of one file, found by its offset.
    name = next(r.file for r in manifest.collect())
    dictionary = next(open(f"{folder}/{x}", "rb").read()[8:] for x in os.listdir(folder) if x.endswith(".zdict"))
    content = open(f"{folder}/{name}", "rb").read()
    file = token_files.TokenFile(content, dictionary)
    key = int(file.keys[-1])
    assert file.find(key) is not None and file.find(10**9) is None
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(content, b"other")
    with pytest.raises(ValueError, match="cut short"):
        token_files.TokenFile(content[:-1], dictionary)
    empty = str(tmp_path / "e")
    assert token_files.read_tokens(empty, token_files.write_tokens(df.filter("false"), PATH, 2, empty)).count() == 0


def test_shared_dictionary_helps_short_documents():
    samples = [np.array(library_ids(t) + [2], "<u2").tobytes() for _, t in table("documents", "doc_id", "text")]
    dictionary = token_files.train_dictionary(samples)
    import zstandard

    with_it = zstandard.ZstdCompressor(**token_files._compression(dictionary))
    short = [s for s in samples if len(s) < 600]
    assert sum(len(with_it.compress(s)) for s in short) < 0.9 * sum(len(zstandard.compress(s)) for s in short)


def test_added_tokens_in_texts_are_those_of_the_unmodified_library(spark, tmp_path):
    unmodified = Tokenizer.from_file(PATH)
    texts = ["a note <|endoftext|> ends", "<|startoftext|>", "x<|endoftext|><|endoftext|>y", "<|ENDOFTEXT|> <| endoftext |>", "plain"]
    texts += [t for t in odd_texts() if t and "<|endoftext|>" in t][:50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folder = str(tmp_path / "t")
    rows = token_files.read_tokens(folder, token_files.write_tokens(df, PATH, 2, folder)).collect()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert got == {i: [*unmodified.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert got[0] == [320, 3246, 49407, 1339, 2]


def test_sample_of_repeated_and_null_ids_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 100)
    with open(PATH, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(token_files.WordTokenizer(f.read(), pretokens.character_classes()))
    for key in [None, *range(12)]:
        docs = spark.createDataFrame([(key, f"text {i}") for i in range(1000)], "doc_id long, text string")
        assert 50 <= len(token_files._sample(docs, held, 2, 2)) <= 150


def test_other_settings_go_to_the_library(spark):
    """A tokenizer that does not split as expected gives its own ids, by whole texts."""
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = json.load(file)
    assert token_files.splits_into_words(json.dumps(model))
    texts = ["Some Words, 123 and it's", "", "ÉTÉ  x"]
    for change in ({"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}, {"pre_tokenizer": model["pre_tokenizer"]["pretokenizers"][1]}):
        own = json.dumps({**model, **change})
        assert not token_files.splits_into_words(own)
        library = Tokenizer.from_str(own)
        got = token_files.WordTokenizer(own, pretokens.character_classes(), added=True).encode(texts)
        assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
