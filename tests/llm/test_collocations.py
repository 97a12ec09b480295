"""Collocations against counting every phrase, with and without extended prefixes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from oracle_check import compare, connect
from pyspark.sql import functions as F
from whole import table

from contextmill.llm import collocations
from contextmill.llm.queries import ORACLE, QUERIES

NAME = "op12_phrase_collocations"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found, longer = [], Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for inner in (p[:2], p[1:]):
                    longer[inner] = max(longer[inner], a)
        for p, a in f.items():
            if len(p) == 1 or a < least or (len(p) == 2 and 100 * longer[p] >= 50 * a):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def some_docs():
    r = random.Random(4)
    words = ["the", "of", "a", "New", "york", "é", "ß", "x-y", "ÉTÉ", "\x85", "\xa0", "z"]
    docs = [(" ".join(r.choices(words, [9, 5, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1], k=r.randrange(30))) + r.choice(["", ".", "! a", "\n of"]), r.choice(["en", "de", None, "und"]))
            for _ in range(250)]
    docs += [("the one and only passage of words", "en")] * 300 + [("a a a a a a", "en")] * 20
    docs += [(None, "en"), ("", None), (" \t ", "fr"), (".,;:!?\n\v\f\r", "fr"), ("one\ttwo  one\ttwo " * 20_000, "es"), ("z" * 100_000, "es")]
    return docs


@pytest.mark.parametrize("budget", [1 << 21, 400, 9])
def test_any_partition_gives_the_same(spark, monkeypatch, budget):
    monkeypatch.setattr(collocations, "CODES", 4 if budget == 9 else 1 << 16)
    if budget == 400:
        monkeypatch.setattr(collocations, "_MOST", 50)
        monkeypatch.setattr(collocations, "_HELD", 120)
    docs = some_docs() if budget != 400 else [d for d in some_docs() if len(d[0] or "") < 1000]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, a int, one int").repartition(6)
    assert rows(collocations.collocations(df, budget=budget)) == brute(docs)
    assert rows(collocations.collocations(df, budget=budget, top=3)) == brute(docs, top=3)


def test_no_rows(spark):
    df = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.filter("false")).count() == 0


def test_shared_keys_are_found(spark):
    """A seed under which two words share a key is left for the next one."""
    seen = []

    def make_words(held, turn):
        seen.append(turn)
        words = collocations.word_table(held, turn)
        return words.withColumn("clash", F.lit(True)) if turn == 0 else words

    docs = [("b c. d", "en")] * 12
    df = spark.createDataFrame(docs, "text string, lang string")
    assert rows(collocations.collocations(df, make_words=make_words)) == brute(docs) and seen == [0, 1]


def test_a_shared_key_is_a_clash(spark, monkeypatch):
    monkeypatch.setattr("contextmill.llm.words.Words.hashes", lambda self: np.full(len(self), 7, np.uint64))
    text = collocations.Text(collocations.Splitter(b" ", fold=True), ["en"], pa.array(["a b"]), 0)
    assert text.keys[0] == text.keys[1]
    words = spark.createDataFrame([(1, "en", "a", 1), (1, "en", "b", 2), (2, "en", "a", 1)], "key long, lang string, word string, n long")
    name = F.struct("lang", "word")
    got = words.groupBy("key").agg((F.min(name) != F.max(name)).alias("clash")).collect()
    assert {(r.key, r.clash) for r in got} == {(1, True), (2, False)}


def test_groups_keep_the_budget(spark):
    r = random.Random(1)
    n = {k: r.randrange(1, 40) for k in range(-500, 500)}
    firsts = collocations.cut_groups(spark.createDataFrame(list(n.items()), "key long, n long").repartition(5), 40)
    sums = Counter()
    for k, v in n.items():
        sums[int(np.searchsorted(firsts, k, "right"))] += v
    assert 0 not in sums and max(sums.values()) <= 40
    assert len(collocations.cut_groups(spark.createDataFrame([], "key long, n long"), 40)) == 0


def test_subtree():
    one, two, three = (np.array(x) for x in ([5, 5, 3, 5, 5], [2, 2, 0, 2, 0], [1, 1, 0, 4, 0]))
    nodes = collocations.subtree(one, two, three, np.array([1, 2, 4, 8, 16]))
    assert [total.tolist() for _, total in nodes] == [[4, 27], [11], [3, 8]]


def test_query_and_sql(spark):
    got = QUERIES[NAME](spark, SMALL)
    assert rows(got) == brute(table("documents", "text", "lang"))
    assert compare(got, connect(SMALL), ORACLE[NAME]) == ""
