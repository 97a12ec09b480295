"""Decontamination and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from whole import table

from contextmill.llm import decontamination, substring_dedup, words
from contextmill.llm.queries import QUERIES

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def leaks(docs, items, n=10):
    known = {}
    for key, text in items:
        w = alnum(text)
        if w:
            for i in range(max(1, len(w) - n + 1)):
                known.setdefault(tuple(w[i : i + n]), set()).update([str(key)] * (key is not None))
    out = []
    for key, text in docs:
        w, hit, found = alnum(text), set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(w) - size + 1):
                if (ids := known.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def kept(docs, n=50):
    split = lambda t: re.findall("[^ \t-\r]+", t or "")
    first = {}
    for key, text in docs:
        w = split(text)
        for i in range(len(w) - n + 1 if key is not None else 0):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, key), key)
    out = []
    for key, text in docs:
        w, gone = split(text), set()
        for i in range(len(w) - n + 1 if key is not None else 0):
            if first[tuple(w[i : i + n])] < key:
                gone.update(range(i, i + n))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


def test_decontamination_query(spark):
    rows = QUERIES["op3_benchmark_decontamination"](spark, SMALL).collect()
    assert Counter(map(tuple, rows)) == leaks(table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"))
    assert any(r.contaminated for r in rows)


def test_substring_query(spark):
    rows = QUERIES["op4_substring_dedup"](spark, SMALL).collect()
    assert Counter(map(tuple, rows)) == kept(table("documents", "doc_id", "text"))
    assert any(r.n_removed for r in rows)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item!"), (3, ""), (4, None), (5, "!!"),
         (2, "short item"), (None, "lost words"), (6, "é " * 12), (7, "two three four five six seven eight nine ten eleven")]
TEXTS = [
    (1, "x ONE two-three four five six, seven eight nine TEN eleven twelve short ITEM"), (2, None), (3, ""), (4, "!"), (5, "short"),
    (5, "item short item short item"), (None, "short item"), (6, "é " * 30), (7, "lost words"), (8, "ok " * 40_000 + "short item"),
    (9, "shorti tem short"), (1, "item"),
]


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination_cases(spark, block):
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.mark_contamination(docs, items, block_bytes=block).collect()
    got = Counter(
        (r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), len(r["items"]),
         hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hits)) for r in rows)
    assert got == leaks(TEXTS, ITEMS)
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in leaks(TEXTS, ITEMS).elements() if not r[5])
    cut = {(r.doc_id, r.text) for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert {(1, "x  twelve "), (5, "short"), (9, "shorti tem short"), (2, None), (3, "")} <= cut and len(cut) == len(TEXTS)
    assert decontamination.mark_contamination(docs, items.filter("false")).filter("size(hits) > 0").count() == 0
    assert decontamination.mark_contamination(docs.filter("false"), items).count() == 0


def documents(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "\u00a0x"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 80, 200)]
    docs = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "a " * 400), (5, "a " * 60), (6, " ".join(passages[4])), (None, " ".join(passages[4]))]
    for i in range(60):
        w = some(r.randrange(80))
        for _ in range(r.randrange(3)):
            w += r.choice(passages) + some(r.randrange(5))
        docs.append((r.randrange(10, 60), r.choice([" ", "\n", " \t"]).join(w)))
    return docs + docs[-3:]


@pytest.mark.parametrize("seed,bits", [(1, 26), (2, 26), (3, 10)])
def test_substring_cases(spark, seed, bits):
    docs = documents(seed)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, kept string").repartition(7)
    rows = substring_dedup.remove_repeats(df, width_bits=bits).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows)
    assert got == kept(docs)
    assert substring_dedup.remove_repeats(df.filter("false"), width_bits=bits).count() == 0


def test_word_hashes_do_not_depend_on_place():
    splitter = words.alphanumeric()
    w = splitter.split(pa.array(["Alpha beta", "x", None, "gamma ALPHA beta alpha"]))
    h = w.hashes()
    assert h[0] == h[4] == h[6] and h[1] == h[5] and len(set(h.tolist())) == 4
    pairs = w.windows(h, 2)
    assert pairs[0] == pairs[4] and list(w.fits(2)) == [0, 3, 4, 5]
    assert list(w.counts) == [2, 1, 0, 4] and w.canonical()[0].startswith(b"alpha beta x gamma")
    assert np.array_equal(w.text_of(np.arange(7)), [0, 0, 1, 3, 3, 3, 3])


def test_benchmark_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """Also the items of one window that very many share are in several blocks."""
    items = [(f"i{i}", "one two three four") for i in range(300)] + [("x", "three four five six"), ("y", "p q r s")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, "zero one two three four five six seven"), (2, "p q r s"), (3, "none"), (3, None)], "doc_id long, text string").repartition(2)
    sizes, live = [], []

    begin = decontamination.WindowSet.__init__

    def counted(self, rows):
        sizes.append(len(rows))
        begin(self, rows)

    real = spark.sparkContext.broadcast

    def broadcast(value):
        held = real(value)
        live.append(1)
        most.append(len(live))
        destroy = held.destroy
        held.destroy = lambda *a: (live.pop(), destroy(*a))
        return held

    most = []
    monkeypatch.setattr(decontamination.WindowSet, "__init__", counted)
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    marked = decontamination.mark_contamination(docs, benchmark, window=4, block_bytes=10_000)
    assert len(sizes) > 3 and max(sizes) < 150 and max(most) == 1
    got = {r.doc_id: r for r in marked.collect() if r.text}
    assert [tuple(s) for s in got[1].hits] == [(1, 7)] and got[1].n_words == 8
    assert got[1]["items"] == sorted([f"i{i}" for i in range(300)] + ["x"])
    assert [tuple(s) for s in got[2].hits] == [(0, 4)] and got[2]["items"] == ["y"] and not got[3].hits
    assert marked.count() == 4 and marked.columns == ["doc_id", "text", "n_words", "hits", "items"]
