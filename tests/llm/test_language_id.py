"""The language network: slopes against differences, reading against one byte at a time, held-out accuracy."""

import random
import zlib

import numpy as np
from conftest import SMALL
from whole import table

from contextmill.llm import language_id
from contextmill.llm.queries import QUERIES

NAME = "op11_language_id"


def small_network(languages=3, hidden=4, dtype=np.float64, seed=3):
    rng = np.random.default_rng(seed)
    network = language_id.Network(
        [f"l{i}" for i in range(languages)], *(language_id.Direction.start(rng, hidden, languages) for _ in range(2)),
        rng.normal(0, 1, (languages, 1)))
    for d in (network.forward, network.backward):
        d.bias = rng.normal(0, 1, d.bias.shape)
        for name in ("given", "state", "bias", "out"):
            setattr(d, name, getattr(d, name).astype(dtype))
    network.bias = network.bias.astype(dtype)
    return network


def test_slopes_are_those_of_the_loss():
    network, texts = small_network(), [b"ab c", "né".encode(), b"abba bab", b"1"]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    runs = language_id.Runs(data, np.cumsum(lengths) - lengths, lengths)
    truth = np.array([0, 1, 2, 0])[runs.order]
    _, found = language_id.slopes(network, runs, truth)
    rng = np.random.default_rng(0)
    for w, s in zip(network.weights(), found):
        assert w.shape == s.shape
        used = np.flatnonzero(np.abs(s).ravel() > 1e-9)
        for i in rng.permutation(used)[:12]:
            flat = w.reshape(-1)
            assert np.shares_memory(flat, w)
            both = []
            for step in (1e-5, -2e-5):
                flat[i] += step
                both.append(language_id.slopes(network, runs, truth)[0])
            flat[i] += 1e-5
            assert abs((both[0] - both[1]) / 2e-5 - s.ravel()[i]) < 1e-6


def one_byte_at_a_time(network, text):
    """Sums of the letters' probabilities, run by run, without any array over time."""
    total = np.zeros(len(network.languages))

    def squash(x):
        return x / (1 + abs(x))

    for a in range(0, len(text), language_id.RUN):
        run = text[a : a + language_id.RUN]
        scores = np.zeros((len(run), len(total)))
        for d, order in ((network.forward, range(len(run))), (network.backward, range(len(run) - 1, -1, -1))):
            k = d.state.shape[1]
            h = np.zeros(k)
            for i in order:
                x, back = d.given[:, run[i]], d.state @ h
                gates = 0.5 + 0.5 * squash(x[: 2 * k] + back[: 2 * k])
                new = squash(x[2 * k :] + gates[:k] * (back[2 * k :] + d.bias[:, 0]))
                h = new + gates[k:] * (h - new)
                scores[i] += d.out @ h
        p = np.exp(scores + network.bias[:, 0])
        p /= p.sum(axis=1, keepdims=True)
        for i, byte in enumerate(run):
            if byte > 127 or chr(byte).isalpha():
                total += p[i]
    return total


def test_all_bytes_are_read(monkeypatch):
    monkeypatch.setattr(language_id, "_BLOCK", 7)
    network, r = small_network(), random.Random(1)
    texts = ["", "a", "é1", "x" * 95, "x" * 96, "y" * 97, "".join(r.choices("abc é.1\n", k=1500)), "..."]
    got = language_id.pooled(network, [t.encode() for t in texts])
    assert np.allclose(got, [one_byte_at_a_time(network, t.encode()) for t in texts], atol=1e-4)


def crc_fifth(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


WORDS = {"aa": "lorem dolor amet sit elit", "bb": "käse brot größe weiß straße", "cc": "который здесь было время"}


def some_rows():
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(WORDS[name].split(), k=r.randrange(3, 40))), name) for i in range(300) for name in [r.choice(sorted(WORDS))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... \n", "bb"), (1003, "käse " * 200_000, None), (None, "lorem dolor amet", "cc"),
             (1004, "было", "cc"), (1004, "было", "cc")]
    return rows + [(2000 + i % 2, "lorem dolor sit amet elit", "aa") for i in range(900)]


def test_cases(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*x, "k", 0.5) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)
    network = language_id.fit(docs, rows=300)
    assert network.languages == sorted(WORDS)
    out = language_id.identify(docs, network).collect()
    assert len(out) == len(rows) and docs.columns == [c for c in out[0].asDict()][:3] + ["lang_pred", "score"]
    for r in out:
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id == 1003:
            assert r.lang_pred == "bb"
    sure = [r for r in out if r.doc_id is not None and r.doc_id < 300 and crc_fifth(r.doc_id)]
    assert len(sure) > 30 and sum(r.lang_pred == r.lang for r in sure) >= 0.95 * len(sure)
    assert language_id.identify(docs.filter("false"), network).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None), (5, "c", None)], "doc_id long, text string, lang string")
    network = language_id.fit(docs)
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, network).collect()] == [("und", 0)] * 2


def test_held_out_rows_and_their_languages_are_not_learned(spark):
    ids = [i for i in range(60) if crc_fifth(i)]
    rows = [(i, "abc", "secret") for i in ids] + [(None, "abc", "secret")] + [(i, "lorem", "aa") for i in range(60) if not crc_fifth(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).languages == ["aa"]
    from pyspark.sql import functions as F

    got = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or crc_fifth(r.doc_id)) for r in got)


def test_the_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language_id, "train", lambda runs, langs, names: taken.append((len(runs), names)))
    rows = [(i % 3 + 1, "x" * 500, "aa" if i % 10 else "bb") for i in range(5000)]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    (n, names), = taken
    assert names == ["aa", "bb"] and 60 <= n <= 100 * language_id.ROW_RUNS * 1.3


def test_query(spark):
    """Whole table, and nine in ten of the documents that the network has not seen."""
    big = SMALL.replace("0.001", "0.01")
    rows = QUERIES[NAME](spark, big).collect()
    import duckdb

    truth = dict(duckdb.sql(f"select doc_id, lang from '{big}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == crc_fifth(r.doc_id) for r in rows)
    unseen = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen) and len(unseen) > 150
    few = QUERIES[NAME](spark, SMALL)
    assert few.count() == len(table("documents", "doc_id"))
