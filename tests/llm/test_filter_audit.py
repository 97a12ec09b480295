"""The audit of filter interactions against counting document by document."""

import re
from itertools import permutations

import numpy as np
from conftest import SMALL
from oracle_check import compare, connect
from whole import table

from contextmill.llm import filter_audit
from contextmill.llm.queries import ORACLE, QUERIES

NAME = "op13_filter_interaction_audit"
LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (3, LONG + " $", None), (4, None, "en"), (5, "", "en"), (6, "", None),
    (None, LONG, "en"), (None, None, ""), (7, "A" * 50 + " b", "en"), (8, "a\x0bb\x1cc d ÉTÉ", "de"), (9, "spam " * 500, "de"),
    (10, "spam " * 500, "de"), (11, "é " * 700_000, "fr"), (12, "x&", "fr"), (12, "x&", "fr"), (13, "x&", "fr"),
    *[(100 + i, "copy me", "en") for i in range(120)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (9, None, 1), (10, 1, 1), (12, 1, 0), (None, 1, 1), (105, 1, 1), (999, 1, 1)]


def brute(docs, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    fails = []
    for k, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((part or "", k, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and least[t] < k,
        }))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(k, f) for p, k, f in fails if p == part]
        rows, total = {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for i, letter in enumerate(order):
                gone = [(k, f) for k, f in left if f[letter]]
                left = [(k, f) for k, f in left if not f[letter]]
                total[letter] += len(gone)
                rows["".join(order), i + 1] = [
                    len(left), len(gone), sum(f[letter] for _, f in own) - len(gone),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone), letter]
        for (order, step), row in rows.items():
            out[part, order, step] = (*row[:6], total[row[6]])
    return out


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_cases(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, lang string, state int, digest int").repartition(7)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert found(filter_audit.filter_interactions(docs, labels)) == brute(DOCS, LABELS)
    assert found(filter_audit.filter_interactions(docs, labels.filter("false"))) == brute(DOCS, [])
    assert filter_audit.filter_interactions(docs.filter("false"), labels).count() == 0


def test_query_and_sql(spark):
    got = QUERIES[NAME](spark, SMALL)
    assert found(got) == brute(table("documents", "doc_id", "text", "lang"), table("labels", "doc_id", "quality", "toxic"))
    assert compare(got, connect(SMALL), ORACLE[NAME]) == ""


def test_hidden_words_are_counted_again(spark, monkeypatch):
    """Texts whose words all share one hash are not taken for repetitive ones."""
    monkeypatch.setattr("contextmill.llm.words.Words.hashes", lambda self: np.zeros(len(self), np.uint64))
    from contextmill.llm.words import blank_separated

    import pyarrow as pa

    words = blank_separated().split(pa.array(["a b c d", "a a a b", "", None, "a b"]))
    assert filter_audit._repetitive(words, 60).tolist() == [False, True, False, False, False]


def test_contraction_of_one_axis():
    _, take = filter_audit.selections(1)
    assert filter_audit.contract(np.array([[5], [3]]), take["kept"]).tolist() == [[5]]
    assert filter_audit.contract(np.array([[5], [3]]), take["removed"]).tolist() == [[3]]
