"""Toxicity on held-out labels, the ordinal fit on made grades, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.llm import toxicity

LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.filter("doc_id % 5 != 0"), label="label")
    held = toxicity.score(docs.join(F.broadcast(labels.filter("doc_id % 5 = 0")), "doc_id"), model)
    rows = held.select("label", "toxic", "severity", "grade").collect()
    hit = sum(r.label == 1 and r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.label for r in rows) and hit >= 0.95 * sum(r.toxic for r in rows)
    mean = lambda x: np.mean([r.severity for r in rows if r.label == x])
    assert mean(1) > 1 > mean(0) and {r.grade for r in rows} == {0, 1, 2, 3}


def test_ordinal_fit_recovers_order_and_shared_weights():
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (4000, 3)).astype(float)
    latent = x @ [2.0, 1.0, 0.0] + r.logistic(size=4000)
    grades = np.searchsorted([1.0, 3.0, 5.0], latent)
    rows, columns = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, 3, 3, penalty=0.1, rounds=1500)
    assert np.allclose(weights, [2, 1, 0], atol=0.2) and np.allclose(cuts, [1, 3, 5], atol=0.3)


def test_empty_grades_get_no_probability():
    rows, columns, values = np.array([0, 1, 2]), np.zeros(3, int), np.ones(3)
    _, cuts = toxicity.fit_ordinal(rows, columns, values, np.array([0, 0, 0, 3, 3, 3]), 1, 3)
    assert cuts[0] == cuts[1] == cuts[2]
    assert list(toxicity.fit_ordinal(rows, columns, values, np.zeros(3, int), 1, 3)[1]) == [20.0] * 3


@pytest.fixture
def made(spark):
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(f"plain{(i * 7 + j) % 90}" for j in range(12)) + (" nastyword vilething%d" % i) * bad
        rows.append((i, text, int(bad), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, severity string")


def test_odd_rows(spark, made):
    odd = spark.createDataFrame(
        [(None, "a nastyword", 1, "x"), (901, None, 0, "x"), (902, "", 0, "x"), (903, "NastyWord! vilethings", None, "x"),
         (904, "plain1 " * 50_000, 0, "x"), (904, "plain1 " * 50_000, 0, "x")],
        "doc_id long, text string, toxic int, severity string")
    docs = made.union(odd)
    labels = docs.select("doc_id", "toxic").union(docs.select("doc_id", "toxic"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == 606
    got = {r.doc_id: r for r in scored.filter("doc_id is null or doc_id > 900").collect()}
    assert got[None].toxic and got[903].toxic and not got[901].toxic and not got[902].toxic and not got[904].toxic
    kept = toxicity.drop_toxic(docs.withColumn("grade", F.lit(9)), labels)
    assert kept.columns == ["doc_id", "text", "toxic", "severity", "grade"] and kept.count() == 606 - 150 - 2
    assert {r.severity for r in kept.collect()} == {"x"}


def test_without_labels_or_documents(spark, made):
    for labels, toxic in ((made.filter("false"), 0), (made.filter("toxic = 0"), 0), (made.filter("toxic = 1"), 600)):
        model = toxicity.fit(made, labels)
        assert toxicity.score(made, model).filter("toxic").count() == toxic
    assert toxicity.score(made.filter("false"), toxicity.fit(made.filter("false"), made)).count() == 0


def test_sample_is_bounded(spark, made):
    assert toxicity.labelled_sample(made, made, "doc_id", "text", "toxic", 100).count() <= 130


def test_sample_is_bounded_in_rows_of_repeated_ids(spark, made):
    some = made.withColumn("text", F.concat_ws(" ", "text", "doc_id"))
    hot = some.select((F.col("doc_id") % 3).alias("doc_id"), "text", "toxic")
    docs = some.select("doc_id", "text").union(hot.select("doc_id", "text"))
    for seed in range(3):  # whichever ids a hash prefers
        moved = docs.withColumn("doc_id", F.col("doc_id") + 1000 * seed)
        labels = made.select((F.col("doc_id") + 1000 * seed).alias("doc_id"), "toxic")
        sample = toxicity.labelled_sample(moved, labels, "doc_id", "text", "toxic", 100)
        assert 60 <= sample.count() <= 130
    one = docs.withColumn("doc_id", F.lit(5))
    assert toxicity.labelled_sample(one, made.filter("doc_id = 5"), "doc_id", "text", "toxic", 100).count() <= 130
