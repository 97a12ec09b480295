import random

import pytest
from pyspark.sql import functions as F

from contextmill.functions.numbers import parse_reply
from contextmill.operators import models
from contextmill.operators import relevance as rel

SCORED = "query_id long, chunk_id long, rank int, final_score double"


def frame(spark, scores, query=1):
    rows = [(query, 100 + i, i + 1, float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, SCORED)


def expected(scores, minimum):
    """The filter's rule on a list of scores, as indexes in result order."""
    if not scores:
        return []
    mean = sum(scores) / len(scores)
    var = sum((s - mean) ** 2 for s in scores) / len(scores)
    limit = mean + var**0.5 if var < 0.01 else mean
    limit = round(min(1.0, max(0.0, limit)), 12)
    kept = [i for i, s in enumerate(scores) if s >= limit]
    if len(kept) < minimum:
        kept = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:minimum]
    return kept


def short(spark, scores, minimum):
    kept = rel.filter_by_relevance(frame(spark, scores), minimum).orderBy("position").collect()
    return [r.chunk_id - 100 for r in kept]


def long(spark, scores, minimum):
    kept = rel.filter_long_lists(frame(spark, scores), minimum).orderBy("order_key").collect()
    return [r.chunk_id - 100 for r in kept]


CASES = {
    "high variance, enough pass": ([0.9, 0.1, 0.8, 0.0, 0.95, 0.7, 0.05], 3),
    "more than the minimum pass, order kept": ([0.8, 0.1, 0.9, 0.85, 0.0, 0.95], 2),
    "high variance, fallback": ([1.0, 0.0, 0.1, 0.0, 0.05], 3),
    "low variance, fallback": ([0.5, 0.52, 0.51, 0.55, 0.5], 3),
    "low variance, enough pass": ([0.5, 0.6, 0.5, 0.6, 0.5, 0.6, 0.5], 3),
    "exactly the minimum": ([0.9, 0.9, 0.9, 0.1, 0.1, 0.1], 3),
    "fewer candidates than the minimum": ([0.3, 0.9], 3),
    "single": ([0.4], 3),
    "all equal": ([0.7] * 6, 3),
    "ties in the fallback": ([0.2, 0.2, 0.2, 0.9, 0.2], 3),
}


@pytest.mark.parametrize("name", CASES)
def test_filter(spark, name):
    scores, minimum = CASES[name]
    want = expected(scores, minimum)
    assert short(spark, scores, minimum) == want
    assert long(spark, scores, minimum) == want


def test_filter_random(spark):
    rng = random.Random(7)
    lists = [[round(rng.random() ** 2, 3) for _ in range(rng.randint(1, 15))] for _ in range(60)]
    rows = [(q, 100 + i, i + 1, s) for q, ss in enumerate(lists) for i, s in enumerate(ss)]
    scored = spark.createDataFrame(rows, SCORED)
    for minimum in (3, 5):
        got = {}
        for r in rel.filter_by_relevance(scored, minimum).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id - 100)
        assert got == {q: expected(ss, minimum) for q, ss in enumerate(lists)}
        got = {}
        for r in rel.filter_long_lists(scored, minimum).orderBy("query_id", "order_key").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id - 100)
        assert got == {q: expected(ss, minimum) for q, ss in enumerate(lists)}


def test_equal_scores_always_pass(spark):
    for value in (0.1, 0.3, 0.7):
        assert len(short(spark, [value] * 15, 3)) == 15


def test_no_candidates(spark):
    empty = spark.createDataFrame([], SCORED)
    assert rel.filter_by_relevance(empty).count() == 0
    assert rel.filter_long_lists(empty).count() == 0


@pytest.mark.parametrize("scores, low", [([0.4, 0.6], True), ([0.2, 0.4], False)])
def test_variance_limit(spark, scores, low):
    row = rel.audit(frame(spark, scores)).first()
    mean = sum(scores) / 2
    assert row.threshold == pytest.approx(mean + 0.1 if low else mean)


def test_audit(spark):
    row = rel.audit(frame(spark, [1.0, 0.0, 0.1, 0.0, 0.05])).first()
    assert (row.candidates, row.passed, row.fallback) == (5, 1, True)
    assert 0 <= row.threshold <= 1


def test_one_question_with_most_rows(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.6 else i, i, i, rng.random()) for i in range(2, 20000)]
    scored = spark.createDataFrame(rows, SCORED).repartition(8)
    got = {(r.query_id, r.chunk_id) for r in rel.filter_long_lists(scored).collect()}
    want = {(r.query_id, r.chunk_id) for r in rel.filter_by_relevance(scored).collect()}
    assert got == want


REPLIES = {
    "0.8": 0.8, " 0.8\n": 0.8, " 0.8": 0.8, "1.7": 1.0, "-0.2": 0.0, "1": 1.0, ".5": 0.5, "5.": 1.0, "1e-1": 0.1,
    "+0.25": 0.25, "nan": 1.0, "inf": 1.0, "-Infinity": 0.0, "": 0.125, "n/a": 0.125, "0.5d": 0.125, "0.5f": 0.125,
    "0x1p-1": 0.125, "0.8 relevant": 0.125, "1_0": 0.125, "0,5": 0.125, None: 0.125,
}


def test_reply_forms(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, reply string")
    got = rows.select("i", parse_reply(F.col("reply"), F.lit(0.125)).alias("score")).collect()
    assert [r.score for r in sorted(got)] == list(REPLIES.values())


def test_fallback_chain(spark):
    rows = [(1, "0.4", "0.6", "0.8"), (2, None, "0.6", "0.8"), (3, "0.4", "bad", "0.8"), (4, "0.4", "0.6", None),
            (5, "x", None, ""), (6, "0.4", None, None)]
    replies = spark.createDataFrame(rows, "query_id long, base_reply string, reflect_reply string, critic_reply string")
    got = {r.query_id: tuple(r.scores) for r in rel.score_replies(replies).collect()}
    assert got == {
        1: (0.4, 0.6, 0.8, 0.62), 2: (0.5, 0.6, 0.8, 0.65), 3: (0.4, 0.4, 0.8, 0.56), 4: (0.4, 0.6, 0.6, 0.54),
        5: (0.5, 0.5, 0.5, 0.5), 6: (0.4, 0.4, 0.4, 0.4),
    }


def test_scoring_by_model(spark):
    """Each prompt carries the score of the stage before; failed calls fall back."""

    def connect():
        def call(prompt):
            if "fail" in prompt:
                raise RuntimeError("no reply")
            if prompt.startswith("How relevant"):
                return " 0.9 "
            if prompt.startswith("You rated"):
                return "0.5" if "passage 0.9 " in prompt else "0"
            return "0.25" if "passage 0.5." in prompt else "0"

        return call

    rows = [(1, 1, 1, "a text", "a question"), (1, 2, 2, "fail", "a question")]
    pairs = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, text string, user_input string")
    scored = rel.score_with_model(pairs, models.chat_model(connect)).orderBy("rank").collect()
    assert tuple(scored[0].scores) == (0.9, 0.5, 0.25, 0.52)
    assert tuple(scored[1].scores) == (0.5, 0.5, 0.5, 0.5)
