from datetime import datetime

import pytest

from contextmill.operators import models, reporting, runs
from contextmill.operators import relevance as rel
from contextmill.operators.evaluation import ask_for_answer, judge_claims
from contextmill.operators.ingest import ingest
from contextmill.operators.models import hashed_embedder

DIM = 32
TEXTS = [
    "Cats sleep all day. Cats hunt mice at night.",
    "Ships cross the wide sea. Sailors watch the stars.",
    "Bread needs flour and water. Bakers rise early.",
]


def collections(spark, path):
    rows = [(i, f"f{i}", t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return ingest(docs, path, hashed_embedder(DIM), DIM)


def questions(spark):
    return spark.createDataFrame([(1, "cats hunt mice"), (2, "the wide sea")], "query_id long, user_input string")


def known(spark):
    return spark.createDataFrame([("cats hunt mice", "Cats hunt mice at night.")], "user_input string, reference string")


def reviewer():
    """Rates a passage by whether the question's first word is in it."""

    def connect():
        def call(prompt):
            question = prompt.split("Question: ")[1].split("\n")[0]
            passage = prompt.split("Passage: ")[1].split("\n\nQuestion")[0]
            return "0.9" if question.split()[0] in passage.lower() else "0.1"

        return call

    return models.chat_model(connect)


@pytest.mark.parametrize("modes", [["baseline"], ["filtered"], ["baseline", "filtered"]])
def test_run(spark, tmp_path, modes):
    ask = reviewer()
    asked_for = []

    def score(candidates):
        asked_for.append(1)
        return rel.score_with_model(candidates, ask)

    data = runs.evaluation_dataset(
        questions(spark), collections(spark, str(tmp_path / "c")), known(spark), ["recursive", "semantic"],
        hashed_embedder(DIM), DIM, score, modes, k=2,
    )
    assert data.count() == 2 * 2 * len(modes)
    assert bool(asked_for) == ("filtered" in modes)
    metrics = runs.run_metrics(data)
    assert metrics.count() == data.count()
    row = metrics.filter(f"query_id = 1 and mode = '{modes[-1]}' and chunker = 'recursive'").first()
    assert (row.context_recall, row.faithfulness) == (1.0, 1.0)
    runs.write_run(data, metrics, str(tmp_path / "out"), datetime(2024, 1, 1), {}, {}, k=2)
    assert spark.read.json(str(tmp_path / "out/reports")).count() == 2 * len(modes)
    assert spark.read.json(str(tmp_path / "out/questions")).filter("index = 1").count() == 2 * len(modes)


def test_answers_and_verdicts_by_models(spark, tmp_path):
    answer = models.chat_model(lambda: lambda prompt: "Cats rule. Cats hunt.")
    judge = models.chat_model(lambda: lambda prompt: "1" if "hunt" in prompt.split("Claim: ")[1] else "0")
    data = runs.evaluation_dataset(
        questions(spark), collections(spark, str(tmp_path / "c")), known(spark), ["recursive"],
        hashed_embedder(DIM), DIM, None, [reporting.MODES[False]], ask_for_answer(answer), k=1,
    )
    row = runs.run_metrics(data, lambda d: judge_claims(d, judge)).filter("query_id = 1").first()
    assert (row.context_recall, row.faithfulness, row.factual_correctness) == (1.0, 0.5, 2 / 3)


def test_one_search_serves_all_collections(spark, tmp_path, monkeypatch):
    """Both collections in one search, with the rows that a search of each alone gives."""
    from contextmill.operators import retrieval as ret

    searches, plain = [], ret.knn
    monkeypatch.setattr(ret, "knn", lambda *a, **b: searches.append(b.get("group")) or plain(*a, **b))
    points = collections(spark, str(tmp_path / "c"))

    def run(chunkers):
        data = runs.evaluation_dataset(
            questions(spark), points, known(spark), chunkers, hashed_embedder(DIM), DIM,
            lambda c: rel.score_with_model(c, reviewer()), ["baseline", "filtered"], k=2)
        return sorted(map(str, data.collect()))

    both = run(["recursive", "semantic"])
    assert searches == ["chunker"] and len(both) == 8
    assert both == sorted(run(["recursive"]) + run(["semantic"]))


def test_groups_are_searched_apart(spark, setting):
    import numpy as np

    from contextmill.operators import retrieval as ret

    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "abc"[i % 3] if i % 10 else None) for i in range(200)]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, name string").repartition(3)
    asked = spark.createDataFrame([(q, rng.normal(size=6).tolist()) for q in range(5)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.name or "", r.rank, r.chunk_id, r.sim) for r in ret.knn(asked, corpus, 4, 6, group="name").toDF("query_id", "chunk_id", "sim", "name", "rank").collect())
    want = []
    for name in ("a", "b", "c", None):
        own = corpus.filter("name is null" if name is None else f"name = '{name}'")
        want += [(r.query_id, name or "", r.rank, r.chunk_id, r.sim) for r in ret.knn(asked, own, 4, 6).toDF("query_id", "chunk_id", "sim", "rank").collect()]
    assert got == sorted(want)


def test_means_have_the_same_bits_in_any_order(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [("c", "m", i, r.random() * r.choice([1, 1e-9, 1e3])) for i in range(3000)] + [("c", "m", -1, float("nan")), ("c", "m", -2, None)]
    found = set()
    for n in (1, 3, 8):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "chunker string, mode string, query_id int, some double").repartition(n)
        row = reporting.metric_summary(df, runs.KEYS).first()
        assert (row.scored, row.questions) == (3000, 3002)
        found.add(row["mean"].hex())
    assert len(found) == 1
    true = sum(x[3] for x in rows if x[2] >= 0) / 3000
    assert float.fromhex(found.pop()) == pytest.approx(true, rel=1e-12)
    odd = spark.createDataFrame([(1.0,), (float("inf"),)], "x double").agg(reporting.exact_mean(F.col("x")))
    assert odd.first()[0] == float("inf")
    none = spark.createDataFrame([(None,)], "x double").agg(reporting.exact_mean(F.col("x")))
    assert none.first()[0] is None


def test_scores_hold_no_texts(spark):
    points = spark.createDataFrame([(1, "cats"), (2, "dogs")], "chunk_id long, text string")
    hits = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, chunk_id long")
    score = runs.candidate_scorer(questions(spark), points, lambda rows: rows.selectExpr("*", "length(text) + length(user_input) as final_score"))
    scored = score(hits)
    assert "text" not in scored.columns and "user_input" not in scored.columns
    assert sorted(r.final_score for r in scored.collect()) == [18, 18]


def test_a_reference_is_joined_once_for_all_runs(spark):
    """Texts and references move by question; runs are made of them afterwards, in each mode's own order."""
    from contextmill.operators.evaluation import build_datasets

    hits = spark.createDataFrame(
        [(1, "a", [("x", 2), ("y", 1)], "one"), (1, "a", [("x", 1)], "two"), (1, "b", [("y", 1)], "three")],
        "query_id long, chunker string, places array<struct<mode:string,position:int>>, text string")
    asked = questions(spark)
    data = build_datasets(asked, hits, known(spark), [(c, m) for c in "ab" for m in "xy"])
    got = {(r.query_id, r.chunker, r["mode"]): r.retrieved_contexts for r in data.collect()}
    assert got == {
        (1, "a", "x"): ["two", "one"], (1, "a", "y"): ["one"], (1, "b", "x"): [], (1, "b", "y"): ["three"],
        **{(2, c, m): [] for c in "ab" for m in "xy"},
    }
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # above the joins


def test_replies_without_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    written, plain = [], rel.materialise
    monkeypatch.setattr(rel, "materialise", lambda df, name: written.append(df.columns) or plain(df, name))
    pairs = spark.createDataFrame([(1, 5, "cats hunt", "cats")], "query_id long, chunk_id long, text string, user_input string")
    score = lambda **more: rel.score_with_model(pairs, lambda prompt: F.lit("0.5"), **more)
    assert score(texts=False).columns == [c for c in score().columns if c not in ("text", "user_input")]
    assert "text" not in written[0] and "text" in written[1]
    assert score(texts=False).first().final_score == score().first().final_score == 0.5
