from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contextmill.operators import evaluation as ev
from contextmill.operators import models
from contextmill.operators import reporting as rp


def questions(spark):
    return spark.createDataFrame([(1, "q one"), (2, "q two"), (3, "q three")], "query_id long, user_input string")


def hits(spark):
    rows = [(1, 2, "second"), (1, 1, "first"), (2, 1, "only")]
    return spark.createDataFrame(rows, "query_id long, position int, text string")


def known(spark):
    return spark.createDataFrame([("q one", "truth"), ("other", "x")], "user_input string, reference string")


def test_dataset(spark):
    rows = {r.query_id: r for r in ev.build_dataset(questions(spark), hits(spark), known(spark)).collect()}
    assert rows[1].retrieved_contexts == ["first", "second"] and rows[1].response == "first"
    assert rows[1].reference == "truth" and rows[2].reference == ""
    assert rows[3].retrieved_contexts == [] and rows[3].response == ""


def test_reference_needs_the_exact_question(spark):
    asked = spark.createDataFrame([(1, "q one "), (2, "Q one"), (3, "q one")], "query_id long, user_input string")
    got = {r.query_id: r.reference for r in ev.lookup_reference(asked, known(spark)).collect()}
    assert got == {1: "", 2: "", 3: "truth"}


def test_repeated_reference_does_not_repeat_the_question(spark):
    twice = known(spark).unionByName(known(spark))
    assert ev.lookup_reference(questions(spark), twice).count() == 3


def test_answers_by_a_model(spark):
    ask = models.chat_model(lambda: lambda prompt: prompt.upper())
    with_question = ev.build_dataset(questions(spark), hits(spark), known(spark), ev.ask_for_answer(ask))
    row = with_question.filter("query_id = 1").first()
    assert "FIRST\n\nSECOND" in row.response and row.response.endswith("Q ONE")
    alone = ev.build_dataset(questions(spark), hits(spark), known(spark), ev.ask_for_answer(ask, False))
    assert alone.filter("query_id = 1").first().response == "RESPONDE USANDO SOLO ESTE CONTEXTO:\n[\"FIRST\",\"SECOND\"]"


def dataset(spark):
    rows = [
        (1, "q", ["the cat sat", "on a mat"], "The cat sat. Dogs fly high!", "Cat sat on mat. Birds sing loudly."),
        (2, "q", [], "", ""),
        (3, "q", ["x"], "...", "x"),
    ]
    return spark.createDataFrame(
        rows, "query_id long, user_input string, retrieved_contexts array<string>, response string, reference string"
    )


def test_verdicts(spark):
    got = {(r.side, r.evidence, r.claim_id): r.supported
           for r in ev.claim_verdicts(dataset(spark)).filter("query_id = 1").collect()}
    assert got == {
        ("response", "contexts", 0): True, ("response", "contexts", 1): False,
        ("response", "reference", 0): True, ("response", "reference", 1): False,
        ("reference", "contexts", 0): True, ("reference", "contexts", 1): False,
        ("reference", "response", 0): True, ("reference", "response", 1): False,
    }


def test_metrics(spark):
    data = dataset(spark)
    got = {r.query_id: r for r in ev.metrics_for(data, ev.claim_verdicts(data), ["query_id"]).collect()}
    assert (got[1].context_recall, got[1].faithfulness, got[1].factual_correctness) == (0.5, 0.5, 0.5)
    assert (got[2].context_recall, got[2].faithfulness, got[2].factual_correctness) == (None, None, None)
    assert (got[3].context_recall, got[3].faithfulness, got[3].factual_correctness) == (1.0, None, 0.0)


def test_verdicts_by_a_model(spark):
    judge = models.chat_model(lambda: lambda prompt: "1" if "Dogs" in prompt.split("Claim:")[1] else "no")
    verdicts = ev.judge_claims(dataset(spark), judge)
    got = verdicts.filter("supported").collect()
    assert {(r.query_id, r.side, r.evidence, r.claim_id) for r in got} == {
        (1, "response", "contexts", 1), (1, "response", "reference", 1)
    }
    # Unreadable replies are no verdicts, and count on neither side.
    assert verdicts.filter("not supported").count() == 0 and verdicts.filter("supported is null").count() > 0
    assert ev.metric_table(verdicts, ["query_id"]).filter("query_id = 1").first().faithfulness == 1.0


def test_verdict_table_from_outside(spark):
    rows = [(1, "reference", "contexts", 0, True), (1, "reference", "contexts", 1, True),
            (1, "response", "contexts", 0, False), (1, "response", "reference", 0, True),
            (1, "response", "reference", 1, False), (1, "reference", "response", 0, False),
            (1, "reference", "response", 1, False)]
    verdicts = spark.createDataFrame(rows, "query_id long, side string, evidence string, claim_id int, supported boolean")
    row = ev.metric_table(verdicts, ["query_id"]).first()
    assert (row.context_recall, row.faithfulness, row.factual_correctness) == (1.0, 0.0, 2 / 5)


SUMMARY = [
    # Published means of the four runs.
    ("token", "baseline", 1.000, 0.983, 0.248),
    ("token", "filtered", 1.000, 1.000, 0.314),
    ("semantic", "baseline", 0.703, 0.993, 0.398),
    ("semantic", "filtered", 0.689, 1.000, 0.354),
]


def summary(spark):
    rows = spark.createDataFrame(
        SUMMARY, "chunker string, mode string, context_recall double, faithfulness double, factual_correctness double"
    )
    return rp.metric_summary(rows, rp.RUN)


def test_comparisons(spark):
    got = {(r.metric, r.chunker): r.change_pct for r in rp.compare_configurations(summary(spark)).collect()}
    assert round(got["factual_correctness", "token"], 1) == 26.6
    assert round(got["factual_correctness", "semantic"], 1) == -11.1
    across = {(r.metric, r.mode): r.change_pct
              for r in rp.compare_chunkers(summary(spark), "token", "semantic").collect()}
    assert round(across["factual_correctness", "baseline"]) == 60
    assert round(across["context_recall", "baseline"]) == -30


def test_best(spark):
    got = {r.metric: (r.chunker, r.mode) for r in rp.best_configuration(summary(spark)).collect()}
    assert got == {
        "context_recall": ("token", "baseline"),
        "faithfulness": ("semantic", "filtered"),
        "factual_correctness": ("semantic", "baseline"),
    }


def test_means_skip_nan_and_missing(spark):
    rows = spark.createDataFrame(
        [("c", "m", 1, "q", 0.5, float("nan")), ("c", "m", 2, "q", None, float("nan")), ("c", "m", 3, "q", 1.0, None)],
        "chunker string, mode string, query_id long, user_input string, a double, b double",
    )
    got = {r.metric: r for r in rp.metric_summary(rows, [*rp.RUN, "query_id"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["mean"], got["a"].scored, got["a"].questions) == (0.75, 2, 3)
    assert (got["b"]["mean"], got["b"].scored) == (None, 0)


@pytest.mark.parametrize("f1", [0.75, None])
def test_factual_name(spark, f1):
    """The F1-named metric wins where it is present, even if it is empty."""
    rows = spark.createDataFrame(
        [("c", "m", f1, 0.1), ("c", "m", f1, 0.3)],
        "chunker string, mode string, `factual_correctness(mode=f1)` double, factual_correctness double",
    )
    got = rp.resolve_factual(rp.metric_summary(rows, rp.RUN)).collect()
    assert [(r.metric, r["mean"]) for r in got] == [("factual_correctness", f1)]


def runs(spark):
    data = ev.build_dataset(questions(spark), hits(spark), known(spark))
    return data.withColumn("chunker", F.lit("token")).withColumn("mode", F.explode(F.array(F.lit("baseline"), F.lit("filtered"))))


def test_report(spark, tmp_path):
    asked = rp.question_summary(runs(spark))
    first = asked.filter("mode = 'baseline'").orderBy("index").collect()
    assert [(r["index"], r.question, r.answer_length_chars, r.num_contexts_retrieved) for r in first] == [
        (1, "q one", 5, 2), (2, "q two", 4, 1), (3, "q three", 0, 0)
    ]
    means = summary(spark).filter("chunker = 'token'").withColumn(
        "mean", F.when(F.col("metric") != "faithfulness", F.col("mean"))
    )
    reports = rp.run_report(means, runs(spark), "20240101_120000", {"llm_model": "m"}, {"token": {"chunk_size": 2048}})
    path = str(tmp_path / "reports")
    for _ in range(2):
        rp.write_json(reports, path, "20240101_120000")
    rp.write_json(reports, path, rp.stamp(datetime(2024, 1, 1, 13, 5, 9)))
    assert spark.read.json(path).groupBy("run").count().orderBy("run").collect() == [("20240101_120000", 2), ("20240101_130509", 2)]
    text = spark.read.text(f"{path}/mode=baseline/chunker=token/run=20240101_120000").first().value
    assert '"faithfulness":{"value":null' in text and '"filtering_stages":null' in text
    read = spark.read.json(path).filter("mode = 'filtered'").first()
    assert read.metadata.num_questions == 3 and read.metadata.filtering_enabled
    assert read.configuration.retrieval_initial_k == 15 and read.configuration.chunk_size == 2048
    assert read.configuration.filtering_stages == ["base_score", "self_reflection", "critic_eval"]
    assert read.metrics_summary.factual_correctness.value == 0.314
    assert read.metrics_summary.faithfulness.interpretation and read.raw_results.factual_correctness == 0.314


def test_words_of_a_text_are_found_once(spark):
    """However many texts it is compared with; verdicts are those of the definition over ``claim_rows``."""
    from contextmill.functions.text import word_set

    texts = ["One two. Two three!\nfour", "", "one. ... - . Four five six", "three two. İstanbul ΣΣ.", "six"]
    rows = [(i, texts[i % 5], [texts[(i + 1) % 5], texts[(i + 3) % 5]][: i % 3], texts[i * 2 % 5], texts[i * 3 % 5]) for i in range(15)]
    data = spark.createDataFrame(rows, "query_id long, user_input string, retrieved_contexts array<string>, response string, reference string")
    got = ev.claim_verdicts(data)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.split("Generate explode(")[0] and plan.count("regexp_extract_all(lower(") == 5
    want = ev.claim_rows(data).select("query_id", "side", "evidence", "found_in", F.posexplode("claims").alias("claim_id", "claim"))
    own = word_set(F.col("claim"))
    share = F.size(F.array_intersect(own, word_set(F.col("found_in")))) / F.size(own)
    want = want.select("query_id", "side", "evidence", "claim_id", (share >= 0.5).alias("supported"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 30
