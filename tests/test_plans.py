"""What the physical plans must and must not do."""

import pytest
from conftest import SMALL

from contextmill.plans.queries import QUERIES


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_similarity_runs_once_for_segments(spark):
    assert final_plan(QUERIES["semantic_segments"](spark, SMALL)).count("MapInArrow") == 1


SEARCHES = ("knn_topk", "retrieve_baseline", "retrieve_filtered", "score_chain", "retrieval_diff", "retrieve_text", "claim_verdicts")


@pytest.mark.parametrize("name", SEARCHES)
def test_results_are_read_from_written_hits(spark, name):
    """Nothing of the search is left in the plan that reads its hits."""
    plan = final_plan(QUERIES[name](spark, SMALL))
    assert "MapInArrow" not in plan and "WindowGroupLimit" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_lists_are_not_shuffled(spark):
    """Candidates meet their question's row by broadcast; only the best are shuffled."""
    plan = final_plan(QUERIES["filter_relevance"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("WindowGroupLimit") // 2 == 1


def test_chunking_does_not_shuffle(spark, tmp_path):
    from contextmill.operators.chunking import CHUNKERS

    rows = [(1, "s", "a. b."), (2, "s", "c")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for chunker in CHUNKERS.values():
        assert "Exchange" not in final_plan(chunker(docs))


def test_scores_are_aggregated_before_the_shuffle(spark):
    plan = final_plan(QUERIES["score_stats"](spark, SMALL))
    assert "partial_stddev_pop" in plan and plan.count("Exchange hashpartitioning") == 1
