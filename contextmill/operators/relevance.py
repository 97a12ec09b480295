"""Three-stage relevance scores, a data-dependent threshold and its fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextmill.functions.numbers import clamp01, parse_reply, round_score
from contextmill.operators import models
from contextmill.operators.replies import ReplyStore
from contextmill.session import materialise

# Stage weights, base fallback, variance limit, minimum chunk count.
WEIGHTS = {"base": 0.3, "reflect": 0.3, "critic": 0.4}
BASE_FALLBACK = 0.5
LOW_VARIANCE = 0.01
MIN_CHUNKS = 3


def combine(base: Column, reflect: Column, critic: Column) -> Column:
    total = WEIGHTS["base"] * base + WEIGHTS["reflect"] * reflect + WEIGHTS["critic"] * critic
    return round_score(total)


def score_replies(replies: DataFrame) -> DataFrame:
    """Scores from the raw replies of the three stages.

    Reads ``base_reply``, ``reflect_reply`` and ``critic_reply``; a bad reply falls
    back to the stage before it. Adds ``scores`` and ``final_score``.
    """
    return (
        replies.withColumn("base", parse_reply(F.col("base_reply"), F.lit(BASE_FALLBACK)))
        .withColumn("reflect", parse_reply(F.col("reflect_reply"), F.col("base")))
        .withColumn("critic", parse_reply(F.col("critic_reply"), F.col("reflect")))
        .withColumn("final_score", combine(F.col("base"), F.col("reflect"), F.col("critic")))
        .withColumn("scores", F.struct("base", "reflect", "critic", F.col("final_score").alias("final")))
        .drop("base", "reflect", "critic", "base_reply", "reflect_reply", "critic_reply")
    )


def score_with_model(candidates: DataFrame, ask, keep: bool = True, texts: bool = True) -> DataFrame:
    """Score ``candidates(text, user_input, ...)`` by three prompts per row.

    ``ask`` turns a prompt column into a reply column, or is a ``ReplyStore``, which asks each distinct prompt
    once and goes on where an earlier run has stopped. With ``keep`` the replies are
    written once, so a lost executor does not ask the model again. Without ``texts`` those two columns are
    left out of what is written and returned.
    """
    chunk, question = F.col("text"), F.col("user_input")
    if isinstance(ask, ReplyStore):
        candidates = materialise(candidates, "candidates")
    asked = models.with_reply(candidates, ask, models.base_prompt(chunk, question), "base_reply")
    base = parse_reply(F.col("base_reply"), F.lit(BASE_FALLBACK))
    asked = models.with_reply(asked, ask, models.reflect_prompt(chunk, question, base), "reflect_reply")
    reflect = parse_reply(F.col("reflect_reply"), base)
    asked = models.with_reply(asked, ask, models.critic_prompt(chunk, question, reflect), "critic_reply")
    asked = asked if texts else asked.drop("text", "user_input")
    return score_replies(materialise(asked, "replies") if keep else asked)


def threshold(mean: Column, std: Column, var: Column, epsilon: float = LOW_VARIANCE) -> Column:
    """Mean plus deviation for tight scores, else the mean; within [0, 1]."""
    return round_score(clamp01(F.when(var < epsilon, mean + std).otherwise(mean)))


def score_stats(scored: DataFrame) -> DataFrame:
    """Count, mean, population deviation and variance of each question's scores."""
    return scored.groupBy("query_id").agg(
        F.count("final_score").alias("candidates"),
        F.avg("final_score").alias("mean"),
        F.stddev_pop("final_score").alias("std"),
        F.var_pop("final_score").alias("var"),
    )


def judge(scored: DataFrame, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """All candidates with threshold, verdict and ``position`` in the filtered list.

    Chunks at or above their question's threshold are kept in retrieval order. Where
    fewer than ``min_chunks`` pass, the best ``min_chunks`` by score replace them,
    best first. ``position`` is NULL for a chunk that is not kept.

    For ranked retrieval results: a question's candidates are a short list, so every
    step is a window over one exchange by question. Use ``filter_long_lists`` for
    candidate lists without a bound.
    """
    question = Window.partitionBy("query_id")
    by_score = question.orderBy(F.desc("final_score"), "rank")
    by_place = question.orderBy(F.desc("kept"), "place", "rank")
    mean, std, var = (f("final_score").over(question) for f in (F.avg, F.stddev_pop, F.var_pop))
    return (
        scored.withColumn("threshold", threshold(mean, std, var))
        .withColumn("passed", F.col("final_score") >= F.col("threshold"))
        .withColumn("fallback", F.count_if("passed").over(question) < min_chunks)
        .withColumn("score_rank", F.row_number().over(by_score))
        .withColumn("kept", F.when(F.col("fallback"), F.col("score_rank") <= min_chunks).otherwise(F.col("passed")))
        .withColumn("place", F.when(F.col("fallback"), F.col("score_rank")).otherwise(F.col("rank")))
        .withColumn("position", F.when(F.col("kept"), F.row_number().over(by_place)))
        .drop("place", "score_rank", "kept")
    )


def filter_by_relevance(scored: DataFrame, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """The kept chunks of ``judge``, ``position`` giving their order."""
    return judge(scored, min_chunks).filter(F.col("position").isNotNull())


def audit(scored: DataFrame, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """Per question: candidates, passes, threshold, score spread, fallback fired.

    For candidate lists of any length. Both passes pre-aggregate, so a question with
    very many candidates sends one row per task. The statistics, one row per question,
    are written in between: their size is then known, and the planner broadcasts them
    if they are small instead of moving the candidates.
    """
    limit = threshold(F.col("mean"), F.col("std"), F.col("var"))
    stats = materialise(score_stats(scored).withColumn("threshold", limit), "score-stats")
    passes = (
        scored.join(stats.select("query_id", "threshold"), "query_id")
        .groupBy("query_id")
        .agg(F.count_if(F.col("final_score") >= F.col("threshold")).alias("passed"))
    )
    return stats.join(passes, "query_id").withColumn("fallback", F.col("passed") < min_chunks)


def filter_long_lists(scored: DataFrame, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """The same result as ``filter_by_relevance`` without gathering a whole list.

    A question may hold any share of the rows: the candidates are joined with one
    written row per question, and the fallback keeps ``min_chunks`` rows per task
    before its shuffle. Adds ``order_key``, which sorts a question's kept rows, in
    place of ``position``.
    """
    verdict = materialise(audit(scored, min_chunks).select("query_id", "threshold", "fallback"), "verdicts")
    judged = scored.join(verdict, "query_id")
    passing = judged.filter(~F.col("fallback") & (F.col("final_score") >= F.col("threshold"))).withColumn(
        "order_key", F.col("rank").cast("long")
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    best = (
        judged.filter("fallback")
        .withColumn("order_key", F.row_number().over(by_score).cast("long"))
        .filter(F.col("order_key") <= min_chunks)
    )
    return passing.unionByName(best)
