"""How the given tables stand in for a retrieval corpus and its evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextmill.operators import chunking
from contextmill.operators.evaluation import offline_replies
from contextmill.operators.models import hashed_embedder
from contextmill.operators.relevance import score_replies
from contextmill.operators.retrieval import attach
from contextmill.session import materialise
from contextmill.sources.collections import among
from contextmill.sources.corpus import assemble_pages, read_table, scan_documents

DIM = 64
TOP = 5
# The offline embedder counts words, so its similarities differ from a model's.
OFFLINE_THRESHOLD = 0.4


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(read_table(spark, folder, "documents"))


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role", "text"
    )


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item with the vector of the same id."""
    items = read_table(spark, folder, "benchmark")
    vectors = read_table(spark, folder, "embeddings")
    return items.join(vectors, items.item_id == vectors.vec_id).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("user_input"), "embedding",
        F.col("label").alias("question_label"),
    )


def vector_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def vector_replies(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    """Stand-in replies for vector hits: the base reply follows the similarity, the
    reflection call fails within the question's own label, and the critic cannot
    read label 0."""
    labels = vector_corpus(spark, folder).select("chunk_id", "label")
    questions = vector_questions(spark, folder).select("query_id", "question_label")

    def replies(hits: DataFrame) -> DataFrame:
        base = (1 + F.col("sim")) / 2
        critic = F.pmod(F.col("chunk_id") * 37, F.lit(101)) / F.lit(100.0)
        return (
            attach(hits, labels)
            .join(questions, "query_id")
            .withColumn("base_reply", base.cast("string"))
            .withColumn("reflect_reply", F.when(F.col("label") != F.col("question_label"), (base * base).cast("string")))
            .withColumn("critic_reply", F.when(F.col("label") == 0, "n/a").otherwise(
                F.concat(F.lit(" "), critic.cast("string"), F.lit("\n"))))
            .drop("label", "question_label")
        )

    return replies


def vector_scores(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    replies = vector_replies(spark, folder)
    return lambda hits: score_replies(replies(hits))


def event_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Raw replies of every kind, one per event: numbers in and out of range, text
    in place of a number, failed calls, and number forms a plain parser rejects."""
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    reply = (
        F.when(kind == "click", F.concat(F.lit(" \t"), (F.col("value") / 100).cast("string"), F.lit("\n")))
        .when(kind == "view", F.col("props"))
        .when(kind == "purchase", F.concat(F.lit("-"), value))
        .when(kind == "signup", F.concat(value, F.lit("d")))
    )
    events = read_table(spark, folder, "events")
    return events.select("event_id", "user_id", "event_type", "value", reply.alias("reply"))


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A long candidate list per user, scored from the event replies.

    Written once, as replies of a model would be, since several passes read it.
    """
    scored = score_replies(
        event_replies(spark, folder).select(
            F.col("user_id").alias("query_id"),
            F.col("event_id").alias("chunk_id"),
            F.col("event_id").alias("rank"),
            F.col("reply").alias("base_reply"),
            F.lit(None).cast("string").alias("reflect_reply"),
            (F.col("value") / (F.col("value") + 50)).cast("string").alias("critic_reply"),
        )
    )
    return materialise(scored, "scores")


def text_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn is a question; the assistant's turns up to the next one answer it."""
    so_far = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    asks = (F.col("role") == "user").cast("int")
    turns = conversation_pages(spark, folder).withColumn("asked", F.sum(asks).over(so_far))
    opening = F.max(F.when(F.col("role") == "user", F.col("page_no"))).over(so_far)
    turns = turns.withColumn("query_id", F.concat_ws("-", "doc_id", opening)).filter("asked > 0")
    asked = turns.filter("role = 'user'").select("query_id", F.col("doc_id").alias("conv_id"), F.col("text").alias("user_input"))
    said = turns.filter("role = 'assistant'").select(F.col("query_id").alias("doc_id"), "page_no", "text")
    answered = assemble_pages(said).select(F.col("doc_id").alias("query_id"), F.col("text").alias("response"))
    return asked.join(answered, "query_id", "left").withColumn("response", F.coalesce("response", F.lit("")))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Known answers: the document with the conversation's id, where it is labelled."""
    labelled = read_table(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"))
    asked = conversation_pages(spark, folder).filter("role = 'user'").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("user_input"))
    asked = asked.join(labelled, "conv_id", "left_semi")
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("reference"))
    return asked.join(among(texts, asked, ["conv_id"]), "conv_id").select("user_input", "reference")


def embedded(questions: DataFrame) -> DataFrame:
    return questions.withColumn("embedding", hashed_embedder(DIM)(F.col("user_input")))


def offline_semantic(docs: DataFrame) -> DataFrame:
    return chunking.semantic_chunks(docs, hashed_embedder(DIM), DIM, OFFLINE_THRESHOLD)


def offline_scores(candidates: DataFrame) -> DataFrame:
    return score_replies(offline_replies(candidates))
