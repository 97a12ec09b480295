"""A training corpus from raw documents, in five stages.

Each stage works on all rows that the one before kept, and its result is written before the next
one begins, so a lost executor costs a stage at most its own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.llm import byte_bpe, decontamination, exact_dedup, ngram_join, toxicity
from contextmill.llm.words import small_batches
from contextmill.session import materialise

#: SQL cannot express the fitted toxicity model or the merges; tests compare with brute force.
ORACLE_SQL = None


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones does not call toxic.

    NULL and empty texts show no evidence and stay, unless the model calls texts without any toxic. NULL ids have no label.
    """
    small_batches(spark)  # for all stages: what one of them has Spark allocate stays with the executors
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of texts that are equal up to white space; NULL counts as an empty text, a NULL id as the largest."""
    return exact_dedup.drop_exact_duplicates(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word shingles of Jaccard similarity 0.8.

    Different texts without words have no shingles to compare and are all kept. A NULL id counts as the largest.
    """
    return ngram_join.drop_near_duplicates(docs, wordless_apart=True)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands; NULL and empty texts hold none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to the text again; a NULL text has none and is as an empty one."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    wanted = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__digest"))
    return byte_bpe.encode(wanted, ranks, decoded=True).select(
        "doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("__digest")).alias("lossless"))


STAGES = [
    ("toxicity", keep_civil),
    ("exact dedup", keep_one_of_equal),
    ("near dedup", keep_one_of_similar),
    ("decontamination", keep_uncontaminated),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the last one's result is not written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(out, name.replace(" ", "-"))
    return out
