"""Exact duplicates by content-defined chunk recipes.

Each text is cut where its own content says so, every distinct chunk gets a verified
identifier, and texts are equal when their ordered identifier lists are. A long document's
text moves once, as chunks that tasks have already deduplicated; the comparison itself moves
only identifiers. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.session import materialise

WHITESPACE = r"[\x20\x09-\x0D]+"
#: Fewest and most characters of a chunk; the last one of a text may be shorter.
CHUNK_CHARS = (1024, 8192)
#: A chunk may end after a space that follows these letters: about one word in thirty. Text
#: without such words is cut at the largest size, which is as deterministic.
ANCHOR = r"(?<=[a-h][n-t] )"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; NULL is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def chunks(text: Column, sizes: tuple[int, int] = CHUNK_CHARS) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    least, most = sizes
    pattern = rf"(?s).{{{least},{most}}}?{ANCHOR}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def short_identifier(chunk: Column) -> Column:
    """128 bits from two differently seeded hashes."""
    return F.concat_ws(":", F.xxhash64(chunk), F.xxhash64(F.lit(7), chunk))


def long_identifier(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def verified_identifier(
    docs: DataFrame, text: str = "text", identifier: Callable[[Column], Column] = short_identifier
) -> Callable[[Column], Column]:
    """The given identifier if no two different chunks share one, else SHA-256.

    Every distinct chunk is compared: chunks are deduplicated with their identifiers in each
    task and then once over the network, and identifiers that remain with two texts are counted.
    """
    piece = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    distinct = piece.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return long_identifier if shared.limit(1).count() else identifier


def recipes(docs: DataFrame, key: str, text: str, identifier: Callable[[Column], Column]) -> DataFrame:
    """One narrow row per document row: ``key``, ``row`` (a row number), digest and recipe."""
    norm = normalised(F.col(text))
    return docs.select(
        F.col(key).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.transform(chunks(norm), identifier).alias("recipe"),
    )


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    identifier: Callable[[Column], Column] = short_identifier,
) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256, row.

    The row with the smallest key of equal texts stays; a NULL key is larger than any other,
    and of repeated rows with that key exactly one stays. NULL and empty texts are equal. A
    text of any length is cut into chunks of bounded size. An empty table gives no rows; other
    columns of ``docs`` are not read. ``row`` numbers the rows as ``docs`` yields them.
    """
    identifier = verified_identifier(docs, text, identifier)
    base = materialise(recipes(docs, key, text, identifier), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    groups = base.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written, so that the join has shuffles of its own, in which Spark can split a hot recipe.
    found = base.join(materialise(groups, "groups"), "recipe", "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    ``docs`` must yield its rows in the same partitions each time, as a written table does.
    """
    gone = materialise(exact_duplicates(docs, key, text).filter("not kept").select("row"), "duplicates")
    mark = "__contextmill_row"
    numbered = docs.withColumn(mark, F.monotonically_increasing_id())
    return numbered.join(gone.withColumnRenamed("row", mark), mark, "left_anti").drop(mark)
