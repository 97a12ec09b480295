"""Reading documents and putting pages together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions.text import strip
from contextmill.session import materialise


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_page_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Extracted page text, one file per document, pages divided by form feeds.

    Not recursive. The file name becomes the source.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "false")
        .text(folder, wholetext=True)
        .withColumn("source", F.col("_metadata.file_name"))
    )
    pages = F.posexplode(F.split("value", "\f")).alias("page_no", "text")
    return files.select(F.col("source").alias("doc_id"), "source", pages)


def read_large_page_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """The same pages as ``read_page_files`` of files that are larger than a row, or than a task should read.

    Spark cuts a file into byte ranges and starts each at the first form feed in it, so only a page has to fit
    a row. Pages are counted per range; a page's number is its place there and the pages of the ranges before. A
    byte order mark at the beginning of a file is left out.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "false"}
    pages = spark.read.options(**options).option("lineSep", "\f").text(folder)
    where = {"name": "file_name", "path": "file_path", "size": "file_size", "range": "file_block_start"}
    pages = pages.select("value", *[F.col(f"_metadata.{field}").alias(name) for name, field in where.items()])
    placed = materialise(_placed(pages), "pages")
    ranges = placed.groupBy("path", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("path", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = placed.join(before, ["path", "range"]).select(
        F.col("name").alias("doc_id"), F.col("name").alias("source"),
        (F.col("before") + F.col("at")).cast("int").alias("page_no"), F.col("value").alias("text"))
    # A form feed that ends the file has an empty page behind it, and an empty file is an empty page.
    files = spark.read.format("binaryFile").options(**options).load(folder).select(
        F.col("path").alias("whole"), F.element_at(F.split("path", "/"), -1).alias("doc_id"), "length")
    totals = placed.groupBy(F.col("name").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    last = files.join(totals, "doc_id", "left").filter(F.col("n").isNull() | (F.col("bytes") == F.col("size")))
    last = last.select("doc_id", F.col("doc_id").alias("source"), F.coalesce("n", F.lit(0)).cast("int").alias("page_no"), F.lit("").alias("text"))
    return numbered.unionByName(last)


def _placed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``at``, the place of each in its range of its file, counted as the task reads them."""
    import pyarrow as pa

    def count(batches):
        now, n = None, 0
        for batch in batches:
            at = []
            for key in zip(batch.column("path").to_pylist(), batch.column("range").to_pylist()):
                if key != now:
                    now, n = key, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return pages.mapInArrow(count, T.StructType([*pages.schema.fields, T.StructField("at", T.LongType())]))


def non_empty(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length("text") > 0)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Stripped documents with their source; empty ones are dropped."""
    return non_empty(docs.select("doc_id", "source", strip(F.col("text")).alias("text")))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One document per ``doc_id``: its non-empty pages in order, joined by newlines.

    Empty pages go before the shuffle. A document is one row of the result, so the
    pages gathered for it are bounded by what a row can hold; for documents beyond
    that there is ``assemble_parts``.
    """
    kept = [c for c in ("doc_id", "source") if c in pages.columns]
    joined = non_empty(pages).groupBy(*kept).agg(strip(_in_order()).alias("text"), F.count(F.lit(1)).alias("pages"))
    return non_empty(joined)


def assemble_parts(pages: DataFrame, pages_per_part: int = 10_000) -> DataFrame:
    """Documents too long for one row, as numbered parts of neighbouring pages.

    No group is larger than ``pages_per_part``. The parts of a document joined by
    newlines and stripped are the text ``assemble_pages`` would give.
    """
    kept = [c for c in ("doc_id", "source") if c in pages.columns]
    part = F.floor(F.col("page_no") / pages_per_part).cast("long")
    return non_empty(pages).groupBy(*kept, part.alias("part")).agg(
        _in_order().alias("text"), F.count(F.lit(1)).alias("pages")
    )


def _in_order() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
