"""Vector collections: one Parquet table, partitioned by chunker."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions.vectors import has_dimension
from contextmill.session import materialise

# Fixed value: the size of vectors from the large embedding model.
INDEX_DIM = 3072


def checked(points: DataFrame, dim: int) -> DataFrame:
    """The points; the job fails on the first vector without the declared size."""
    message = F.concat(F.lit(f"not a vector of {dim} numbers: chunk "), F.col("chunk_id").cast("string"))
    vector = F.when(has_dimension(F.col("embedding"), dim), F.col("embedding")).otherwise(
        F.raise_error(message).cast("array<float>")
    )
    return points.withColumn("embedding", vector)


def vector_report(points: DataFrame, dim: int, keys: list[str]) -> DataFrame:
    """Per group: vectors, usable ones, and the range of sizes."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(has_dimension(F.col("embedding"), dim)).alias("valid"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    )


def recreate(points: DataFrame, path: str, dim: int, chunkers: Iterable[str]) -> None:
    """Replace the collections of ``chunkers``; others stay.

    The new ones are written aside and put in place of the old ones when they are whole, so that a write that
    fails leaves the old ones as they were. One whose chunker gives no points is gone. ``points``
    may read from ``path``, and hold other chunkers' points, which are left out. If putting one in place fails, the
    folders that were replaced are put back. Readers must not be at work meanwhile.
    """
    spark = points.sparkSession
    named = sorted(set(chunkers))
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    # Names that begin with an underscore are not read.
    turn = uuid.uuid4().hex
    new, old = (jvm.Path(folder, f"_{kind}-{turn}") for kind in ("new", "old"))

    def parts(where) -> dict[str, object]:
        if not files.exists(where):
            return {}
        found = [f.getPath() for f in files.listStatus(where)]
        return {unquote(p.getName().removeprefix("chunker=")): p for p in found if p.getName().startswith("chunker=")}

    moved: list[tuple] = []

    def move(source, target) -> None:
        if not files.rename(source, target):
            raise OSError(f"could not move {source} to {target}")
        moved.append((source, target))

    try:
        wanted = points.filter(F.col("chunker").isin(named))
        checked(wanted, dim).write.partitionBy("chunker").option("compression", "zstd").parquet(new.toString())
        made, there = parts(new), parts(folder)
        files.mkdirs(old)
        for chunker in named:
            if chunker in there:
                move(there[chunker], jvm.Path(old, there[chunker].getName()))
            if chunker in made:
                move(made[chunker], jvm.Path(folder, made[chunker].getName()))
    except BaseException:
        for source, target in reversed(moved):
            files.rename(target, source)
        raise
    finally:
        files.delete(new, True)
        files.delete(old, True)


def upload(points: DataFrame, path: str, dim: int) -> None:
    """Add points to their collections, whatever is there: ``missing`` tells what is not."""
    checked(points, dim).write.mode("append").partitionBy("chunker").option("compression", "zstd").parquet(path)


def read_collection(spark: SparkSession, path: str, chunker: str | None = None) -> DataFrame:
    """All collections, or one by its chunker; then only its folder is read."""
    points = spark.read.parquet(path)
    return points if chunker is None else points.filter(_is(chunker))


def _is(chunker: str) -> Column:
    return F.col("chunker") == chunker


#: Most bits of a Bloom filter, 16 MB on each executor, what it has an id at least where that is less, and its hashes.
FILTER_BITS, FILTER_SHARE, FILTER_HASHES = 1 << 27, 16, 3


def missing(rows: DataFrame, path: str, bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows(chunker, chunk_id, ...)`` that the collections in ``path`` do not have, each id once.

    The ids of a collection may be very many more than those of ``rows``. A Bloom filter of the latter goes over
    them where they are read, so that about only those are shuffled that both have, and an anti-join
    decides. The filter has 16 to 32 bits an id and at most ``bits``; of more ids than it is made for it lets more of the collection
    pass, and the result is the same. Of rows with one id any one stays; ``rows`` are read
    three times, so they should be a written table.
    """
    keys = ["chunker", "chunk_id"]
    once = rows.dropDuplicates(keys)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any(f.getPath().getName().startswith("chunker=") for f in files.listStatus(folder)):
        return once
    there = read_collection(spark, path).select(*keys)
    wanted = rows.select(*keys).distinct()
    known = materialise(there.filter(_in_filter(wanted, keys, bits)).distinct(), "known-ids")
    return once.join(known, keys, "left_anti")


def among(rows: DataFrame, ids: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows`` whose keys are among ``ids``, and by chance a few more: a Bloom filter where they are read.

    For wide rows that a join with few ids follows, which then shuffles little else. ``ids`` are read at once.
    """
    return rows.filter(_in_filter(ids.select(*keys).distinct(), keys, bits))


def _places(keys: list[str], bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(FILTER_HASHES)])


def _in_filter(ids: DataFrame, keys: list[str], bits: int) -> Column:
    """Whether a row's keys can be among ``ids``: a Bloom filter, made of one aggregation."""
    bits = min(bits, 1 << max(12, (FILTER_SHARE * ids.count()).bit_length()))
    spread = ids.select(F.explode(_places(keys, bits)).alias("place"))
    one = F.lit(1).cast("long")
    words = spread.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("place").bitwiseAND(63).cast("int"))).alias("set"))
    found = words.toArrow()  # at most bits / 64 rows
    table = np.zeros(-(-bits // 64), np.uint64)
    table[np.asarray(found.column("word"))] = np.asarray(found.column("set"), np.int64).astype(np.uint64)
    held = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.BooleanType())
    def may_be_in(places: pa.Array) -> pa.Array:
        at = np.asarray(places.flatten(), np.int64).reshape(-1, FILTER_HASHES)
        hit = (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(hit.all(axis=1))

    return may_be_in(_places(keys, bits))
