"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: The library's own setting, for sessions whose cluster names no checkpoint folder.
WORK_DIR = "contextmill.workDir"
_REMOVED_AT_END: set[str] = set()


def local_session(cores: str = "8", memory: str = "16g", app: str = "contextmill") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_base(spark: SparkSession) -> str:
    """The folder below which this application writes its intermediates.

    The cluster names it in ``spark.checkpoint.dir``, or the user in
    ``contextmill.workDir``. Only a local session, whose tasks all run on this
    machine, may go without either. The folder is removed when the session's JVM ends.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(WORK_DIR, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} or {WORK_DIR} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="contextmill-")
        spark.conf.set(WORK_DIR, base)
    own = f"{base.rstrip('/')}/contextmill-{spark.sparkContext.applicationId}"
    if own not in _REMOVED_AT_END:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _REMOVED_AT_END.add(own)
    return own


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table, in the folder all executors share."""
    return f"{work_base(spark)}/{name}-{uuid.uuid4().hex}"


def shared_uri(spark: SparkSession, folder: str) -> str:
    """A folder, made if it is not there, with the scheme that other file systems need."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    whole = files.makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if re.match(r"file:/(?!/)", whole) else whole


#: Bytes of rows that go to Python at a time; a worker holds some multiples of them, whatever its task has.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send at most ``BATCH_BYTES`` at a time to Python, unless the session's owner chose a size."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) in ("64MB", "67108864b"):
        spark.conf.set(setting, str(BATCH_BYTES))


#: Paths of the tables that each ``temporary`` block under way has written.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("contextmill-tables", default=())
#: Whether Spark deletes the shuffle files of a job when it is done, and not when the driver's memory is tidied.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes in this block are deleted at its end, but for those that ``outlive`` it.

    Results that read such a table must be written within the block.
    """
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(before)
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in map(jvm.Path, made):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, outlive: bool = False, **options) -> DataFrame:
    """Write a table once and go on from the written copy.

    For results that must not be computed twice, such as model replies: a lost
    executor then re-reads the table instead of calling the model again. What the job has shuffled is deleted when
    the table is there. ``outlive`` leaves it to the block around the innermost ``temporary`` one, if there is
    one. ``options`` are the Parquet writer's.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, name)
    blocks = _OPEN.get()[:-1] if outlive else _OPEN.get()
    if blocks:
        blocks[-1].append(path)
    set_before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        if set_before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, set_before)
    return spark.read.schema(df.schema).parquet(path)
