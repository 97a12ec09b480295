"""Replies of models, kept by a digest of model and prompt, so that no prompt is paid for twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.operators.models import in_window
from contextmill.session import materialise, shared_uri


class ReplyStore:
    """A folder of replies of one model.

    ``connect`` gives the function that answers a prompt, or a list of ``batch`` prompts. Tasks write replies
    while they ask, ``flush`` at a time and whatever they have when they fail, to files of their own below
    ``path``, which all executors share; a task that is run again reads what its earlier attempt has left.
    So a prompt is asked once, over tasks, jobs and sessions, unless its executor is lost before it could
    write: at most ``flush`` replies and the calls under way. Failed calls (None) are not kept, and are made again
    by the next run.
    """

    def __init__(self, path: str, model: str, connect: Callable[[], Callable], kind: str = "string", batch: int | None = None,
                 window: int = 1, attempts: int = 1, wait: float = 0.5, flush: int = 100):
        self.path, self.model, self.connect, self.kind = path, model, connect, kind
        self.batch, self.window, self.attempts, self.wait, self.flush = batch, window, attempts, wait, flush

    def digest(self, prompt: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}"), prompt), 256))

    def read(self, spark: SparkSession) -> DataFrame:
        """(digest, reply), one row per digest, also where two attempts of a task have answered."""
        shared_uri(spark, self.path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Every run has a folder of its own: Spark takes two reads of one folder for the same, whatever is in it.
        runs = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("run-"))
        kind = f"digest binary, reply {self.kind}"
        if not runs:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*runs).groupBy("digest").agg(F.min("reply").alias("reply"))

    def ask(self, rows: DataFrame, prompt: Column, name: str) -> DataFrame:
        """``rows`` with the reply to each prompt as column ``name``; NULL for NULL prompts and failed calls.

        Only distinct prompts that the store does not have are asked. ``rows`` are read twice, so they
        should be a written table or cheap, and always the same.
        """
        spark = rows.sparkSession
        keyed = rows.withColumn("__digest", self.digest(prompt))
        wanted = keyed.filter("__digest is not null").groupBy(F.col("__digest").alias("digest")).agg(F.first(prompt).alias("prompt"))
        unseen = wanted.join(self.read(spark).select("digest"), "digest", "left_anti")
        # Written first, so that every attempt of a task has the same prompts.
        unseen = materialise(unseen.repartition(spark.sparkContext.defaultParallelism), "prompts")
        self._answer(unseen)
        found = self.read(spark).select(F.col("digest").alias("__digest"), F.col("reply").alias(name))
        return keyed.drop(*([name] if name in rows.columns else [])).join(found, "__digest", "left").drop("__digest")

    def _answer(self, unseen: DataFrame) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        folder = shared_uri(unseen.sparkSession, f"{self.path.rstrip('/')}/run-{uuid.uuid4().hex}")
        schema = to_arrow_schema(unseen.sparkSession.createDataFrame([], f"digest binary, reply {self.kind}").schema)
        connect, batch, window, attempts, wait, flush = self.connect, self.batch, self.window, self.attempts, self.wait, self.flush

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = fs.FileSystem.from_uri(folder)
            own = f"{TaskContext.get().partitionId()}-"
            there = system.get_file_info(fs.FileSelector(base))
            mine = [f.path for f in there if f.base_name.startswith(own)]
            done = {d for f in mine for d in pq.read_table(system.open_input_file(f), columns=["digest"]).column(0).to_pylist()}
            left = (
                (digest, prompt)
                for b in batches for digest, prompt in zip(b.column("digest").to_pylist(), b.column("prompt").to_pylist())
                if digest not in done
            )
            held: list[tuple] = []

            def write() -> None:
                if not held:
                    return
                digests, replies = zip(*held)
                table = pa.Table.from_arrays([pa.array(digests, schema.field(0).type), pa.array(replies, schema.field(1).type)], schema=schema)
                name = f"{own}{uuid.uuid4().hex}.parquet"
                # A name that Spark does not read, until the file is whole.
                with system.open_output_stream(f"{base}/_{name}") as out:
                    pq.write_table(table, out)
                system.move(f"{base}/_{name}", f"{base}/{name}")
                held.clear()

            groups = iter(lambda: list(islice(left, batch or 1)), [])

            def client():
                call = connect()
                return lambda group: call([p for _, p in group]) if batch else [call(group[0][1])]

            n = 0
            try:
                for group, replies in in_window(groups, client, window, attempts, wait):
                    if replies is not None:
                        held.extend((d, r) for (d, _), r in zip(group, replies) if r is not None)
                    n += len(group)
                    if len(held) >= flush:
                        write()
            finally:
                write()
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

        unseen.select("digest", "prompt").mapInArrow(work, "n bigint").agg(F.sum("n")).collect()
