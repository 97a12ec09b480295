import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from conftest import ROOT

from contextmill.session import CHECKPOINT_DIR, WORK_DIR, materialise, work_folder


def test_cluster_without_folder_fails():
    for master in ("yarn", "local-cluster[2,1,1024]"):
        conf = SimpleNamespace(get=lambda k, d=None: d)
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match=CHECKPOINT_DIR):
            work_folder(spark, "a")


def test_paths_are_fresh_and_below_the_named_folder(spark):
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(WORK_DIR)
    first, second = work_folder(spark, "a"), work_folder(spark, "a")
    assert first.startswith(named) and first != second


def test_materialised_table_is_read_back(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as name")
    written = materialise(df, "numbers")
    assert "FileScan" in written._jdf.queryExecution().executedPlan().toString()
    assert sorted(written.collect()) == sorted(df.collect()) and written.columns == df.columns


PLAIN = """
from contextmill.session import local_session, materialise, work_base
spark = local_session("1", "1g")
assert materialise(spark.range(5), "t").count() == 5
print("BASE", work_base(spark))
spark.stop()
"""


def test_plain_session_without_preset_options(tmp_path):
    """A real session with an empty configuration folder; its work folder goes with it."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    base = next(x.split()[1] for x in done.stdout.splitlines() if x.startswith("BASE"))
    assert not os.path.exists(base)


def test_long_texts_go_to_models_few_at_a_time(spark, setting):
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    from contextmill.operators.ingest import embed_chunks

    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[float(len(batch))]] * len(batch), pa.list_(pa.float32()))

    setting("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
    chunks = spark.range(0, 1500, 1, 1).selectExpr("id as chunk_id", "repeat('ab cd ', 2000) as text")
    largest = embed_chunks(chunks, F.arrow_udf(sizes, "array<float>")).agg(F.max(F.col("embedding")[0])).first()[0]
    assert largest < 500


def test_shuffle_files_and_temporary_tables_are_deleted(spark):
    import time
    from pathlib import Path

    from contextmill.session import temporary

    def shuffled():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in folders for f in Path(d.getAbsolutePath()).rglob("shuffle_*")}

    before = shuffled()
    with temporary(spark):
        inner = materialise(spark.range(1000).repartition(7), "inner")
        path = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
        kept = materialise(inner.groupBy((inner.id % 9).alias("k")).count(), "outer", outlive=True)
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert not path.exists()
    assert sum(r["count"] for r in kept.collect()) == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
