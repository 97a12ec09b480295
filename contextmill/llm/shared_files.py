"""Files of our own formats in the folder that all executors share.

Tasks write through pyarrow's file systems (local, HDFS, S3, GCS by the folder's address). Each
attempt writes files of its own names, and only the names that a finished task hands on count, so
a task that is run again leaves at most files that nobody reads.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def make_folder(spark: SparkSession, folder: str) -> str:
    """The folder, made by the driver; its address with a scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return files.makeQualified(path).toString().replace("file:/", "file:///", 1) if files.getScheme() == "file" else folder


def write_file(folder: str, stem: str, suffix: str, pieces: list[bytes]) -> str:
    """Write a file under a fresh name and return the name."""
    name = f"{stem}-{uuid.uuid4().hex}.{suffix}"
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        for piece in pieces:
            out.write(piece)
    return name


def read_file(folder: str, name: str) -> bytes:
    """A whole file, opened by the task that asks for it."""
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{name}") as file:
        return file.read()


#: Tasks that a manifest is dealt out to, at most.
_MOST_TASKS = 20_000


def dealt(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest over as many tasks as it has files, or four files a task and more of very many.

    Only names move: tasks open the files themselves, so no content is shuffled.
    """
    files = manifest.count()
    return manifest.repartition(max(1, min(files, max(200, -(-files // 4)), _MOST_TASKS)))


def of_files(read: DataFrame) -> DataFrame:
    """What tasks have read from files that Spark knows the names of only.

    It would take the size of the names for that of the content, and broadcast it in a join.
    """
    return read.hint("merge")
