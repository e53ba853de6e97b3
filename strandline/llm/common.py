"""Helpers that the operators share: tables in the shared folder, files that executors write, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place below the cluster's ``spark.checkpoint.dir``, as a URI. Only a local master may fall back
    to a temporary folder: elsewhere executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-strandline-")
    # A path without a scheme is one of the cluster's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    base = re.sub("^file:/+", "file:///", base)
    return f"{base.rstrip('/')}/strandline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage, and survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """A small table of files or parts, a row to a task. ``by`` numbers the rows; the count of rows is that of tasks."""
    return df.repartitionByRange(max(1, df.count()), by)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def finish(system: fs.FileSystem, temporary: str, path: str) -> None:
    """A file appears under its name only when it is whole; a second attempt writes the same bytes."""
    system.move(temporary, path)


def attempt_name(path: str) -> str:
    return f"{path}.{uuid.uuid4().hex}.tmp"


def input_file(uri: str) -> pa.NativeFile:
    """A file for reading; mapped into memory where it is local."""
    system, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut where the texts of ``column`` exceed ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        start = total = 0
        for i, value in enumerate(pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()):
            if total and total + value > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += value
        if batch.num_rows > start:
            yield batch.slice(start)


def words_only(text: str) -> list[bytes]:
    """Maximal runs of other characters than space and the control characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split()

