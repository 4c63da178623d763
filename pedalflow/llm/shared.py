"""Tables, the shared folder and small helpers that all training-data operators use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside these.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to Python; a worker holds two or three at a time. Spark's own 64 MB are too many where
#: several workers share a small executor.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def limit_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session sets its own."""
    key, usual, ours = BATCH_BYTES
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, ours)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside others in one executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, *args) -> Callable:
    """A function over a task's Arrow batches, with these further arguments, that releases its memory at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, *args)
        finally:
            release()

    return task


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, unless PYTHONPATH already leads their workers to it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if getattr(context, "_pedalflow_sent", False) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="pedalflow-")  # the driver's own, from which Spark serves it
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "pedalflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "pedalflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._pedalflow_sent = True


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    limit_batches(spark)


def vocabulary(path: str) -> str:
    """A vocabulary file by its path, or a public one by its bare name, which each machine resolves for itself."""
    if os.path.basename(path) != path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def others(columns: list[str], *names: str) -> list[str]:
    """Columns that are called like none of these names, in any spelling of case: Spark can't tell such columns apart."""
    taken = {x.lower() for x in names}
    return [c for c in columns if c.lower() not in taken]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session, where one machine holds everything, may go without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pedalflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/pedalflow/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Whether Spark deletes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: its lineage ends there, and a lost executor
    loses nothing. The shuffle files of the query that wrote it go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(schema).parquet(path)
    table._written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes materialised tables that no plan reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table._written_to)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, as the cluster sets it for its data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo the number of folds; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))
