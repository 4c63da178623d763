"""Batches that are added to a dated Parquet folder once, whoever writes them and wherever a writer dies.

Rows are staged beside the data, in a folder that readers skip. A plan of the renames, complete when it appears, claims
the batch: who comes second finds it and drops its own stage. Only then are files renamed into place, under names of
the batch, and the plan is marked done. A writer that died before its claim left nothing that counts; one that died
after it is finished by whoever commits next.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class _Store:
    """A folder on any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self.plain = spark.sparkContext._gateway.new_array(kind, 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def files(self, folder: str, end: str = ".parquet") -> list[str]:
        """Names of all files below a folder, from there."""
        base, found = self.fs.makeQualified(self.path(folder)).toString().rstrip("/") + "/", []
        every = self.fs.listFiles(self.path(folder), True)
        while every.hasNext():
            found.append(every.next().getPath().toString().removeprefix(base))
        return sorted(f for f in found if f.endswith(end))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def claim(self, name: str, to: str) -> bool:
        """A rename that fails where there is something already."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(name)), self.fs.makeQualified(self.path(to)), self.plain)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def move(self, name: str, to: str) -> None:
        """A rename that somebody else may make meanwhile."""
        if self.exists(name):
            self.fs.mkdirs(self.path(to).getParent())
            if self.fs.rename(self.path(name), self.path(to)):
                return
        if not self.exists(to):
            raise OSError(f"{name} is gone and {to} is not there")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def stage(rows: DataFrame, root: str, batch: str, by: str = "date") -> str:
    """Writes a batch's rows where no reader sees them; gives the stage's name."""
    name = f"_staged/{batch}-{uuid.uuid4().hex}"
    rows.write.partitionBy(by).parquet(f"{root.rstrip('/')}/{name}")
    return name


def claim(spark: SparkSession, root: str, batch: str, staged: str) -> bool:
    """Whether this stage is the batch from now on; if another is, it goes."""
    store = _Store(spark, root)
    files = store.files(staged)
    moves = [[f"{staged}/{f}", f"{f.rpartition('/')[0]}/{batch}-{k:05d}.parquet"] for k, f in enumerate(files)]
    plan = f"_ledger/{batch}.{uuid.uuid4().hex}.tmp"
    store.write(plan, json.dumps({"staged": staged, "moves": moves}))
    if not store.exists(f"_ledger/{batch}.done") and store.claim(plan, f"_ledger/{batch}.todo"):
        return True
    store.delete(plan)
    store.delete(staged)
    return False


def publish(spark: SparkSession, root: str) -> list[str]:
    """Finishes every batch that is claimed; gives their names."""
    store = _Store(spark, root)
    found = [n.removesuffix(".todo") for n in store.names("_ledger") if n.endswith(".todo")]
    for batch in found:
        plan = json.loads(store.read(f"_ledger/{batch}.todo"))
        for name, to in plan["moves"]:
            store.move(name, to)
        store.move(f"_ledger/{batch}.todo", f"_ledger/{batch}.done")
        store.delete(plan["staged"])
    return found


def committed(spark: SparkSession, root: str, batch: str) -> bool:
    return _Store(spark, root).exists(f"_ledger/{batch}.done")


def commit_batch(rows: DataFrame, root: str, batch: str, by: str = "date") -> bool:
    """Adds the rows under this batch's name unless that was done before; whether it was done now."""
    spark = rows.sparkSession
    publish(spark, root)
    if committed(spark, root, batch):
        return False
    own = claim(spark, root, batch, stage(rows, root, batch, by))
    publish(spark, root)
    return own
