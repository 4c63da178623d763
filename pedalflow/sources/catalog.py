"""Tables of one source under a data folder, by name. Instants come out as UTC timestamps without zone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.localtime import instant
from . import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType, dated: bool = False) -> DataFrame:
    """A Parquet folder with a declared schema, pruned by its date partitions; no rows where there is no folder."""
    whole = schema.add("date", "date") if dated and "date" not in schema.names else schema
    whole = T.StructType(list(whole))
    try:
        return spark.read.schema(whole).option("recursiveFileLookup", "false").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def in_utc(df: DataFrame) -> DataFrame:
    zoned = {f.name: instant(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(zoned) if zoned else df


@dataclass
class Catalog:
    """The seven relations of one source. ``tables`` gives ready-made ones, or functions that plan them when they are
    first asked for, instead of reading them."""

    spark: SparkSession
    data_dir: str = ""
    source: str = "bikes"
    tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None

    def table(self, name: str) -> DataFrame:
        if self.tables is not None and name in self.tables:
            if callable(self.tables[name]):
                self.tables[name] = self.tables[name]()
            return self.tables[name]
        if name in schemas.SNAPSHOTS:
            return in_utc(read_table(self.spark, f"{self.data_dir}/{self.source}/{name}", T.StructType(list(schemas.SNAPSHOTS[name])), True))
        if name == "weather":
            return in_utc(read_table(self.spark, f"{self.data_dir}/weather", T.StructType(list(schemas.WEATHER)), True))
        if name == "station_areas":
            return read_table(self.spark, f"{self.data_dir}/areas/station_areas.parquet", schemas.STATION_AREAS).where(F.col("source") == self.source)
        raise KeyError(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.SNAPSHOTS or name in ("weather", "station_areas"):
            return self.table(name)
        raise AttributeError(name)

    def register(self) -> None:
        """All relations as temporary views."""
        for name in (*schemas.SNAPSHOTS, "weather", "station_areas"):
            self.table(name).createOrReplaceTempView(name)

    def between(self, name: str, first: str, last: str) -> DataFrame:
        """Rows of some local days, with a predicate on the UTC partition date that prunes files: a local day lies in
        its own UTC date and the one before."""
        from ..functions.localtime import local_date

        table, time = self.table(name), schemas.TIMES[name]
        rows = table.where(local_date(F.col(time)).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        if "date" in table.columns:
            rows = rows.where(F.col("date").between(F.date_sub(F.lit(first).cast("date"), 1), F.lit(last).cast("date")))
        return rows
