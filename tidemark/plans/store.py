"""Derived tables under versions, switched by a pointer; named cursors. All through Spark's writers, so any shared store will do.

A rebuild writes every table of a new version, checks it, and only then appends a pointer row: readers see the old version whole or the new one
whole. Cursors are an append-only table whose latest row per name counts, so they outlive rebuilds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.pages import latest_per, merge_cursor

_CURSOR = "name string, seq long, at timestamp, ids array<long>"


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder where the cluster shares them; a temporary one in local mode only."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return f"{told.rstrip('/') if told else 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a shared folder: computed once, however often it is read, and still there when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def current(self) -> str | None:
        row = self._read("pointer", "seq long, version string").orderBy(F.desc("seq")).first()
        return row and row["version"]

    def publish(self, tables: dict[str, DataFrame], check=None) -> str:
        """Writes the tables as a new version; check(reader) may raise to keep the old one."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        if check is not None:
            check(lambda name: self.spark.read.parquet(f"{self.root}/versions/{version}/{name}"))
        last = self._read("pointer", "seq long, version string").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(last + 1, version)], "seq long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return version

    def table(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise LookupError("nothing has been published")
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}")

    def cursor(self, name: str) -> tuple | None:
        row = latest_per(self._read("cursors", _CURSOR), ["name"], ["seq"]).where(F.col("name") == name).first()
        return row and (row["at"], row["ids"])

    def advance(self, name: str, at, ids: list[int]) -> tuple:
        """To be called when the rows read have been delivered: at-least-once."""
        moved = merge_cursor(self.cursor(name), (at, sorted(ids)))
        seq = self._read("cursors", _CURSOR).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(name, seq, *moved)], _CURSOR).coalesce(1).write.mode("append").parquet(f"{self.root}/cursors")
        return moved
