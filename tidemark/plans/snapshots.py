"""Reads the event table as board snapshots: board = event type, attempt = day, uid = user.

Fixed rules make the rare cases occur: on some days an attempt fails or sees few users, some records fail or are pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lifecycle import Lifecycle, replay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts_and_observations(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    base = events.select(F.col("event_type").alias("board"), day.alias("at"), F.col("event_id").cast("long").alias("pos"), F.col("user_id").alias("uid"), "value")
    name = F.concat_ws("/", "board", F.date_format("at", "yyyy-MM-dd"))
    is_error = (F.dayofmonth("at") * 7 + F.length("board")) % 11 == 0
    attempts = base.select("board", "at").distinct().select("board", name.alias("attempt_id"), "at", is_error.alias("is_error"), F.date_format("at", "yyyy-MM-dd").alias("run_id"))
    kept = base.where((F.dayofmonth("at") % 7 != 3) | (F.col("uid") % 5 == 0))
    status = F.when(F.col("pos") % 97 == 0, "failed").when(F.col("pos") % 89 == 0, "pending").otherwise("ok")
    version = F.sha2(F.floor(F.col("value") / 20).cast("long").cast("string"), 256)
    observations = kept.withColumn("status", status).select("board", name.alias("attempt_id"), "pos", "uid", F.when(F.col("status") == "ok", version).alias("vh"), "status")
    return attempts, observations


def event_snapshots(spark: SparkSession, sf_dir: str) -> Lifecycle:
    return replay(*attempts_and_observations(table(spark, sf_dir, "events")))
