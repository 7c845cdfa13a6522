"""The lifecycle on Structured Streaming: a file stream of observations, folded into written state by foreachBatch.

The state is the log itself, kept idempotently by row: a micro-batch appends the rows that are not known yet, also those of an attempt
whose first part an earlier batch brought; a board's attempt that is behind its watermark and of which nothing is known is reported in gaps
and never inserted. Derived tables are then the batch replay of the log, so the streaming and the batch mode agree by construction and a
test holds them against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..plans.lifecycle import events, replay
from ..plans.snapshots import attempts_and_observations
from ..plans.store import shared_folder


class LifecycleSink:
    """foreachBatch body. Appends the new rows of attempts to log/ and those of late attempts to gaps/.

    It holds no state: what is known is read from log and gaps, so a batch that is delivered again after a restart adds nothing to either,
    whichever of the two writes it had reached. Gaps are written first: a late attempt stays late, as marks only rise."""

    def __init__(self, root: str):
        self.log, self.gaps = f"{root}/log", f"{root}/gaps"

    def known(self, spark: SparkSession, schema: StructType, path: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # nothing has been written yet
            return spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_day", F.to_date("ts"))
        log, gaps = (self.known(batch.sparkSession, rows.schema, path) for path in (self.log, self.gaps))
        touched = rows.select("event_type", "_day").distinct()
        have = log.select("event_type", "_day").distinct()
        marks = have.groupBy("event_type").agg(F.max("_day").alias("_mark"))  # a row for each board
        begun = touched.join(have.withColumn("_begun", F.lit(True)), ["event_type", "_day"], "left").join(marks, "event_type", "left")
        late = begun.select(F.col("event_type").alias("_board"), F.col("_day").alias("_at"), (F.col("_begun").isNull() & F.coalesce(F.col("_day") < F.col("_mark"), F.lit(False))).alias("_late"))
        # a batch's attempts are few (a row for a board and day): sent to all tasks, so that no task gets an attempt's rows whole
        judged = rows.join(F.broadcast(late), F.col("event_type").eqNullSafe(F.col("_board")) & F.col("_day").eqNullSafe(F.col("_at")), "left").select(*rows.columns, F.coalesce("_late", F.lit(False)).alias("_late"))
        for path, held, of in ((self.gaps, gaps, F.col("_late")), (self.log, log, ~F.col("_late"))):
            near = held.join(F.broadcast(touched), ["event_type", "_day"], "left_semi").select(*[F.col(c).alias(f"_held_{c}") for c in rows.columns])
            same = [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in rows.columns]
            judged.where(of).join(near, same, "left_anti").select(rows.columns).write.mode("append").parquet(path)


def drain(spark: SparkSession, root: str, schema: StructType) -> LifecycleSink:
    """Streams what has arrived in root/in since the last call, in one batch: a new query and sink each time, as after a restart."""
    sink = LifecycleSink(root)
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sink


def replay_in_batches(spark: SparkSession, source: DataFrame, n_batches: int = 3) -> DataFrame:
    """Lets the source arrive in a few ranges of days, streams each when it is there, and returns the events of the log."""
    root = shared_folder(spark)
    for k in range(n_batches):
        source.where(F.pmod(F.floor((F.dayofmonth("ts") - 1) * n_batches / 31), F.lit(n_batches)) == k).write.mode("append").parquet(f"{root}/in")
        sink = drain(spark, root, source.schema)
    return events(replay(*attempts_and_observations(spark.read.parquet(sink.log).drop("_day"))))
