"""Posting lifecycle from repeated snapshots, as window functions over the whole ordered log.

attempts: board, attempt_id, at, is_error. observations: board, attempt_id, pos, uid, vh, status, where status is ok, failed
(seen, but its record could not be read) or pending (listed, its detail not fetched yet). Rules:

- an attempt's observations are its distinct uids, the first position of each;
- an attempt is an error, or suspect_drop when it saw fewer than ratio times the last non-error attempt's, or ok;
- only an ok attempt that misses an open posting closes it, and the close is the interval (last sighting, that attempt];
- a pending row stands for the version known before it, if any; a failed one never changes a version.

Shuffles: observations go once by (board, uid); attempts, which are few, by board.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROP_RATIO = 0.5


@dataclass(frozen=True)
class Lifecycle:
    attempts: DataFrame
    rows: DataFrame

    @property
    def events(self) -> DataFrame:
        return events(self)

    @property
    def presence(self) -> DataFrame:
        return presence(self.rows)

    @property
    def postings(self) -> DataFrame:
        return postings(self.rows)


def first_seen_rows(observations: DataFrame) -> DataFrame:
    """The first occurrence of each uid in an attempt."""
    rest = [c for c in observations.columns if c not in ("board", "attempt_id", "uid")]
    return observations.groupBy("board", "attempt_id", "uid").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("board", "attempt_id", "uid", "_r.*")


def judged_attempts(attempts: DataFrame, observations: DataFrame, ratio: float = DROP_RATIO) -> DataFrame:
    """attempts with i (order in the board), n_observed (null for errors), health, and the next ok attempt after each."""
    counts = observations.groupBy("board", "attempt_id").agg(F.count("*").alias("_n"))  # one row for each uid already
    order = Window.partitionBy("board").orderBy("at", "attempt_id")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    judged = attempts.join(counts, ["board", "attempt_id"], "left")
    judged = judged.withColumn("n_observed", F.when(~F.col("is_error"), F.coalesce("_n", F.lit(0))).cast("long")).drop("_n")
    judged = judged.withColumn("i", F.row_number().over(order)).withColumn("previous_n", F.last("n_observed", True).over(before))
    dropped = F.col("n_observed") < F.lit(ratio) * F.col("previous_n")
    judged = judged.withColumn("health", F.when(F.col("is_error"), "error").when(dropped, "suspect_drop").otherwise("ok"))
    ok = F.when(F.col("health") == "ok", F.struct("i", "at", "attempt_id"))
    return judged.withColumn("next_ok", F.first(ok, True).over(after))


def replay(attempts: DataFrame, observations: DataFrame, ratio: float = DROP_RATIO) -> Lifecycle:
    observations = first_seen_rows(observations)
    judged = judged_attempts(attempts, observations, ratio)
    seen = observations.join(judged.where(~F.col("is_error")).select("board", "attempt_id", "i", "at", "next_ok"), ["board", "attempt_id"])
    own = Window.partitionBy("board", "uid").orderBy("i")
    known = F.last("vh", True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = seen.withColumns({"known": known, "previous_i": F.lag("i").over(own), "next_i": F.lead("i").over(own)})
    rows = rows.withColumn("close", F.when(F.col("next_i").isNull() | (F.col("next_ok.i") < F.col("next_i")), F.col("next_ok")))
    pending = F.col("status") == "pending"
    rows = rows.withColumns({
        "vh": F.when(pending, F.col("known")).otherwise(F.col("vh")),
        "status": F.when(pending & F.col("known").isNotNull(), "ok").when(pending, "pending_detail").otherwise(F.col("status")),
    }).withColumn("previous_close", F.lag("close").over(own))
    return Lifecycle(judged, rows)


def _distinct(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def events(life: Lifecycle) -> DataFrame:
    return numbered(unnumbered(life))


def unnumbered(life: Lifecycle) -> DataFrame:
    """The events without the cost of their numbers, for whoever counts or filters them: event_id (absent), board, attempt_id, at, uid, kind, from_version, to_version, closed_after, closed_by."""
    rows = life.rows
    kind = (
        F.when(F.col("previous_i").isNull(), "opened").when(F.col("previous_close").isNotNull(), "reopened")
        .when(F.col("vh").isNotNull() & _distinct("vh", "known"), "changed")
    )
    none = F.lit(None).cast("timestamp")
    arrived = rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "board", "attempt_id", "at", "uid", "kind",
        F.when(F.col("kind") != "opened", F.col("known")).alias("from_version"), F.coalesce("vh", F.when(F.col("kind") != "opened", F.col("known"))).alias("to_version"),
        none.alias("closed_after"), none.alias("closed_by"), F.lit(0).alias("_last"), F.col("pos").alias("_pos"),
    )
    closed = rows.where(F.col("close").isNotNull()).select(
        "board", F.col("close.attempt_id").alias("attempt_id"), F.col("close.at").alias("at"), "uid", F.lit("closed").alias("kind"),
        F.coalesce("vh", "known").alias("from_version"), F.lit(None).cast("string").alias("to_version"),
        F.col("at").alias("closed_after"), F.col("close.at").alias("closed_by"), F.lit(1).alias("_last"), F.lit(None).cast("long").alias("_pos"),
    )
    return arrived.unionByName(closed)


def numbered(found: DataFrame) -> DataFrame:
    """event_id in the order of attempts (time, id) and, in each, of arrivals by position and then closes by uid.

    Ranks inside an attempt and offsets of attempts inside a day are separate windows; only the totals of days meet in one task."""
    day = F.to_date("at")
    sizes = found.groupBy(day.alias("_day"), "at", "attempt_id").agg(F.count("*").alias("_n"))
    days = sizes.groupBy("_day").agg(F.sum("_n").alias("_t"))
    days = days.select("_day", (F.sum("_t").over(Window.orderBy("_day")) - F.col("_t")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_day").orderBy("at", "attempt_id")) - F.col("_n")
    offsets = sizes.withColumn("_inside", inside).join(F.broadcast(days), "_day").select("at", "attempt_id", (F.col("_before") + F.col("_inside")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("at", "attempt_id").orderBy("_last", "_pos", "uid"))
    return found.join(offsets, ["at", "attempt_id"]).withColumn("event_id", (F.col("_offset") + rank).cast("long")).drop("_offset", "_last", "_pos")


def presence(rows: DataFrame) -> DataFrame:
    """Runs of sightings in consecutive attempts with one version and status."""
    own = Window.partitionBy("board", "uid").orderBy("i")
    goes_on = (F.lag("i").over(own) == F.col("i") - 1) & F.lag("vh").over(own).eqNullSafe(F.col("vh")) & F.lag("status").over(own).eqNullSafe(F.col("status"))
    marked = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(own)).groupBy("board", "uid", "_run").agg(
        F.min_by("attempt_id", "i").alias("first_attempt"), F.max_by("attempt_id", "i").alias("last_attempt"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count("*").alias("runs"), F.first("vh").alias("version"), F.first("status").alias("status"),
    ).drop("_run")


def postings(rows: DataFrame) -> DataFrame:
    """The state of each posting after the whole log."""
    changed = F.col("vh").isNotNull() & _distinct("vh", "known")
    last = F.max_by(F.struct(F.coalesce("vh", "known").alias("version"), "close", "at", "status"), "i")
    return rows.groupBy("board", "uid").agg(
        F.min("at").alias("first_seen_at"), last.alias("_l"), F.count_if(changed).alias("version_count"), F.count("previous_close").alias("reopen_count")
    ).select(
        "board", "uid", "first_seen_at", F.col("_l.at").alias("last_seen_at"), F.when(F.col("_l.close").isNull(), "open").otherwise("closed").alias("state"),
        F.col("_l.version").alias("current_version"), F.when(F.col("_l.close").isNotNull(), F.col("_l.at")).alias("closed_after"), F.col("_l.close.at").alias("closed_by"),
        "version_count", "reopen_count",
    )


def run_rollup(attempts: DataFrame, run: str = "run_id") -> DataFrame:
    return attempts.groupBy(run).agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"), F.count("*").alias("n_attempts"),
        F.count_if(F.col("health") == "ok").alias("n_ok"), F.count_if(F.col("health") == "error").alias("n_error"), F.count_if(F.col("health") == "suspect_drop").alias("n_suspect"),
    )


def membership(snapshots: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Slowly changing membership: (keys, added_at, removed_at) from the ordered distinct snapshots that list each key.

    removed_at is the first snapshot without the key, null while it is listed."""
    times = snapshots.select(at).distinct()
    times = times.withColumn("_i", F.row_number().over(Window.orderBy(at))).withColumn("_next", F.lead(at).over(Window.orderBy(at)))
    own = Window.partitionBy(*keys).orderBy("_i")
    listed = snapshots.select(*keys, at).distinct().join(F.broadcast(times), at)  # a row for each snapshot
    islands = listed.withColumn("_new", F.when(F.lag("_i").over(own) == F.col("_i") - 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own))
    return islands.groupBy(*keys, "_run").agg(F.min(at).alias("added_at"), F.max_by("_next", "_i").alias("removed_at")).drop("_run")


def late_gaps(arrivals: DataFrame) -> DataFrame:
    """Attempts that arrive (by seq) behind their board's watermark: reported, never inserted. Equal instants are not late."""
    before = Window.partitionBy("board").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("watermark", F.max("at").over(before)).where(F.col("at") < F.col("watermark"))
