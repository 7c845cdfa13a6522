"""Lifecycle operators over the event snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..plans import lifecycle as lc
from ..plans.snapshots import attempts_and_observations, event_snapshots, table
from ..streaming.replay import replay_in_batches

#: The snapshots and the lifecycle as window SQL; queries select from att, rows_, ev.
LIFE = """
WITH base AS (
  SELECT event_type AS board, date_trunc('day', ts)::TIMESTAMP AS at, event_id AS pos, user_id AS uid, value,
    event_type || '/' || strftime(ts, '%Y-%m-%d') AS attempt_id FROM events),
att0 AS (SELECT DISTINCT board, attempt_id, at, (day(at) * 7 + length(board)) % 11 = 0 AS is_error, strftime(at, '%Y-%m-%d') AS run_id FROM base),
obs0 AS (
  SELECT board, attempt_id, pos, uid, CASE WHEN pos % 97 = 0 THEN 'failed' WHEN pos % 89 = 0 THEN 'pending' ELSE 'ok' END AS status,
    sha256(CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR)) AS v
  FROM base WHERE day(at) % 7 <> 3 OR uid % 5 = 0),
obs AS (
  SELECT board, attempt_id, pos, uid, status, CASE WHEN status = 'ok' THEN v END AS vh FROM obs0
  QUALIFY row_number() OVER (PARTITION BY board, attempt_id, uid ORDER BY pos) = 1),
cnt AS (SELECT board, attempt_id, count(*) AS n FROM obs GROUP BY ALL),
att1 AS (
  SELECT a.*, CASE WHEN NOT is_error THEN coalesce(n, 0) END AS n_observed, row_number() OVER (PARTITION BY a.board ORDER BY at, a.attempt_id) AS i
  FROM att0 a LEFT JOIN cnt c ON a.board = c.board AND a.attempt_id = c.attempt_id),
att2 AS (
  SELECT *, last_value(n_observed IGNORE NULLS) OVER (PARTITION BY board ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_n FROM att1),
att3 AS (SELECT *, CASE WHEN is_error THEN 'error' WHEN n_observed < 0.5 * previous_n THEN 'suspect_drop' ELSE 'ok' END AS health FROM att2),
att AS (
  SELECT *, first_value(CASE WHEN health = 'ok' THEN i END IGNORE NULLS) OVER w AS ok_i, first_value(CASE WHEN health = 'ok' THEN at END IGNORE NULLS) OVER w AS ok_at,
    first_value(CASE WHEN health = 'ok' THEN attempt_id END IGNORE NULLS) OVER w AS ok_id
  FROM att3 WINDOW w AS (PARTITION BY board ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r1 AS (
  SELECT o.*, a.i, a.at, a.ok_i, a.ok_at, a.ok_id, last_value(vh IGNORE NULLS) OVER (PARTITION BY o.board, uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
    lag(i) OVER w AS previous_i, lead(i) OVER w AS next_i
  FROM obs o JOIN att a USING (board, attempt_id) WHERE NOT a.is_error WINDOW w AS (PARTITION BY o.board, uid ORDER BY i)),
r2 AS (
  SELECT * EXCLUDE (vh, status), CASE WHEN status = 'pending' THEN known ELSE vh END AS vh,
    CASE WHEN status = 'pending' AND known IS NOT NULL THEN 'ok' WHEN status = 'pending' THEN 'pending_detail' ELSE status END AS status,
    CASE WHEN ok_i IS NOT NULL AND (next_i IS NULL OR ok_i < next_i) THEN ok_at END AS close_at, CASE WHEN ok_i IS NOT NULL AND (next_i IS NULL OR ok_i < next_i) THEN ok_id END AS close_id FROM r1),
rows_ AS (SELECT *, lag(close_at) OVER (PARTITION BY board, uid ORDER BY i) AS previous_close FROM r2),
ev0 AS (
  SELECT board, attempt_id, at, uid, CASE WHEN previous_i IS NULL THEN 'opened' WHEN previous_close IS NOT NULL THEN 'reopened' WHEN vh IS NOT NULL AND vh IS DISTINCT FROM known THEN 'changed' END AS kind,
    known AS k, vh, NULL::TIMESTAMP AS closed_after, NULL::TIMESTAMP AS closed_by, 0 AS last, pos FROM rows_
  UNION ALL SELECT board, close_id, close_at, uid, 'closed', coalesce(vh, known), NULL, at, close_at, 1, NULL FROM rows_ WHERE close_at IS NOT NULL),
ev AS (
  SELECT row_number() OVER (ORDER BY at, attempt_id, last, pos, uid) AS event_id, board, attempt_id, at, uid, kind, CASE WHEN kind <> 'opened' THEN k END AS from_version,
    CASE WHEN kind = 'closed' THEN NULL WHEN kind = 'opened' THEN vh ELSE coalesce(vh, k) END AS to_version, closed_after, closed_by
  FROM ev0 WHERE kind IS NOT NULL),
posting AS (
  SELECT board, uid, min(at) AS first_seen_at, max(at) AS last_seen_at, CASE WHEN arg_max(coalesce(close_at, TIMESTAMP '1900-01-01'), i) = TIMESTAMP '1900-01-01' THEN 'open' ELSE 'closed' END AS state,
    arg_max(coalesce(vh, known, ''), i) AS cv, arg_max(coalesce(close_at, TIMESTAMP '1900-01-01'), i) AS cl, count(*) FILTER (vh IS NOT NULL AND vh IS DISTINCT FROM known) AS version_count, count(previous_close) AS reopen_count
  FROM rows_ GROUP BY board, uid)
"""


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_snapshots(spark, sf_dir).events


def attempt_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_snapshots(spark, sf_dir).attempts.select("board", "attempt_id", "at", "i", "n_observed", "previous_n", "health")


def presence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_snapshots(spark, sf_dir).presence


def postings_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_snapshots(spark, sf_dir).postings


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.run_rollup(event_snapshots(spark, sf_dir).attempts)


def panel_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards as members of a panel: a board is listed on a day if the day of the month and its name allow it."""
    attempts, _ = attempts_and_observations(table(spark, sf_dir, "events"))
    return lc.membership(attempts.where((F.dayofmonth("at") + F.length("board")) % 4 != 0).select("board", "at"), ["board"])


def drop_guard_deferred_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes whose interval spans a suspect attempt that could not close."""
    life = event_snapshots(spark, sf_dir)
    suspect = life.attempts.where("health <> 'ok'").select(F.col("board").alias("_b"), F.col("at").alias("_at"), "health")
    closes = life.events.where("kind = 'closed'")
    spans = closes.join(suspect, (F.col("board") == F.col("_b")) & (F.col("_at") > F.col("closed_after")) & (F.col("_at") < F.col("closed_by")))
    return spans.groupBy("board", "closed_by").agg(F.count_distinct("uid").alias("n_closes"), F.count_if(F.col("health") == "suspect_drop").alias("n_suspect"))


def board_health_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.latest_per(event_snapshots(spark, sf_dir).attempts, ["board"], ["at", "attempt_id"]).select("board", "attempt_id", "at", "health")


def open_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_snapshots(spark, sf_dir).postings.where("state = 'open'").groupBy("board").agg(F.count("*").alias("n_open"))


def boards_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health and open counts of all boards, either side missing."""
    life = event_snapshots(spark, sf_dir)
    health = pages.latest_per(life.attempts.where("board <> 'view'"), ["board"], ["at", "attempt_id"]).select("board", "health")
    n_open = life.postings.where("state = 'open' and board <> 'click'").groupBy("board").agg(F.count("*").alias("n"))
    return health.join(n_open, "board", "full_outer").select("board", "health", F.coalesce("n", F.lit(0)).alias("n_open"))


def current_version_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the instant at which their current version was first seen."""
    life = event_snapshots(spark, sf_dir)
    versions = life.rows.where("vh is not null").groupBy("board", "uid", F.col("vh").alias("current_version")).agg(F.min("at").alias("version_seen_at"))
    return life.postings.join(versions, ["board", "uid", "current_version"], "left").select("board", "uid", "current_version", "version_seen_at")


def events_page_after_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event page: oldest first after a key, with its posting's current version where the event has none."""
    life = event_snapshots(spark, sf_dir)
    shown = life.events.join(life.postings.select("board", "uid", "current_version"), ["board", "uid"]).withColumn("version", F.coalesce("to_version", "current_version"))
    return pages.page(shown.select("event_id", "board", "uid", "kind", "version"), [("event_id", False)], after={"event_id": 200}, limit=50).rows


def late_data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that arrive out of order, by a fixed shuffle of the log."""
    attempts, _ = attempts_and_observations(table(spark, sf_dir, "events"))
    return lc.late_gaps(attempts.withColumn("seq", F.dayofmonth("at") * 10 + F.when(F.dayofmonth("at") % 5 == 0, 35).otherwise(0))).select("board", "attempt_id", "at", "watermark")


def pulse_payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per board, what changed since a watermark."""
    found = lc.unnumbered(event_snapshots(spark, sf_dir)).where(F.col("at") > F.lit("2024-01-20").cast("timestamp"))
    return found.groupBy("board").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("opened", "changed", "closed", "reopened")], F.max("at").alias("read_to"))


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a consumer stands after reading all lifecycle events up to an instant: the instant and all ids at it."""
    return pages.advance(event_snapshots(spark, sf_dir).events.where(F.col("at") <= F.lit("2024-01-25").cast("timestamp")), "at", "event_id")


def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work order of versions: open postings first, then recently closed ones, then the rest."""
    life = event_snapshots(spark, sf_dir)
    recent = F.lit("2024-01-25").cast("timestamp")
    seen = life.postings.where("current_version is not null").groupBy("current_version").agg(F.bool_or(F.col("state") == "open").alias("any_open"), F.max("closed_by").alias("closed"), F.max("last_seen_at").alias("last_seen_at"))
    return seen.select("current_version", F.when(F.col("any_open"), 0).when(F.col("closed") > recent, 1).otherwise(2).alias("priority"), "last_seen_at")


def stream_lifecycle_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle built day by day from a file stream, compared with the batch replay: one row, no differences."""
    streamed = replay_in_batches(spark, table(spark, sf_dir, "events"))
    batch = event_snapshots(spark, sf_dir).events
    return batch.agg(F.count("*").alias("n_batch")).crossJoin(streamed.agg(F.count("*").alias("n_stream"))).crossJoin(batch.exceptAll(streamed.select(*batch.columns)).agg(F.count("*").alias("n_missing")))


QUERIES = {f.__name__: f for f in (
    lifecycle_events, attempt_health, presence_intervals, postings_state, run_rollup, panel_scd2, drop_guard_deferred_closes, board_health_latest, open_counts, boards_overview,
    current_version_left_join, events_page_after_id, late_data_gaps, pulse_payload_counts, watermark_advance, queue_priority, stream_lifecycle_equals_batch,
)}

ORACLES = {name: re.sub(r"\bat\b", '"at"', LIFE + sql) for name, sql in {  # DuckDB reads a bare at as a keyword
    "lifecycle_events": "SELECT * FROM ev",
    "attempt_health": "SELECT board, attempt_id, at, i::INTEGER AS i, n_observed::BIGINT AS n_observed, previous_n::BIGINT AS previous_n, health FROM att",
    "presence_intervals": """, m AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(vh) OVER w IS NOT DISTINCT FROM vh AND lag(status) OVER w IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS n FROM rows_ WINDOW w AS (PARTITION BY board, uid ORDER BY i)),
      g AS (SELECT *, sum(n) OVER (PARTITION BY board, uid ORDER BY i) AS run FROM m)
      SELECT board, uid, arg_min(attempt_id, i) AS first_attempt, arg_max(attempt_id, i) AS last_attempt, min(at) AS first_at, max(at) AS last_at, count(*) AS runs, max(vh) AS version, max(status) AS status FROM g GROUP BY board, uid, run""",
    "postings_state": """SELECT board, uid, first_seen_at, last_seen_at, state, nullif(cv, '') AS current_version, CASE WHEN state = 'closed' THEN last_seen_at END AS closed_after, CASE WHEN state = 'closed' THEN cl END AS closed_by, version_count, reopen_count FROM posting""",
    "run_rollup": """SELECT run_id, min(at) AS started_at, max(at) AS finished_at, count(*) AS n_attempts, count(*) FILTER (health = 'ok') AS n_ok, count(*) FILTER (health = 'error') AS n_error, count(*) FILTER (health = 'suspect_drop') AS n_suspect FROM att GROUP BY run_id""",
    "panel_scd2": """, s AS (SELECT DISTINCT board, at FROM att0 WHERE (day(at) + length(board)) % 4 <> 0), t AS (SELECT at, row_number() OVER (ORDER BY at) AS k, lead(at) OVER (ORDER BY at) AS nx FROM (SELECT DISTINCT at FROM s)),
      l AS (SELECT board, t.*, CASE WHEN lag(k) OVER (PARTITION BY board ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS n FROM s JOIN t USING (at)), g AS (SELECT *, sum(n) OVER (PARTITION BY board ORDER BY k) AS run FROM l)
      SELECT board, min(at) AS added_at, (max(struct_pack(k := k, nx := nx))).nx AS removed_at FROM g GROUP BY board, run""",
    "drop_guard_deferred_closes": """SELECT e.board, e.closed_by, count(DISTINCT uid) AS n_closes, count(*) FILTER (a.health = 'suspect_drop') AS n_suspect FROM ev e JOIN att a ON a.board = e.board AND a.health <> 'ok' AND a.at > e.closed_after AND a.at < e.closed_by WHERE kind = 'closed' GROUP BY ALL""",
    "board_health_latest": "SELECT DISTINCT ON (board) board, attempt_id, at, health FROM att ORDER BY board, at DESC, attempt_id DESC",
    "open_counts": "SELECT board, count(*) AS n_open FROM posting WHERE state = 'open' GROUP BY board",
    "boards_overview": """, h AS (SELECT DISTINCT ON (board) board, health FROM att WHERE board <> 'view' ORDER BY board, at DESC), o AS (SELECT board, count(*) AS n FROM posting WHERE state = 'open' AND board <> 'click' GROUP BY board)
      SELECT coalesce(h.board, o.board) AS board, health, coalesce(n, 0) AS n_open FROM h FULL JOIN o ON h.board = o.board""",
    "current_version_left_join": """, v AS (SELECT board, uid, vh, min(at) AS version_seen_at FROM rows_ WHERE vh IS NOT NULL GROUP BY ALL) SELECT p.board, p.uid, nullif(cv, '') AS current_version, version_seen_at FROM posting p LEFT JOIN v ON v.board = p.board AND v.uid = p.uid AND v.vh = p.cv""",
    "events_page_after_id": """SELECT event_id, e.board, e.uid, kind, coalesce(to_version, nullif(cv, '')) AS version FROM ev e JOIN posting p ON e.board = p.board AND e.uid = p.uid WHERE event_id > 200 ORDER BY event_id LIMIT 50""",
    "late_data_gaps": """, s AS (SELECT *, day(at) * 10 + CASE WHEN day(at) % 5 = 0 THEN 35 ELSE 0 END AS seq FROM att0), w AS (SELECT *, max(at) OVER (PARTITION BY board ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM s) SELECT board, attempt_id, at, watermark FROM w WHERE at < watermark""",
    "pulse_payload_counts": """SELECT board, count(*) FILTER (kind = 'opened') AS n_opened, count(*) FILTER (kind = 'changed') AS n_changed, count(*) FILTER (kind = 'closed') AS n_closed, count(*) FILTER (kind = 'reopened') AS n_reopened, max(at) AS read_to FROM ev WHERE at > TIMESTAMP '2024-01-20' GROUP BY board""",
    "watermark_advance": """SELECT max(at) AS at, list(event_id ORDER BY event_id) FILTER (at = (SELECT max(at) FROM ev WHERE at <= TIMESTAMP '2024-01-25')) AS ids FROM ev WHERE at <= TIMESTAMP '2024-01-25'""",
    "queue_priority": """SELECT cv AS current_version, CASE WHEN bool_or(state = 'open') THEN 0 WHEN max(CASE WHEN state = 'closed' THEN cl END) > TIMESTAMP '2024-01-25' THEN 1 ELSE 2 END AS priority, max(last_seen_at) AS last_seen_at FROM posting WHERE cv <> '' GROUP BY cv""",
}.items()}
ORACLES["stream_lifecycle_equals_batch"] = ORACLES["lifecycle_events"].removesuffix("SELECT * FROM ev") + "SELECT count(*) AS n_batch, count(*) AS n_stream, 0::BIGINT AS n_missing FROM ev"
