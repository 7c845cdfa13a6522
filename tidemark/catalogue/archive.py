"""Keys of the archive and what listings of them owe, over attempts that every order stands for."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshots import table
from ..sources import keys

WATERMARK, SINCE = datetime.datetime(1996, 6, 1, 5, 10, 11, 999), datetime.datetime(1995, 1, 1)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.timestamp_add("SECOND", (k % 5 + (k % 7) * 3600 + 18611).cast("int"), F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), F.lower("o_orderstatus").alias("source"), F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")).alias("board"), F.sha2(k.cast("string"), 256).alias("hash"), (k % 3).cast("int").alias("slot"), (k % 11 + 1).cast("int").alias("no"))


def archive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of an attempt; they are parsed again, and the parts must be the same."""
    k = F.col("o_orderkey")
    version = F.when(k % 4 == 1, "semantic-audit/v2").when(k % 4 == 2, "semantic-audit/v3").when(k % 4 == 3, "semantic-audit/v12")
    made = _attempts(spark, sf_dir).withColumns({"attempt": keys.attempt_key(F.col("source"), F.col("board"), F.col("at")), "extraction": keys.extraction_key(F.col("at"), F.col("hash"), F.col("slot"), F.col("no"))})
    a, x = keys.parse_attempt_key(F.col("attempt")), keys.parse_extraction_key(F.col("extraction"))
    same = (a["source"] == F.col("source")) & (a["board"] == F.col("board")) & (a["at"] == F.col("at")) & (x["at"] == F.col("at")) & F.col("hash").startswith(x["document"]) & (x["slot"] == F.col("slot")) & (x["attempt_no"] == F.col("no"))
    return made.select("o_orderkey", "attempt", "extraction", keys.audit_key(F.col("extraction"), version).alias("audit"), keys.repair_key(F.col("extraction")).alias("repair"),
                       keys.review_key(F.col("at"), F.col("hash"), F.lit("accept"), F.col("no")).alias("review"), keys.blob_key(F.col("hash")).alias("blob"), keys.version_key(F.col("hash")).alias("version"), same.alias("round_trip"))


def pending_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine of ten attempts are known; keys of other layouts stand among the listed ones."""
    a = _attempts(spark, sf_dir).select("o_orderkey", keys.attempt_key(F.col("source"), F.col("board"), F.col("at")).alias("key"))
    listing = a.select("key").unionByName(a.select(F.concat("key", F.lit(".tmp")).alias("key")))
    return keys.pending_attempts(listing, a.where("o_orderkey % 10 <> 0").select("key"), F.lit("1996-06-01 05:10:11 UTC").cast("timestamp"), "attempts/o/b7/1996/06/01T051011Z.json").select("key", "state", F.unix_timestamp("at").alias("second"))


def catch_up_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir).select("o_orderkey", keys.extraction_key(F.col("at"), F.col("hash"), F.col("slot"), F.col("no")).alias("key"))
    return keys.catch_up(a, a.where("o_orderkey % 6 <> 0"), WATERMARK, SINCE).select("key", "document", "state", F.unix_timestamp("at").alias("second"))


QUERIES = {f.__name__: f for f in (archive_keys, pending_replay, catch_up_scan)}

_ATTEMPTS = """WITH a AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_seconds((o_orderkey % 5 + (o_orderkey % 7) * 3600 + 18611)::BIGINT) AS ts, sha256(o_orderkey::VARCHAR) AS h, o_orderkey % 3 AS slot, o_orderkey % 11 + 1 AS no,
    lower(o_orderstatus) || '/b' || (o_custkey % 50) AS board FROM orders),
  k AS (SELECT *, strftime(ts, '%Y/%m/%dT%H%M%SZ') AS s, s || '-' || left(h, 12) AS doc, doc || '-s' || slot || 'a' || no AS leaf, 'attempts/' || board || '/' || s || '.json' AS attempt FROM a)"""
ORACLES = {
    "archive_keys": _ATTEMPTS + """ SELECT o_orderkey, attempt, 'extractions/attempts/' || leaf || '.json.gz' AS extraction, 'extractions/audits/' || leaf || ['', '', '.a3', '.a12'][(o_orderkey % 4 + 1)::INTEGER] || '.json.gz' AS audit,
      'extractions/repairs/' || leaf || '.json.gz' AS repair, 'extractions/reviews/' || doc || '-' || lpad(no::VARCHAR, 4, '0') || '-accept.json' AS review, 'blobs/sha256/' || left(h, 2) || '/' || h || '.gz' AS blob,
      'versions/' || left(h, 2) || '/' || h || '.html.gz' AS version, true AS round_trip FROM k""",
    "pending_replay": _ATTEMPTS + """ SELECT attempt AS key, CASE WHEN min(ts) >= TIMESTAMP '1996-06-01 05:10:11' THEN 'pending' ELSE 'gap' END AS state, epoch(min(ts))::BIGINT AS second FROM k
      WHERE attempt <> 'attempts/o/b7/1996/06/01T051011Z.json' GROUP BY attempt HAVING min(ts) >= TIMESTAMP '1996-06-01 05:10:11' OR bool_and(o_orderkey % 10 = 0)""",
    "catch_up_scan": _ATTEMPTS + """ SELECT DISTINCT 'extractions/attempts/' || leaf || '.json.gz' AS key, left(h, 12) AS document, CASE WHEN ts >= TIMESTAMP '1996-06-01 05:10:11' THEN 'from_watermark' ELSE 'behind' END AS state, epoch(ts)::BIGINT AS second FROM k
      WHERE ts >= TIMESTAMP '1996-06-01 05:10:11' OR (ts >= TIMESTAMP '1995-01-01' AND o_orderkey % 6 = 0)""",
}
