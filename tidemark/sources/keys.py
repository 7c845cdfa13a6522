"""Keys of the archive as expressions, and what a listing of keys still owes.

A key tells everything that a replay decides by, so no body is read behind a watermark: pending work, gaps and catch-up are filters and anti joins of
listings. Keys sort as their seconds do. A null part gives a null key, and a key of another layout, or one that names no second of the calendar, parses to null."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The archive's layout.
ATTEMPTS, EXTRACTIONS, AUDITS, REPAIRS, REVIEWS = "attempts/", "extractions/attempts/", "extractions/audits/", "extractions/repairs/", "extractions/reviews/"
ATTEMPT_KEY = r"^attempts/([^/]+)/([^/]+)/(\d{4}/\d{2}/\d{2}T\d{6})Z\.json$"
EXTRACTION_KEY = r"^extractions/attempts/(\d{4}/\d{2}/\d{2}T\d{6})Z-([0-9a-f]{12})-s(\d+)a(\d+)\.json\.gz$"
BARE_AUDIT = "semantic-audit/v2"
AUDIT_VERSION = r"^semantic-audit/v([0-9]+)$"


def stamp(at: Column) -> Column:
    """YYYY/MM/DDTHHMMSSZ of the instant, in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy/MM/dd'T'HHmmss'Z'")


def _second(told: Column) -> Column:
    """The instant of YYYY/MM/DDTHHMMSS: one match of a pattern finds it, and its parts are cut by their places; told is made once, not once a part."""
    part = lambda s, at, size: F.substring(s, at, size).try_cast("int")
    second = lambda s: F.try_make_timestamp(part(s, 1, 4), part(s, 6, 2), part(s, 9, 2), part(s, 12, 2), part(s, 14, 2), part(s, 16, 2), F.lit("UTC"))
    return F.get(F.transform(F.array(told), second), F.lit(0))


def attempt_second(key: Column) -> Column:
    return _second(F.regexp_extract(key, ATTEMPT_KEY, 3))


def extraction_second(key: Column) -> Column:
    return _second(F.regexp_extract(key, EXTRACTION_KEY, 1))


def blob_key(sha256: Column) -> Column:
    return F.concat(F.lit("blobs/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(".gz"))


def version_key(version_hash: Column) -> Column:
    return F.concat(F.lit("versions/"), F.substring(version_hash, 1, 2), F.lit("/"), version_hash, F.lit(".html.gz"))


def attempt_key(source: Column, board: Column, at: Column) -> Column:
    return F.concat(F.lit(ATTEMPTS), source, F.lit("/"), board, F.lit("/"), stamp(at), F.lit(".json"))


def parse_attempt_key(key: Column) -> Column:
    """struct(source, board, at)."""
    at = attempt_second(key)
    return F.when(at.isNotNull(), F.struct(F.regexp_extract(key, ATTEMPT_KEY, 1).alias("source"), F.regexp_extract(key, ATTEMPT_KEY, 2).alias("board"), at.alias("at")))


def extraction_key(at: Column, document_hash: Column, slot: Column, attempt_no: Column) -> Column:
    leaf = F.concat(stamp(at), F.lit("-"), F.substring(document_hash, 1, 12), F.lit("-s"), slot.cast("string"), F.lit("a"), attempt_no.cast("string"), F.lit(".json.gz"))
    return F.concat(F.lit(EXTRACTIONS), leaf)


def parse_extraction_key(key: Column) -> Column:
    """struct(at, document, slot, attempt_no); document is the first twelve digits of the hash."""
    part = lambda k: F.regexp_extract(key, EXTRACTION_KEY, k)
    at = extraction_second(key)
    return F.when(at.isNotNull(), F.struct(at.alias("at"), part(2).alias("document"), part(3).try_cast("long").alias("slot"), part(4).try_cast("long").alias("attempt_no")))


def _of_attempt(key: Column) -> Column:
    """The leaf of an extraction attempt's key; raises on any other key, since a derived key must not name another document's artifact."""
    bad = F.raise_error(F.concat(F.lit("not an extraction attempt key: "), key)).cast("string")
    return F.when(key.isNull() | key.rlike(EXTRACTION_KEY), F.substring(key, len(EXTRACTIONS) + 1, 2**31 - 1)).otherwise(bad)


def audit_key(key: Column, version: Column) -> Column:
    """The audit of an attempt under one audit version: a segment per version, none for the oldest one and for null. Raises on a version of another family or
    numbering, since two versions would share a key that is written once."""
    leaf, known = _of_attempt(key), version.rlike(AUDIT_VERSION)
    bad = F.raise_error(F.concat(F.lit("no key segment for audit version "), version)).cast("string")
    segment = F.when(version.isNull() | (version == BARE_AUDIT), "").when(known, F.concat(F.lit(".a"), F.regexp_extract(version, AUDIT_VERSION, 1))).otherwise(bad)
    return F.concat(F.lit(AUDITS), F.regexp_replace(leaf, r"\.json\.gz$", ""), segment, F.lit(".json.gz"))


def repair_key(key: Column) -> Column:
    return F.concat(F.lit(REPAIRS), _of_attempt(key))


def review_key(at: Column, document_hash: Column, verb: Column, seq: Column) -> Column:
    """seq orders the reviews of one document within a second."""
    number = F.when(seq < 10000, F.lpad(seq.cast("string"), 4, "0")).otherwise(seq.cast("string"))
    return F.concat(F.lit(REVIEWS), stamp(at), F.lit("-"), F.substring(document_hash, 1, 12), F.lit("-"), number, F.lit("-"), verb, F.lit(".json"))


def pending_attempts(listing: DataFrame, known: DataFrame, last_at: Column | None = None, last_key: str | None = None) -> DataFrame:
    """key, at, state: what a replay behind the watermark (the second and the key of the last attempt taken in) has to do with the listed keys.

    pending: from the watermark's second on, all but its own key, known or not (taking one in twice changes nothing), to be taken in by (at, key). gap: before
    that second and not known (a column key); it cannot be put in any more without a rebuild. Without a watermark all is pending. Other keys are left out."""
    each = listing.select("key", attempt_second(F.col("key")).alias("at")).where("at is not null")
    if last_at is None:
        return each.distinct().withColumn("state", F.lit("pending"))
    own = F.lit(False) if last_key is None else F.col("key") == last_key
    late = F.col("at") >= last_at
    return _met(each, known).where((late | ~F.col("_known")) & ~own).select("key", "at", F.when(late, "pending").otherwise("gap").alias("state"))


def _met(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Each listed key once, with _known: one shuffle of narrow rows, combined before it, in place of a distinct and a join for each state."""
    parts = [c for c in listed.columns if c != "key"]
    both = listed.withColumn("_known", F.lit(False)).unionByName(known.select("key", F.lit(True).alias("_known")), allowMissingColumns=True)
    return both.groupBy("key").agg(*[F.max(c).alias(c) for c in [*parts, "_known"]]).where("at is not null")


def catch_up(listing: DataFrame, known: DataFrame, watermark: datetime.datetime | None = None, since: datetime.datetime | None = None) -> DataFrame:
    """key, at, document, state: the extraction attempts to read again. from_watermark: its second and later, recorded or not, since a recorded row does not tell
    that its fold ended. behind: from since on (an upload's older stamps), only those that are not recorded (known: key).

    Keys sort as their seconds, so the listing is cut by a comparison of keys that a scan can push down. Instants are in UTC."""
    floors = [x.replace(microsecond=0) for x in (watermark, since) if x is not None]
    whole = lambda x: F.lit(x.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S") + " UTC").cast("timestamp")
    reach = F.col("key") >= (EXTRACTIONS if watermark is None else EXTRACTIONS + min(floors).strftime("%Y/%m/%dT%H%M%SZ"))
    document = F.regexp_extract("key", EXTRACTION_KEY, 2)
    rows = listing.select("key").where(reach).select("key", extraction_second(F.col("key")).alias("at"), document.alias("document")).where("at is not null")
    if watermark is None:
        return rows.distinct().withColumn("state", F.lit("from_watermark"))
    late = F.col("at") >= whole(watermark)
    return _met(rows, known.where(reach)).where(late | ~F.col("_known")).select("key", "at", "document", F.when(late, "from_watermark").otherwise("behind").alias("state"))


def reviews_to_fold(events: DataFrame, recorded: DataFrame, folded: DataFrame, config: list[str]) -> DataFrame:
    """The configurations whose state owes a fold: those with a review (config, review_key, at) that is not recorded (review_key), and those whose last fold
    (config, folded_at) is not later than a review, so it may have died before it ended. Others keep their time of update."""
    new = events.join(recorded.select("review_key"), "review_key", "left_anti").select(*config)
    stale = events.join(folded, config).where(F.col("folded_at") <= F.col("at")).select(*config)
    return new.unionByName(stale).distinct()
