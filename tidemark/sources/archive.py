"""The archive: manifests and blobs under date-hierarchical keys, read as tables; the registry of boards."""

from __future__ import annotations

import hashlib
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json

MANIFEST = (
    "attempt_id string, run_id string, source string, board string, started_at timestamp, finished_at timestamp, url string, http_status int, transport string, blob_sha256 string, payload_bytes long, record_count int, "
    "adapter_version string, registry_revision string, cli_version string, error string, page_blobs array<string>, details array<struct<uid:string,blob_sha256:string,http_status:int,error:string>>"
)
REQUIRED_EXTRA = {"workday": ("host",), "oraclehcm": ("base", "site"), "eightfold": ("base", "domain")}


def manifests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(paths)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Gzip blobs (decompressed by the text reader): sha256 from the file's name, and body."""
    name = F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})[^/]*$", 1)
    return spark.read.option("wholetext", True).text(path).select(name.alias("blob_sha256"), F.col("value").alias("body"))


def after_key(df: DataFrame, key: str, start_after: str | None) -> DataFrame:
    """Strictly after a key, in key order: the replay log."""
    return (df if start_after is None else df.where(F.col(key) > start_after)).orderBy(key)


def manifest_key(key: Column) -> tuple[Column, Column, Column]:
    """source, board and second of a key manifests/SOURCE/BOARD/YYYY/MM/DD/HHMMSSZ-... ."""
    pattern = r"^manifests/([^/]+)/([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{6})Z"
    part = lambda k: F.regexp_extract(key, pattern, k)
    return part(1), part(2), F.try_to_timestamp(F.concat(part(3), part(4), part(5), part(6)), F.lit("yyyyMMddHHmmss"))


def detail_history(attempts: DataFrame) -> DataFrame:
    """board, uid, last_at: when a detail was last fetched well."""
    each = attempts.select("board", "started_at", F.explode("details").alias("d")).where(F.col("d.error").isNull())
    return each.groupBy("board", F.col("d.uid").alias("uid")).agg(F.max("started_at").alias("last_at"))


def run_summary(attempts: DataFrame) -> DataFrame:
    """Attempts of each run by outcome: ok, envelope error, http error, transport error."""
    failed = F.col("error").isNotNull()
    return attempts.groupBy("run_id").agg(
        F.count_if(~failed).alias("n_ok"), F.count_if(failed & (F.col("transport") == "ok")).alias("n_envelope"), F.count_if(failed & (F.col("transport") == "http_error")).alias("n_http"),
        F.count_if(failed & ~F.col("transport").isin("ok", "http_error")).alias("n_transport"),
    )


def blocked(status: Column, body: Column) -> Column:
    """403, or a challenge page: a marker near the start of a body that looks like HTML."""
    head = F.lower(F.ltrim(F.substring(body, 1, 4096)))
    looks = head.startswith("<!doctype html") | head.startswith("<html")
    return (status == 403) | (looks & head.rlike("captcha|access denied|challenge-platform|are you a robot"))


def write_new(df: DataFrame, path: str, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Appends only rows whose key is not there yet: a write-once table."""
    fresh = df.dropDuplicates(keys)
    fresh = fresh if existing is None else fresh.join(existing.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def registry(spark: SparkSession, toml_text: str) -> tuple[DataFrame, str]:
    """Boards of a registry file, sorted, and the revision of the whole; duplicates and missing settings are errors."""
    rows = []
    for b in tomllib.loads(toml_text).get("board", []):
        extra = {k: str(v) for k, v in b.items() if k not in ("company", "source", "board", "country", "tags")}
        if missing := [k for k in REQUIRED_EXTRA.get(b["source"], ()) if k not in extra]:
            raise ValueError(f"{b['source']}:{b['board']} lacks {missing}")
        rows.append({"company": b["company"], "source": b["source"], "board": b["board"], "country": b.get("country"), "tags": list(b.get("tags", [])), "extra": extra})
    rows.sort(key=lambda r: (r["source"], r["board"]))
    names = [(r["source"], r["board"]) for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a board is listed twice")
    revision = hashlib.sha256(canonical_json(rows).encode()).hexdigest()
    return spark.createDataFrame(rows, "company string, source string, board string, country string, tags array<string>, extra map<string,string>"), revision
