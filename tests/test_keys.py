"""Keys of the archive, replay behind a watermark and catch-up, case by case."""

import datetime

import pytest
from pyspark.sql import functions as F
from tidemark.sources import keys

X = "extractions/attempts/2026/08/27T061204Z-0123456789ab-s1a2.json.gz"


def _one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_parsing(spark):
    for bad in ("attempts/a/b/2026/13/01T000000Z.json", "attempts/a/2026/08/18T060102Z.json", "attempts/a/b/2026/08/18T060102Z.json.gz", "", None):
        assert _one(spark, keys.parse_attempt_key(F.lit(bad).cast("string"))) is None
    got = _one(spark, keys.parse_attempt_key(F.lit("attempts/a/b c/2026/08/18T060102Z.json")))
    assert (got.source, got.board) == ("a", "b c")
    got = _one(spark, keys.parse_extraction_key(F.lit(X)))
    assert (got.document, got.slot, got.attempt_no) == ("0123456789ab", 1, 2)
    assert _one(spark, keys.parse_extraction_key(F.lit(X.replace("ab-s", "AB-s")))) is None
    assert _one(spark, keys.attempt_key(F.lit(None).cast("string"), F.lit("b"), F.current_timestamp())) is None


def test_derived_keys(spark):
    audit = lambda key, version: _one(spark, keys.audit_key(F.lit(key).cast("string"), F.lit(version).cast("string")))
    bare = "extractions/audits/2026/08/27T061204Z-0123456789ab-s1a2.json.gz"
    assert audit(X, None) == audit(X, "semantic-audit/v2") == bare
    assert audit(X, "semantic-audit/v3") == bare.replace(".json", ".a3.json") and audit(None, "semantic-audit/v3") is None
    assert _one(spark, keys.repair_key(F.lit(X))) == bare.replace("audits", "repairs")
    for key, version in ((X, "semantic-audit/v2.1"), (X, "other/v3"), (X + "x", None), (bare, None)):
        with pytest.raises(Exception, match="not an extraction attempt key|no key segment"):
            audit(key, version)
    assert _one(spark, keys.review_key(F.lit("2026-08-27 06:12:04").cast("timestamp"), F.lit("0123456789abcdef"), F.lit("flag"), F.lit(12345))).endswith("-0123456789ab-12345-flag.json")


def _frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "key string")


def test_pending(spark):
    key = lambda s: f"attempts/a/b/2026/08/18T0601{s}Z.json"
    rival = "attempts/z/b/2026/08/18T060110Z.json"
    listing = _frame(spark, [key("08"), key("09"), key("10"), rival, rival, key("11"), "attempts/README", None])
    mark = F.lit("2026-08-18 06:01:10 UTC").cast("timestamp")
    got = [(r.key, r.state) for r in keys.pending_attempts(listing, _frame(spark, [key("09"), rival]), mark, key("10")).collect()]
    assert sorted(got) == [(key("08"), "gap"), (key("11"), "pending"), (rival, "pending")], "a key of the watermark's second is offered again, the watermark's own is not"
    assert {r.state for r in keys.pending_attempts(listing, _frame(spark, []), None).collect()} == {"pending"}


def test_catch_up(spark):
    key = lambda s: X.replace("061204", f"0612{s}")
    listing = _frame(spark, [key(s) for s in ("01", "02", "03", "04", "05")] + ["extractions/attempts/9999", None])
    known = _frame(spark, [key("02"), key("04")])
    at = lambda s: datetime.datetime(2026, 8, 27, 6, 12, s, 500)
    run = lambda *a: sorted((r.key, r.state) for r in keys.catch_up(listing, known, *a).collect())
    assert run(at(4)) == [(key("04"), "from_watermark"), (key("05"), "from_watermark")]
    assert run(at(4), at(2)) == [(key("03"), "behind"), (key("04"), "from_watermark"), (key("05"), "from_watermark")]
    assert len(run()) == len(run(None, at(3))) == 5
    assert run(at(3), at(5)) == [(key(s), "from_watermark") for s in ("03", "04", "05")]


def test_reviews_to_fold(spark):
    events = spark.createDataFrame([("d1", "r1", 5), ("d2", "r2", 5), ("d3", "r3", 5), ("d4", "r4", 5), ("d4", "r5", 6)], "doc string, review_key string, at int")
    recorded = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "review_key string")
    folded = spark.createDataFrame([("d1", 6), ("d2", 5), ("d4", 9)], "doc string, folded_at int")
    assert {r.doc for r in keys.reviews_to_fold(events, recorded, folded, ["doc"]).collect()} == {"d2", "d4"}


def test_scans_of_keys_meet_the_known_ones_without_a_join(spark):
    """One aggregate of narrow rows; the key's pattern is matched once for its second, not once a part."""
    day = datetime.datetime(2024, 1, 2)
    listing = spark.createDataFrame([("attempts/a/b/2024/01/01T000000Z.json",), ("attempts/a/b/2024/13/01T000000Z.json",), (None,)], "key string")
    plans = [
        keys.pending_attempts(listing, listing, F.lit(day), "x"),
        keys.catch_up(listing, listing, day, day),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") == 1
    assert plans[0].count() == 0 and keys.pending_attempts(listing, listing.limit(0), F.lit(day)).select("state").collect()[0][0] == "gap"
    assert str(keys.attempt_second(F.col("key"))).count("regexp_extract") == 1
