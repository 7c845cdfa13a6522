"""The scripted four days, and random logs against a plain fold."""

import datetime as dt
import random

import pytest
from tidemark.plans.lifecycle import late_gaps, membership, replay

D = [dt.datetime(2026, 3, 1, 6) + dt.timedelta(days=k) for k in range(4)]


def frames(spark, attempts, observations):
    a = spark.createDataFrame(attempts, "board string, attempt_id string, at timestamp, is_error boolean")
    return a, spark.createDataFrame(observations, "board string, attempt_id string, pos long, uid string, vh string, status string")


def scripted():
    days = {
        "G": [["G0", "G1", "G2", "G3"], ["G0*", "G1", "G2", "G3"], None, ["G0", "G1"]],
        "L": [["L0", "L1", "L2", "L3"], ["L0", "L1", "L2"], [], []],
        "A": [["A0", "A1"], ["A0", "A1"], ["A0"], ["A0"]],
    }
    attempts, obs = [], []
    for board, snapshots in days.items():
        for k, uids in enumerate(snapshots):
            attempts.append((board, f"{board}{k}", D[k], uids is None))
            obs += [(board, f"{board}{k}", n, u.rstrip("*"), "v2" if u.endswith("*") else "v1", "ok") for n, u in enumerate(uids or [])]
    return attempts, obs


def test_four_days(spark):
    life = replay(*frames(spark, *scripted()))
    health = {r["attempt_id"]: r["health"] for r in life.attempts.collect()}
    assert health["G2"] == "error" and health["L2"] == "suspect_drop" and health["L3"] == "ok" and health["A2"] == "ok"
    got = [(r["at"], r["kind"], r["uid"]) for r in life.events.orderBy("event_id").collect()]
    assert sum(k == "opened" for _, k, _ in got) == 10
    closes = {r["uid"]: (r["closed_after"], r["closed_by"]) for r in life.events.where("kind = 'closed'").collect()}
    assert closes == {"L3": (D[0], D[1]), "A1": (D[1], D[2]), "G2": (D[1], D[3]), "G3": (D[1], D[3]), "L0": (D[1], D[3]), "L1": (D[1], D[3]), "L2": (D[1], D[3])}
    assert [(a, u) for a, k, u in got if k == "changed"] == [(D[1], "G0"), (D[3], "G0")]
    state = {r["uid"]: r for r in life.postings.collect()}
    assert {u for u, r in state.items() if r["state"] == "open"} == {"G0", "G1", "A0"}
    assert state["G0"]["version_count"] == 3  # going back to an old version counts


def fold(attempts, observations, ratio=0.5):
    """One attempt after the other."""
    events, state = [], {}
    by = {}
    for b, a, pos, uid, vh, status in sorted(observations, key=lambda o: o[2]):
        by.setdefault((b, a), {}).setdefault(uid, (pos, vh, status))
    last_n = {}
    for b, a, at, is_error in sorted(attempts, key=lambda x: (x[2], x[1])):
        if is_error:
            continue
        seen = by.get((b, a), {})
        suspect = b in last_n and len(seen) < ratio * last_n[b]
        last_n[b] = len(seen)
        for uid, (pos, vh, status) in seen.items():
            s = state.get((b, uid))
            if status == "pending":
                vh = s["vh"] if s else None
            if s is None:
                events.append((b, a, uid, "opened", None, None))
                s = state[b, uid] = {"vh": None, "open": True}
            elif not s["open"]:
                events.append((b, a, uid, "reopened", None, None))
                s["open"] = True
            elif vh is not None and vh != s["vh"]:
                events.append((b, a, uid, "changed", None, None))
            s["vh"], s["at"] = vh or s["vh"], at
        if not suspect:
            for (bb, uid), s in state.items():
                if bb == b and s["open"] and uid not in seen:
                    events.append((b, a, uid, "closed", s["at"], at))
                    s["open"] = False
    return sorted(events, key=str), {k: ("open" if s["open"] else "closed", s["vh"]) for k, s in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    attempts, obs = [], []
    for b in "XY":
        for k in range(25):
            at = D[0] + dt.timedelta(hours=k)
            error = rng.random() < 0.1
            attempts.append((b, f"{b}{k:02d}", at, error))
            share = rng.choice([0.2, 0.8, 0.8, 0.9])
            for n, u in enumerate(range(8)):
                if not error and rng.random() < share:
                    status = rng.choice(["ok"] * 6 + ["failed", "pending"])
                    row = (b, f"{b}{k:02d}", 2 * n, f"u{u}", rng.choice("abc") if status == "ok" else None, status)
                    obs += [row] + ([(*row[:2], 2 * n + 1, *row[3:])] if rng.random() < 0.1 else [])
    life = replay(*frames(spark, attempts, obs))
    got = sorted(((r["board"], r["attempt_id"], r["uid"], r["kind"], r["closed_after"], r["closed_by"]) for r in life.events.collect()), key=str)
    events, state = fold(attempts, obs)
    assert got == events
    assert {(r["board"], r["uid"]): (r["state"], r["current_version"]) for r in life.postings.collect()} == state
    ids = [r["event_id"] for r in life.events.orderBy("event_id").collect()]
    assert ids == list(range(1, len(events) + 1))


def test_membership_and_gaps(spark):
    snaps = spark.createDataFrame([("x", D[0]), ("x", D[1]), ("y", D[1]), ("x", D[3]), ("y", D[2])], "board string, at timestamp")
    got = sorted(map(tuple, membership(snaps, ["board"]).select("board", "added_at", "removed_at").collect()), key=str)
    assert got == [("x", D[0], D[2]), ("x", D[3], None), ("y", D[1], D[3])]
    late = spark.createDataFrame([("x", "a", D[0], 1), ("x", "b", D[2], 2), ("x", "c", D[1], 3), ("x", "d", D[2], 4)], "board string, attempt_id string, at timestamp, seq int")
    assert [r["attempt_id"] for r in late_gaps(late).collect()] == ["c"]


def test_the_stream_sink_recovers(spark):
    """A batch that is delivered again, to a new sink, adds nothing; an attempt behind its board's mark goes to the gaps."""
    from pyspark.sql import functions as F
    from tidemark.streaming.replay import LifecycleSink, drain, shared_folder

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    root = shared_folder(spark)
    early, middle, later = (events.where(F.dayofmonth("ts").between(a, b)) for a, b in ((1, 9), (10, 15), (16, 31)))
    early.write.parquet(f"{root}/in")
    sink = drain(spark, root, events.schema)
    LifecycleSink(root)(early, 7)
    assert spark.read.parquet(sink.log).count() == early.count()
    later.write.mode("append").parquet(f"{root}/in")
    drain(spark, root, events.schema)
    middle.write.mode("append").parquet(f"{root}/in")
    drain(spark, root, events.schema)
    log, gaps = spark.read.parquet(sink.log), spark.read.parquet(sink.gaps)
    late = middle.join(later.select("event_type").distinct(), "event_type", "left_semi").count()
    assert log.count() == early.count() + later.count() + middle.count() - late and gaps.count() == late > 0


def test_an_attempt_that_arrives_in_two_batches_is_whole(spark):
    """Every row is in the log once, however a day is cut; late attempts are in the gaps once, also when they are delivered again."""
    from pyspark.sql import functions as F
    from tidemark.streaming.replay import LifecycleSink, shared_folder

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'view'")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    days = [events.where(F.dayofmonth("ts") == d) for d in (2, 3, 1)]
    sink = LifecycleSink(shared_folder(spark))
    for k, day in enumerate(days[:2]):
        for part in (0, 1):
            sink(day.where(half == part), 2 * k + part)
    sink(days[0].where(half == 1), 4)  # again, and behind the mark, but of a known attempt
    for again in (5, 6):
        sink(days[2], again)
    rows = lambda df: sorted(r["event_id"] for r in df.select("event_id").collect())
    assert rows(spark.read.parquet(sink.log)) == rows(days[0].unionByName(days[1])) and rows(spark.read.parquet(sink.gaps)) == rows(days[2]) != []
