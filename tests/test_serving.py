"""The served slice against plain Python, dropped objects, and containment without a join of all pairs."""

import json
import random
import time
import re

from pyspark.sql import functions as F
from tidemark.operators import containment, retries, serving


def _tables(spark, record):
    """A record (doc_id 1) as its flat tables."""
    refs = [(1, owner, x["id"], a, b, t) for owner, key in (("statement", "statements"), ("mention", "mentions"), ("fact", "facts")) for x in record[key] for a, b, t in x["refs"]]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = [(1, x["id"], x["topic"], x["kind"], x["importance"], x["proficiency"], x["polarity"], x["subject"], None, None, k) for k, x in enumerate(record["statements"])]
    return (
        of(s, "doc_id int, statement_id string, topic string, kind string, importance string, proficiency string, polarity string, subject string, section_heading string, modality string, pos int"),
        of([(1, x["id"], x["surface"], x["statement_ids"], k) for k, x in enumerate(record["mentions"])], "doc_id int, mention_id string, surface string, statement_ids array<string>, pos int"),
        of([(1, x["id"], x["family"], x["statement_ids"], x["signature"], k) for k, x in enumerate(record["facts"])], "doc_id int, fact_id string, family string, statement_ids array<string>, signature string, pos int"),
        of([(1, g["operator"], g["members"]) for g in record["groups"]], "doc_id int, operator string, members array<string>"),
        of(refs, "doc_id int, owner string, owner_id string, start int, end int, text string"),
    )


def _walk(record):
    """Areas with their claims, one object after another."""
    known = {s["id"]: s for s in record["statements"]}
    values = {i: sorted(f["signature"] for f in record["facts"] for x in f["statement_ids"] if x == i) for i in known}
    links = {i: sorted({m["surface"].casefold() for m in record["mentions"] if i in m["statement_ids"]}) for i in known}

    def claim(s, x, told):
        spans = sorted(x["refs"])
        return (x["id"], min(a for a, _, _ in spans), max(b for _, b, _ in spans), " ".join(t for _, _, t in spans), s and s["importance"], bool(s and s["polarity"] != "positive"),
                f"{s['polarity']}:{s['subject']}" if s and s["polarity"] != "positive" else None, told, links[s["id"]] if s else [],
                sorted((g["operator"], g["members"]) for g in record["groups"] for m in g["members"] if s and m == s["id"]))

    areas = {i: (s["topic"], s["kind"], s["importance"] or "contextual", [claim(s, s, values[i])]) for i, s in known.items()}
    for m in record["mentions"]:
        for i in m["statement_ids"]:
            if i in known:
                areas[i][3].append(claim(known[i], m, values[i]))
    for f in record["facts"]:
        anchor = next((known[i] for i in f["statement_ids"] if i in known), None)
        if anchor:
            areas[anchor["id"]][3].append(claim(anchor, f, [f["signature"]]))
        else:
            areas[f["id"]] = (f["family"], "fact", "contextual", [claim(None, f, [f["signature"]])])
    return [(i, *a) for i, a in areas.items()]


def test_claim_index_of_random_records(spark):
    rng = random.Random(6)
    for _ in range(3):
        cites = lambda: {"refs": [(a := rng.randrange(90), a + rng.randrange(1, 9), rng.choice("abc")) for _ in range(rng.randint(1, 3))]}
        n = rng.randint(0, 5)
        some = lambda: [f"s{rng.randrange(7)}" for _ in range(rng.randint(0, 3))]
        record = {
            "statements": [{"id": f"s{i}", "topic": f"t{i}", "kind": rng.choice(["qualification", "benefit"]), "importance": rng.choice([None, "required"]), "proficiency": None, "polarity": rng.choice(["positive", "negative"]), "subject": "x", **cites()} for i in range(n)],
            "mentions": [{"id": f"m{i}", "surface": rng.choice(["Go", "Straße", "GO"]), "statement_ids": some(), **cites()} for i in range(4)],
            "facts": [{"id": f"f{i}", "family": "pay", "statement_ids": some(), "signature": f"v{rng.randrange(3)}", **cites()} for i in range(4)],
            "groups": [{"operator": rng.choice(["any_of", "all_of"]), "members": [f"s{i}", f"s{i + 1}"]} for i in range(3)],
        }
        found = serving.profiles(serving.claim_index(*_tables(spark, record))).collect()
        got = [(a["id"], a["name"], a["kind"], a["importance"], [(c["owner_id"], c["start"], c["end"], c["quote"], c["importance"], c["negated"], c["polarity_target"], c["values"], c["entity_links"], [tuple(r) for r in c["alternatives"] or []]) for c in a["claims"]]) for r in found for a in r["areas"]]
        assert got == _walk(record)


def _dropped(prior, current, fed):
    """Plain Python over nested records."""
    def tracked(record, path):
        for k in path.split("."):
            record = record.get(k) if isinstance(record, dict) else None
        return record if isinstance(record, list) else []

    out = []
    for path in retries.TRACKED:
        kept = [x["id"] for x in tracked(current, path) if isinstance(x, dict) and isinstance(x.get("id"), str)]
        for k, x in enumerate(tracked(prior, path)):
            if isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"] and x["id"] not in kept:
                tokens = (x["id"], f"{path}[{k}]", f"{path.replace('.', '/')}/{k}")
                if not any(re.search(rf"(?<![0-9A-Za-z_-]){re.escape(t)}(?![0-9A-Za-z_-])", e) for t in tokens for e in fed):
                    out.append((path, k, x["id"]))
    return sorted(out)


def test_unexplained_deletions(spark):
    rng = random.Random(9)
    thing = lambda: rng.choice([{"id": f"s{rng.randrange(13)}"}, {"id": rng.randrange(9)}, {"id": ""}, {"id": None}, {}, "s1", None, {"id": "a.b\\E("}, {"id": "s1-alt"}])
    lists = lambda: rng.choice([[thing() for _ in range(rng.randrange(13))], [thing() for _ in range(3)], None, {"id": "s1"}, "x"])
    record = lambda: {"statements": lists(), "mentions": lists(), "relations": rng.choice([{"groups": lists(), "conditions": lists()}, None, []]), "facts": {"entries": lists()}}
    errors = ["statements[1] odd", "mentions/3: x", "s1-alt is odd", "no s2", "facts/entries/1", "relations.groups[0]", "xs3", "a.b\\E( told", "statements[10]"]
    cases = [(i, record(), record(), rng.sample(errors, rng.randrange(4))) for i in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(p), json.dumps(c), f) for i, p, c, f in cases] + [(99, None, "no json", None)], "doc_id int, prior string, current string, fed array<string>")
    got = {}
    for r in retries.unexplained_deletions(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["path"], r["index"], r["id"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: d for i, p, c, f in cases if (d := _dropped(p, c, f))}


def test_objects_of_records_are_never_broadcast(spark):
    few = spark.createDataFrame([(1, '{"statements": [{"id": "a"}]}', "{}", None)], "doc_id int, prior string, current string, fed array<string>")
    found = retries.unexplained_deletions(few)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "statements", 0, "a")]


def test_containment_finds_every_pair_without_a_nested_loop(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "é", "".join(rng.choice("ab ") for _ in range(rng.randint(1, 30))), "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))])
    left, right = [(i, text()) for i in range(120)], [(i, text()) for i in range(150)] + [(900, "the very long one with é in it " * 3)]
    a, b = (spark.createDataFrame(x, "id int, text string") for x in (left, right))
    found = containment.overlapping(a, b)
    want = {(i, j) for i, x in left for j, y in right if x and y and (x in y or y in x)}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.overlapping(a.where("false"), b).count() == 0 and containment.overlapping(a, b.where(F.lit(False))).count() == 0


def test_containment_takes_time_by_the_bytes_of_a_long_text(spark):
    """One line of 600,000 bytes, held by none and holding some: its n-grams come in one sweep, not each from the line's beginning."""
    long = " ".join(f"w{i}é" for i in range(75_000))
    needles = [(0, long[400_000:400_050]), (1, "w74999é"), (2, "w75000é"), (3, "x" + long), (4, long[:16])]
    began = time.monotonic()
    found = containment.overlapping(spark.createDataFrame(needles, "id int, text string"), spark.createDataFrame([(0, long), (1, "w7")], "id int, text string"))
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0), (3, 1), (4, 0)]  # w7 is a part of some
    assert time.monotonic() - began < 60


def test_a_claim_index_reads_its_tables_once_and_shuffles_them_twice(spark):
    record = {"statements": [{"id": "s1", "topic": "t", "kind": "benefit", "importance": None, "proficiency": None, "polarity": "positive", "subject": "x", "refs": [(1, 2, "a")]}],
              "mentions": [{"id": "m1", "surface": "Go", "statement_ids": ["s1", "s1", "s9"], "refs": []}], "groups": [],
              "facts": [{"id": "f1", "family": "pay", "statement_ids": ["s9", "s1"], "signature": "v", "refs": []}, {"id": "f2", "family": "pay", "statement_ids": [], "signature": None, "refs": []}]}
    found = serving.claim_index(*_tables(spark, record))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 6 and plan.count("Exchange ") <= 3, plan
    got = sorted((r["source"], r["owner_id"], r["area_id"], r["area_kind"], r["values"], r["start"]) for r in found.collect())
    assert got == [("fact", "f1", "s1", "benefit", ["v"], None), ("fact", "f2", "f2", "fact", [None], None),
                   ("mention", "m1", "s1", "benefit", ["v"], None), ("mention", "m1", "s1", "benefit", ["v"], None), ("statement", "s1", "s1", "benefit", ["v"], 1)]


def test_a_claim_index_shuffles_its_objects_once(spark, small):
    """Also with equal ids, nulls in lists, ids and keys, and references to nothing."""
    from tidemark.catalogue.serving import QUERIES
    plan = QUERIES["claim_index"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Scan parquet") == 1 and "Join" not in plan, plan
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = lambda doc, i, topic, pos: (doc, i, topic, "benefit", None, None, "positive", "x", None, None, pos)
    tables = (
        of([s(1, "s1", "a", 0), s(1, "s1", "b", 1), s(1, None, "n", 2), s(None, "s1", "z", 0)], "doc_id int, statement_id string, topic string, kind string, importance string, proficiency string, polarity string, subject string, section_heading string, modality string, pos int"),
        of([(1, "m1", "Go", [None, "s1"], 0), (1, "m2", "No", None, 1), (None, "m3", "Go", ["s1"], 0)], "doc_id int, mention_id string, surface string, statement_ids array<string>, pos int"),
        of([(1, "f1", "pay", [None, "s9", "s1"], "v", 0), (1, "f1", "pay", ["s9"], "w", 1), (1, None, "pay", ["s1"], "x", 2), (2, "f1", "pay", ["s1"], "y", 0)], "doc_id int, fact_id string, family string, statement_ids array<string>, signature string, pos int"),
        of([(1, "any_of", ["s1", None]), (None, "any_of", ["s1"])], "doc_id int, operator string, members array<string>"),
        of([(1, "mention", "m1", 5, 9, "q"), (1, "mention", "m1", 1, 3, None), (1, "fact", "f9", 0, 1, "gone"), (1, "statement", None, 0, 1, "x"), (None, "statement", "s1", 0, 1, "x"), (1, "area", "s1", 0, 1, "x"), (1, "fact", "f1", 2, None, "p")],
           "doc_id int, owner string, owner_id string, start int, end int, text string"))
    found = serving.claim_index(*tables)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = sorted(((r["doc_id"], r["source"], r["owner_id"], r["area_id"], r["area_name"], r["values"], r["entity_links"], r["alternatives"] and [r["members"] for r in r["alternatives"]], r["start"], r["end"], r["quote"]) for r in found.collect()), key=repr)
    told, links, routes = ["v", "x"], ["go"], [["s1", None]]
    want = [
        *[(1, "statement", "s1", "s1", t, told, links, routes, None, None, None) for t in "ab"], (1, "statement", None, None, "n", [], [], None, None, None, None), (None, "statement", "s1", "s1", "z", [], [], None, None, None, None),
        *[(1, "mention", "m1", "s1", t, told, links, routes, 1, 9, " q") for t in "ab"], *[(1, "fact", "f1", "s1", t, [v], links, routes, 2, None, "p") for t in "ab" for v in "vw"],
        (1, "fact", None, None, "pay", ["x"], [], None, None, None, None), (2, "fact", "f1", "f1", "pay", ["y"], [], None, None, None, None)]
    assert got == sorted(want, key=repr)
