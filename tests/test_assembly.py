"""Assembly against expectations written out by hand, and seals against Python's canonical JSON."""

import hashlib
import json
import time
from copy import deepcopy

from pyspark.sql import functions as F
from tidemark.functions.identity import canonical_json
from tidemark.operators import assembly, sealing

TEXT = "# Role\nBuild *fast* tools\n\n## Pay\nSalary:\n$100,000 - $120,000\nAt least 5 years of Straße work\nBuild it"
EMIT = {
    "source_assessment": {"usability": "usable", "evidence": [], "note": None},
    "statements": [
        {"id": "s1", "kind": "responsibility", "topic": "tools \"x\"", "evidence": [{"block_id": "b000002", "text": None, "occurrence": None}, {"block_id": "b000002", "text": "Build fast", "occurrence": 0}],
         "polarity": "positive", "condition_ids": ["c1"], "unresolved": [{"reason": "why", "evidence": [{"block_id": "b000003", "text": "Pay", "occurrence": 7}]}]},
        {"id": "s2", "kind": "qualification", "subject": 3, "evidence": [{"block_id": "b000006", "text": "5 years", "occurrence": 0}], "modality_evidence": [{"block_id": "b000006", "text": "At least", "occurrence": 0}]},
    ],
    "relations": {"groups": [{"id": "g", "operator": "any_of", "members": ["s1", "s2"]}], "conditions": [], "tracks": {"selection": "one", "items": [
        {"id": "t", "name_evidence": [{"block_id": "b000001", "text": "Role", "occurrence": 0}], "evidence": [{"block_id": "b000001", "text": None, "occurrence": None}], "open": True, "statement_ids": ["s2", "gone"], "mention_ids": ["lost"]}]}},
    "facts": {
        "presence": {"experience": {"state": "none_found"}, "dates": {"state": "stated"}, "compensation": {"state": "stated", "evidence": [{"block_id": "b000003", "text": "Pay", "occurrence": 0}]},
                     "sponsorship": {"state": "stated", "polarity": "negative", "evidence": [{"block_id": "b000001", "text": "Role", "occurrence": 0}]}},
        "entries": [
            {"id": "f1", "family": "experience", "statement_ids": ["s2"], "evidence": {"value": [{"block_id": "b000006", "text": "5 years", "occurrence": 0}], "comparison": [{"block_id": "b000006", "text": "At least", "occurrence": 0}]}},
            {"id": "f2", "family": "quantity", "scope": {"kind": "team", "evidence": None}, "evidence": {"value": [{"block_id": "b000002", "text": None, "occurrence": None}]}}]},
    "mentions": [{"id": "m1", "surface": " STRAßE ", "type": "skill", "evidence": {"block_id": "b000002", "text": "build", "occurrence": 0}, "statement_ids": ["s9", "s2", 4]}, {"id": "m2", "surface": "x", "evidence": {"block_id": "b000006", "text": "work", "occurrence": 0}, "statement_ids": ["s9"]}],
    "areas": [{"id": "a", "name": "Tools", "kind": "area", "statement_ids": ["s1"]}],
    "block_accounting": [{"block_id": "b000001", "disposition": "heading", "ref_ids": []}],
}

def _assembled(spark, *emits, text=TEXT):
    rows = [(k, e if isinstance(e, str) or e is None else json.dumps(e), text, "d", "md/1") for k, e in enumerate(emits)]
    e = spark.createDataFrame(rows, "doc_id int, emit string, text string, document_hash string, normalizer_version string")
    left = {"model": F.lit("m"), "schema_version": F.lit("4"), "at": F.lit("2026-01-01"), "parent_candidate_hash": F.lit(None).cast("string")}
    got = assembly.assemble(e, left).select("doc_id", sealing.canonical(F.col("record")).alias("record"), "candidate_hash", "errors").collect()
    return {r["doc_id"]: r for r in got}


def _hash_of(record):
    shadow = deepcopy(record)
    shadow["extraction"]["candidate_hash"], shadow["quality"] = "", None
    if isinstance(shadow.get("mentions"), list):
        shadow["mentions"] = [m for m in shadow["mentions"] if m.get("origin") != "skill_pass"]
    return hashlib.sha256(canonical_json(shadow).encode()).hexdigest()


def test_a_record_is_bound_derived_pruned_and_sealed(spark):
    row = _assembled(spark, EMIT)[0]
    assert row["errors"] == []
    r = json.loads(row["record"])
    assert canonical_json(r) == row["record"] and r["extraction"]["candidate_hash"] == row["candidate_hash"] == _hash_of(r)
    ref = lambda block, text, occurrence=0: {"block_id": block, "text": text, "span": [TEXT.index(text), TEXT.index(text) + len(text)], "occurrence": occurrence}
    whole = ref("b000002", "Build *fast* tools")
    s1, s2 = r["statements"]
    assert s1 == {"id": "s1", "kind": "responsibility", "subject": None, "topic": 'tools "x"', "evidence": [whole, ref("b000002", "Build *fast")], "section_heading": "Role", "modality_evidence": None,
                  "polarity": "positive", "polarity_evidence": None, "condition_ids": ["c1"], "fact_ids": [], "unresolved": [{"reason": "why", "evidence": [ref("b000003", "Pay")]}]}
    assert s2["subject"] == 3 and s2["section_heading"] == "Pay" and s2["modality_evidence"] == [ref("b000006", "At least")]
    assert r["source_assessment"] == {"usability": "usable", "note": None, "evidence": None}
    f1, f2 = r["facts"]["entries"]
    assert f1["derived"] == {"state": "parsed", "money": None, "date": None, "quantity": {"dimension": "duration", "comparison": "gte", "min_value": 60.0, "max_value": None, "inclusive_min": True, "inclusive_max": None, "unit": "month"}}
    assert f2["derived"] == {"state": "present_unparsed", "money": None, "date": None, "quantity": None} and f2["scope"] == {"kind": "team", "evidence": None}
    assert f2["evidence"]["value"] == [whole] and f2["evidence"]["unit"] is None
    p = r["facts"]["presence"]
    assert {k: v["state"] for k, v in p.items()} == {"experience": "stated", "quantities": "stated", "dates": "none_found", "compensation": "unresolved", "sponsorship": "stated", "citizenship": None, "work_authorization": None}
    assert r["authorization"] == {"sponsorship": "no", "citizenship_required": False, "evidence": {"sponsorship": [ref("b000001", "Role")], "citizenship": None, "work_authorization": None}}
    m1, m2 = r["mentions"]
    assert m1["statement_ids"] == ["s2"] and m1["normalized_key"] == "strasse" and m1["evidence"] == ref("b000002", "Build") and m2["statement_ids"] == ["s9"]
    assert r["relations"]["tracks"]["items"][0]["statement_ids"] == ["s2"] and r["relations"]["tracks"]["items"][0]["mention_ids"] == ["lost"]
    assert r["extraction"]["dropped_links"] == [
        {"path": "relations.tracks.items[0].statement_ids", "ref_id": "gone"}, {"path": "mentions[0].statement_ids", "ref_id": "s9"}, {"path": "mentions[0].statement_ids", "ref_id": 4}]
    assert r["relations"]["groups"] == [{"id": "g", "operator": "any_of", "members": ["s1", "s2"], "evidence": None}]
    assert r["quality"]["source"] == "usable" and r["quality"]["search_eligible"] is False


def test_all_errors_come_at_once_and_no_record(spark):
    bad = deepcopy(EMIT)
    bad["statements"][0]["evidence"] = "no list"
    bad["statements"][1]["evidence"] = [{"block_id": "b9", "text": None, "occurrence": None}, 5, {"block_id": "b000001", "text": "Role", "occurrence": None}]
    bad["mentions"][0]["evidence"] = None
    bad["areas"][0]["name"] = "zero​width"
    bad["areas"][0]["evidence"] = [{"block_id": "b000001", "text": "nowhere", "occurrence": 0}]
    got = _assembled(spark, bad, None, "[1]", "{", {})
    assert got[0]["record"] is None and got[0]["candidate_hash"] is None
    assert got[0]["errors"] == [
        "emit.areas[0].name: control character U+200B in emitted string", "statements[0].evidence: expected a non-empty list of references", "statements[1].evidence[0]: unknown_block",
        "statements[1].evidence[1]: expected a reference object", "statements[1].evidence[2]: text_without_occurrence", "mentions[0].evidence: expected a reference object", "areas[0].evidence[0]: not_found"]
    assert all(got[k]["errors"] == ["emit: not an object"] and got[k]["record"] is None for k in (1, 2, 3))
    empty = json.loads(got[4]["record"])
    assert got[4]["errors"] == [] and empty["statements"] == [] and empty["relations"]["tracks"] is None and "dropped_links" not in empty["extraction"]


def test_null_texts_and_empty_tables(spark):
    got = _assembled(spark, {}, EMIT, text=None)
    assert got[0]["errors"] == [] and all(e.endswith("unknown_block") for e in got[1]["errors"])
    assert _assembled(spark, *[]) == {}


def test_hashes_equal_those_of_canonical_json(spark):
    base = {"extraction": {"candidate_hash": "old", "model": "é\"\\/\t\n"}, "quality": {"x": 1}, "statements": [{"b": 1, "a": [None, True, -3, "😀"]}]}
    odd = [base, base | {"mentions": []}, base | {"mentions": [{"origin": "skill_pass", "id": "p"}, {"id": "m", "origin": None}]}, base | {"mentions": "none"}, base | {"mentions": None}]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(odd)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    for r in rows.select("k", sealing.candidate_hash(F.col("v")).alias("h"), sealing.object_hash(F.col("v")).alias("o")).collect():
        assert r["h"] == _hash_of(odd[r["k"]]), odd[r["k"]]
        assert r["o"] == hashlib.sha256(canonical_json(odd[r["k"]]).encode()).hexdigest()


def test_emits_are_made_without_a_shuffle(spark, small):
    from tidemark.catalogue.assembly import extractions
    made = extractions(spark, small)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_references_meet_their_document_in_one_join(spark):
    """Nothing of a reference or of its block is joined again after it is bound, and each side is shuffled once."""
    rows = spark.createDataFrame([(1, json.dumps(EMIT), TEXT)], "doc_id int, emit string, text string").withColumn("emit", F.parse_json("emit"))
    bound = assembly._bound(rows)
    plan = bound._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange") == 2 and plan.count("posexplode") == 3, plan
    got = {r["ref_id"]: (r["ref"]["block_id"], r["ref"]["section_heading"], r["pay"] and r["pay"]["label"]) for r in bound.collect()}
    assert got["statements[1].evidence[0]"] == ("b000006", "Pay", None) and got["mentions[0].evidence"] == ("b000002", "Role", None)
    assert got["facts.entries[0].evidence.value[0]"] == ("b000006", "Pay", "$100,000 - $120,000 At least 5 years of Straße work")


def test_links_of_many_mentions_are_looked_up_once_a_document(spark):
    """400 mentions with links to 400 statements: the statements' ids are not read again for each link."""
    n = 400
    cite = {"block_id": "b000001", "text": None, "occurrence": None}
    emit = {"statements": [{"id": f"s{k}", "evidence": [cite]} for k in range(n)], "mentions": [{"id": f"m{k}", "surface": "x", "evidence": cite, "statement_ids": [f"s{k}", f"s{n + k}", "x"]} for k in range(n)]}
    began = time.monotonic()
    r = json.loads(_assembled(spark, emit)[0]["record"])
    assert [m["statement_ids"] for m in r["mentions"]] == [[f"s{k}"] for k in range(n)]
    assert r["extraction"]["dropped_links"] == [{"path": f"mentions[{k}].statement_ids", "ref_id": x} for k in range(n) for x in (f"s{n + k}", "x")]
    assert time.monotonic() - began < 60


def test_other_dollars_are_sought_where_there_is_pay(spark):
    cite = lambda text: [{"block_id": "b000001", "text": text, "occurrence": 0}]
    pay = {"facts": {"entries": [{"id": "f", "family": "compensation", "evidence": {"value": cite("$100,000 - $120,000"), "unit": cite("per year")}}]}}
    for more, currency in (("", "USD"), ("\nin Canada", None), ("\n \nC$ 5", None)):
        r = json.loads(_assembled(spark, pay, text=f"Base salary $100,000 - $120,000 per year{more}")[0]["record"])
        assert r["facts"]["entries"][0]["derived"]["money"]["currency"] == currency
