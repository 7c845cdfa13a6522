"""Disputes of samples against a plain walk over all pairs of claims, and audits case by case."""

import random

from pyspark.sql import functions as F
from tidemark.operators import disputes

CLAIMS = "doc_id int, slot int, claim int, start int, end int, owner string"


def _greedy(a, b):
    """Pairs of all claims, best first."""
    def share(x, y):
        both = min(x[3], y[3]) - max(x[2], y[2])
        return both / (max(x[3], y[3]) - min(x[2], y[2])) if both > 0 else 0.0

    proper = lambda c: c[2] is not None and c[3] is not None and c[2] < c[3]
    ranked = sorted(((-share(x, y), x[1], y[1]) for x in a for y in b if proper(x) and proper(y)))
    left, right, out = set(), set(), set()
    for s, i, j in ranked:
        if -s >= 0.5 and i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.add((i, j))
    return out


def test_disputes_against_a_walk(spark):
    rng = random.Random(7)
    claims, cited = [], []
    for doc in range(30):
        for slot in range(rng.randint(1, 4)):
            for k in range(rng.randint(1, 8)):
                a = rng.randint(0, 30)
                span = (None, None) if rng.random() < 0.1 else (a, a + rng.randint(0, 9))
                claims.append((doc, slot, k, *span, None if rng.random() < 0.05 else f"s{rng.randint(0, 5)}"))
                cited.append((doc, slot, f"b{rng.randint(0, 9)}"))
    of = {}
    for d, s, *rest in claims:
        of.setdefault(d, {}).setdefault(s, []).append((s, *rest))
    expected_ids, expected_scope, expected_medoid = set(), set(), {}
    for d, samples in of.items():
        score = {s: [2 * len(_greedy(samples[min(s, t)], samples[max(s, t)])) / (len(samples[s]) + len(samples[t])) for t in samples if t != s] for s in samples}
        mean = {s: sum(v) / len(v) if v else 1.0 for s, v in score.items()}
        m = min(mean, key=lambda s: (-round(mean[s], 12), s))
        expected_medoid[d] = m
        lost = set()
        for t in samples:
            if t != m:
                met = {i for i, _ in _greedy(samples[m], samples[t])}
                lost |= {c[4] for c in samples[m] if c[1] not in met}
        expected_ids |= {(d, "statement", o) for o in lost if o is not None}
        own = {b for x, s, b in cited if x == d and s == m}
        expected_ids |= {(d, "block", b) for x, s, b in cited if x == d and s != m and b not in own}
        expected_scope.add((d, None not in lost))
    c, z = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(cited, "doc_id int, slot int, block_id string")
    pairs = disputes.sample_pairs(c)
    chosen = disputes.medoids(c, pairs, disputes.alignments(c, pairs))
    got = {r.doc_id: (r.medoid_slot, round(r.mean_f1, 12)) for r in chosen.collect()}
    assert got.keys() == expected_medoid.keys()
    assert {d: m for d, (m, _) in got.items()} == expected_medoid
    ids, scope = disputes.dispute_set(c, z, chosen)
    rows = [tuple(r) for r in ids.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected_ids
    assert {tuple(r) for r in scope.collect()} == expected_scope


def test_dispute_without_siblings_or_claims(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 5, "s0"), (2, 0, 0, 0, 5, "s0")], CLAIMS)
    cited = spark.createDataFrame([(1, 0, "b1"), (2, 1, "b2")], "doc_id int, slot int, block_id string")
    pairs = disputes.sample_pairs(c)
    chosen = disputes.medoids(c, pairs, disputes.alignments(c, pairs))
    ids, scope = disputes.dispute_set(c, cited, chosen)
    assert {tuple(r) for r in ids.collect()} == {(2, "statement", "s0"), (2, "block", "b2")}, "a sample that only cites is a sibling as well"
    assert all(r.scoped for r in scope.collect())
    empty = c.where(F.lit(False))
    none = disputes.alignments(empty, disputes.sample_pairs(empty))
    assert none.count() == 0 and disputes.medoids(empty, disputes.sample_pairs(empty), none).count() == 0


def test_audits(spark):
    ids = spark.createDataFrame([(d, "statement", "s1") for d in range(20)] + [(9, "block", "b7")], "doc_id int, kind string, id string")
    scope = spark.createDataFrame([(d, d != 8) for d in range(20) if d != 11], "doc_id int, scoped boolean")
    done, none = "findings", "no_findings"
    audits = [(0, none, none, 0), (1, done, done, 1), (2, done, done, 1), (3, done, done, 1), (4, done, done, 2), (5, done, done, 0), (6, "error", none, 0), (7, done, done, 1), (8, done, done, 1),
              (9, done, done, 1), (10, done, done, 1), (11, none, none, 0), (12, None, none, 0), (13, done, done, 1), (14, done, done, None)]
    a = spark.createDataFrame([(*x, ["negation"]) for x in audits], "doc_id int, semantics string, completeness string, blocking int, failed_gates array<string>")
    items = [
        (1, 0, False, "blocking", "other", ["s2"], None),  # placed, clear
        (2, 0, False, "blocking", "other", ["s1"], None),  # in dispute
        (3, 0, False, "blocking", "polarity_subject", ["s2"], None),  # the failed gate's code
        (4, 0, False, "blocking", "other", ["s2"], None),  # one of two is out of sight
        (5, 0, False, "warning", "other", ["s1"], None),  # warnings never gate
        (7, 0, False, None, "other", [], None),  # names nothing; no severity is no warning
        (8, 0, False, "blocking", "other", ["s2"], None),  # no scope
        (9, 0, False, "blocking", "other", None, "b7"),  # by its citation
        (10, 0, True, "warning", "polarity_subject", ["s2"], None),  # a question has no code, and no severity
        (13, 0, True, None, None, None, None),  # a question that names nothing
    ]
    t = spark.createDataFrame(items, "doc_id int, item int, question boolean, severity string, code string, targets array<string>, block_id string")
    got = {r.doc_id: (r.clean, r.off_dispute) for r in disputes.audit_scoping(a, t, ids, scope).collect()}
    assert {d for d, (c, _) in got.items() if c} == {0, 11}
    assert {d for d, (_, o) in got.items() if o} == {0, 1, 5, 10}
    assert len(got) == len(audits)


def test_alignments_take_many_pairs_at_once(spark, monkeypatch):
    """No group of its own for every pair of samples, and no pair is lost where a batch is cut."""
    monkeypatch.setattr(disputes, "PAIRS_AT_ONCE", 7)
    claims = spark.createDataFrame([(d, s, k, 10 * k, 10 * k + 8 + s, f"s{k}") for d in range(50) for s in range(3) for k in range(3)], CLAIMS).coalesce(1)
    found = disputes.alignments(claims, disputes.sample_pairs(claims))
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(d, a, b, k, k) for d in range(50) for a in range(3) for b in range(a + 1, 3) for k in range(3)]
