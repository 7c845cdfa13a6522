"""Pay by worked lines; omissions and overlaps against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import grammar
from tidemark.operators import omissions

PAY = [
    ("Pay: $120,000 - $150,000 per year", (120000, 150000, None, "year")), ("$130 - $150K", (130000, 150000, None, None)), ("£100,000 - €120,000", None),
    ("136,000 USD - 218,500 USD for Level 3", (136000, 218500, "USD", None)), ("EUR 71.000 to EUR 95.000", (71000, 95000, "EUR", None)), ("EUR 71.000 to GBP 95.000", None),
    ("65,000−87,500 OTE annually", (65000, 87500, None, "year")), ("10,000 - 20,000 stock options annually", None), ("65,000−87,500 OTE", None),
    ("up to $180,000", (None, 180000, None, None)), ("starting at $140,000/yr", (140000, None, None, "year")), ("Level 2 PLN 45,000", (45000, 45000, "PLN", None)),
    ("Level 2 800 - 1,200 USD", None), ("kr 850 000", (850000, 850000, None, None)), ("$40/hour to $65/hour", (40, 65, None, "hour")), ("CA$ 90,000", (90000, 90000, "CAD", None)),
    ("210 300.00 USD - 273 400.00 USD", None), ("Step 7 125 USD", None), ("100K USD", (100000, 100000, "USD", None)), ("$5 and $6", None), ("$150,000 - $120,000", None),
    ("Kč 90 000 – KČ 95 000", (90000, 95000, "CZK", None)), ("firm 5", None), ("no pay", None), ("", None), (None, None), ("$" + "9" * 40, None),
]


def test_pay(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PAY)], "k int, t string").select("k", grammar.compensation(F.col("t")).alias("c")).collect()
    got = {r.k: r.c and (*(x if x is None else int(x) for x in (r.c.min, r.c.max)), r.c.currency, r.c.period) for r in rows}
    assert got == {k: want for k, (_, want) in enumerate(PAY)}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(omissions, "BUCKET", 7)
    rng = random.Random(seed)
    span = lambda: (rng.randint(0, 3), *(a := rng.randint(0, 60), a + rng.randint(0, 25)))
    a, b = [span() for _ in range(80)], [span() for _ in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, start int, end int")
    got = [tuple(r) for r in omissions.overlapped(frame(a), frame(b)).collect()]
    want = {x for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_omissions(spark):
    texts = [
        (1, "We pay $10 a day\n  Apply by May 3, 2027 \r\n5+ years\n6+ years"),  # the first line of a fact
        (2, "$10\n\n$20\n" + "x" * 200 + " $30"),  # the first is boilerplate
        (3, "deadline soon\nMay 3, 2027"),  # the word and the date on different lines
        (4, "$10"), (5, ""), (6, None), (None, "$10"), (7, "$10"), (8, "a $10 " + "b" * 100),
    ]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    stated = spark.createDataFrame([(4, "compensation"), (1, "experience_months"), (99, "deadline")], "doc_id int, fact string")
    spans = spark.createDataFrame([(2, -5, 1), (2, 1, 1), (7, 3, 99), (None, 0, 9)], "doc_id int, start int, end int")
    got = {(r.doc_id, r.fact): (r.line, r.excerpt) for r in omissions.possible_omissions(docs, stated, spans).collect()}
    assert got == {(1, "compensation"): (0, "We pay $10 a day"), (1, "deadline"): (1, "Apply by May 3, 2027"), (2, "compensation"): (2, "$20"), (7, "compensation"): (0, "$10"), (8, "compensation"): (0, ("a $10 " + "b" * 100)[:80])}
    assert omissions.possible_omissions(docs.where(F.lit(False)), stated, spans).count() == 0
