import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidemark.functions import grammar, identity, markdown, texts
from tidemark.operators import agreement, pages
from tidemark.sources import adapters, archive


@pytest.mark.parametrize("html,want", [
    ("<p>Hello <b>World </b>x</p>", "Hello **World** x"),
    ("<h2>A</h2><p>b</p>", "## A\n\nb"),
    ("<ul><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ul>", "- a\n  1. x\n  2. y\n- b"),
    ("a<br>b", "a\nb"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n> r"),
    ('<a href="/u">t</a> and <a>n</a>', "[t](/u) and [n]"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
    ("<script>x</script><p>y</p><hr>", "y\n\n---"),
    ("<li><p>one</p><p>two</p></li>", "- one two"),
    ("x&amp;y &lt;z&gt; ﬁ", "x&y <z> fi"),
])
def test_markdown(html, want):
    assert markdown.to_markdown(html) == want


def values(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    got = df.select(expression.alias("x")).first()["x"]
    return got.asDict() if hasattr(got, "asDict") else got


@pytest.mark.parametrize("value,cited,unit,plus,want", [
    ("5+ years", None, None, False, ("duration", "gte", 60.0, None)),
    ("3-5 years", None, None, False, ("duration", "range", 36.0, 60.0)),
    ("5-3 years", None, None, False, None),
    ("30 days per year", None, None, False, None),
    ("13 paid days per year", None, None, False, None),
    ("5", "at least", "years", False, ("duration", "gte", 60.0, None)),
    ("5", None, "Travel Percent", False, None),
    ("5", "not more than", None, False, None),
    ("3 years", "3+", None, True, None),
    ("3+ years", "3+", None, True, ("duration", "gte", 36.0, None)),
    ("3+ years", "3+", None, False, None),
    ("20%", "up to", None, False, ("percentage", "lte", None, 20.0)),
    ("2 times per week", None, None, False, ("frequency", "unstated", 2.0, 2.0)),
    ("3 and 4 and 5", None, None, False, None),
])
def test_quantity(spark, value, cited, unit, plus, want):
    q = values(spark, grammar.quantity(F.col("v"), F.col("c"), F.col("u"), plus), v=value, c=cited, u=unit)
    assert (q and (q["dimension"], q["comparison"], q["min_value"], q["max_value"])) == want


@pytest.mark.parametrize("value,cited,currency,period,label,dollar,want", [
    ("$95,000", None, None, "per year", None, None, ("unstated", "95000", "95000", None, "year")),
    ("€100k - €120k", None, None, None, None, None, ("range", "100000", "120000", "EUR", None)),
    ("$130 - $150K", None, "USD", "annually", None, None, ("range", "130000", "150000", "USD", "year")),
    ("£1 - €2", None, None, None, None, None, None),
    ("$1.5K", None, None, None, None, None, None),
    ("$228, 781", None, None, None, None, None, None),
    ("C$95,000", None, None, None, "Hourly pay", None, ("unstated", "95000", "95000", "CAD", "hour")),
    ("34 $", None, None, None, "salary", "USD", ("unstated", "34", "34", "USD", "year")),
    ("$20 $30", "between", None, "per hour", "", "USD", ("range", "20", "30", "USD", "hour")),
    ("95.000 EUR", None, None, "par an", "", None, ("unstated", "95000", "95000", "EUR", "year")),
])
def test_money(spark, value, cited, currency, period, label, dollar, want):
    wide = {} if label is None else {"label": F.col("l"), "dollar": F.col("d")}
    m = values(spark, grammar.money(F.col("v"), F.col("c"), F.col("k"), F.col("p"), **wide), v=value, c=cited, k=currency, p=period, l=label, d=dollar)
    assert (m and tuple(m[k] for k in ("comparison", "min_amount", "max_amount", "currency", "period"))) == want


@pytest.mark.parametrize("value,want", [
    ("by March 5, 2026", (dt.date(2026, 3, 5), None)), ("Sep. 1, 2025", (dt.date(2025, 9, 1), None)), ("February 30, 2025", None), ("13/02/2025", (dt.date(2025, 2, 13), None)),
    ("3/4/25", (None, [dt.date(2025, 3, 4), dt.date(2025, 4, 3)])), ("4/4/25", (dt.date(2025, 4, 4), None)), ("soon", None),
])
def test_date(spark, value, want):
    d = values(spark, grammar.date(F.col("v")), v=value)
    assert (d and (d["date"], d["candidates"])) == want


def test_requirement_and_headings(spark):
    assert values(spark, grammar.requirement(F.col("m"), F.col("h")), m="nice-to-have", h="Requirements") == "preferred"
    assert values(spark, grammar.requirement(F.col("m"), F.col("h")), m="", h="Required and Preferred") is None
    assert values(spark, texts.heading_label(F.col("t")), t="## **Requirements:** ##") == "Requirements"
    assert values(spark, texts.heading_label(F.col("t")), t="**:**") is None
    assert values(spark, texts.is_heading(F.col("t")), t="- **Bonus:** Rust") is False
    assert values(spark, texts.text_slice(F.col("t"), -3, -1), t="a😀bcd") == "bc"
    split = {
        "Python (pandas, PySpark)": ["Python"], "Python/C/C++": ["Python", "C", "C++"], "Kubernetes and/or Docker": ["Kubernetes", "Docker"], " Go ,": ["Go"], "A/B testing": ["A/B testing"], "HTTP/2": ["HTTP/2"],
        "ci/CD": ["ci/CD"], "Research and Development": ["Research and Development"], "C++, Rust": ["C++, Rust"], "a//b": ["a//b"], "": [], " (x) ": [], "TCP/IP": ["TCP/IP"], "Java / Kotlin": ["Java", "Kotlin"],
    }
    for raw, want in split.items():
        assert values(spark, texts.split_mention(F.col("t")), t=raw) == want, raw


def test_identity():
    a = {"title": " T ", "locations": ["b", "a ", "b"], "description_html": "x \n y", "workplace_type": "Remote"}
    assert identity.version_hash_of(a) == identity.version_hash_of({"title": "T", "locations": ["a", "b"], "description_html": "x y", "workplace_type": "remote", "is_remote": None})


def test_pages(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "n int, k string")
    p = pages.page(df, [("n", True), ("k", False)], limit=2)
    shown, more, cursor = p.collect()
    assert [tuple(r) for r in shown] == [(3, "a"), (2, "a")] and more and cursor == {"n": 2, "k": "a"}
    shown, more, cursor = pages.page(df, p.order, after=cursor, limit=2).collect()
    assert [tuple(r) for r in shown] == [(1, "a"), (1, "b")] and not more and cursor is None
    assert pages.glob_pattern("m-*,x?.1") == r"^(?:m\-.*|x.\.1)$"
    assert pages.merge_cursor((1, [1]), (1, [2])) == (1, [1, 2]) and pages.merge_cursor((2, [1]), (1, [9])) == (2, [1])
    with pytest.raises(ValueError):
        pages.fields(df, "n,zz")
    hashes = spark.createDataFrame([("abcd1",), ("abcd2",), ("ffff0",)], "h string")
    assert pages.resolve_prefix(hashes, "h", "abcd")[0] == "ambiguous" and pages.resolve_prefix(hashes, "h", "ffff") == ("found", ["ffff0"])


def test_agreement():
    import pandas as pd

    row = lambda slot, a, b, polarity="positive", numbers=(): dict(slot=slot, start=a, end=b, kind="qualification", polarity=polarity, numbers=list(numbers))
    same = agreement.judge(pd.DataFrame([row(0, 0, 10), row(1, 0, 9), row(2, 0, 10)]))
    assert same["passed"] and same["medoid_slot"] == 0 and same["mean_f1"] == 1.0
    assert agreement.judge(pd.DataFrame([row(0, 0, 10), row(1, 0, 10, "negative")]))["negation"]
    assert agreement.judge(pd.DataFrame([row(0, 0, 10, numbers=[3.0]), row(1, 0, 10, numbers=[4.0])]))["numeric_conflict"]
    assert agreement.judge(pd.DataFrame([row(0, 0, 10, numbers=[3.0]), row(1, 0, 10, numbers=[3.0, 4.0])]))["passed"]


def test_two_phase_sources_and_bad_bodies(spark):
    bodies = spark.createDataFrame([("a", '{"jobPostings": [{"bulletFields": ["R1"], "title": "x"}, {"externalPath": "/p2"}, {"bulletFields": []}], "total": 3}'), ("b", "not json"), ("c", '{"jobPostings": 3, "total": 1}')], "attempt_id string, body string")
    details = spark.createDataFrame([("a", "R1", '{"jobPostingInfo": {"title": " T ", "jobDescription": "<p>d</p>", "location": "B", "additionalLocations": ["A", "B"], "timeType": "Full time"}}')], "attempt_id string, source_id string, body string")
    got = {r["source_id"]: r for r in adapters.records("workday", bodies, details).collect()}
    assert set(got) == {"R1", "/p2"} and got["R1"]["locations"] == ["A", "B"] and got["R1"]["employment_type"] == "full_time" and got["R1"]["title"] == "T"
    assert got["/p2"]["status"] == "pending"
    assert {r["attempt_id"]: r["envelope_ok"] for r in adapters.envelopes(bodies, "workday").collect()} == {"a": True, "b": False, "c": False}


def test_other_sources(spark):
    one = lambda source, body, detail=None: adapters.records(source, spark.createDataFrame([("a", body)], "attempt_id string, body string"), None if detail is None else spark.createDataFrame([("a", *detail)], "attempt_id string, source_id string, body string")).first()
    r = one("ashby", '{"jobs": [{"id": "1", "title": "t", "descriptionHtml": "d", "isRemote": true, "compensation": {"summaryComponents": [{"compensationType": "Bonus"}, {"compensationType": "Salary", "minValue": 5, "currencyCode": "USD", "interval": "1 YEAR"}]}}]}')
    assert r["is_remote"] is True and r["compensation"]["min"] == 5.0 and r["compensation"]["interval"] == "year"
    r = one("amazonjobs", '{"hits": 1, "jobs": [{"id_icims": "9", "title": "t", "description": "d", "basic_qualifications": "b", "posted_date": "March  5, 2026", "job_path": "/x"}]}')
    assert r["description_html"] == "d\n<h2>Basic qualifications</h2>\nb" and r["source_created_at"] == dt.datetime(2026, 3, 5)
    r = one("smartrecruiters", '{"content": [{"id": "s"}], "totalFound": 1}', ("s", '{"name": "n", "jobAd": {"sections": {"jobDescription": {"title": "Job", "text": "x"}, "qualifications": {"text": "y"}}}, "location": {"city": "C", "remote": false}}'))
    assert r["description_html"] == "<h2>Job</h2>\nx\ny" and r["is_remote"] is None and r["locations"] == ["C"]
    r = one("eightfold", '{"positions": [{"id": 7}], "count": 1}', ("7", '{"name": "n", "job_description": "d", "t_create": 1700000000, "locations": ["b", "a"]}'))
    assert r["source_id"] == "7" and r["locations"] == ["a", "b"] and r["source_created_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)
    r = one("oraclehcm", '{"items": [{"requisitionList": [{"Id": 4}], "TotalJobsCount": 1}]}', ("4", '{"items": [{"Title": "t", "ExternalDescriptionStr": "a", "ExternalQualificationsStr": "c", "PrimaryLocation": "P", "workLocation": [{"TownOrCity": "X", "Region2": "Y"}]}]}'))
    assert r["description_html"] == "a\nc" and r["locations"] == ["P", "X, Y"]
    assert one("greenhouse", '{"jobs": [{"id": 3, "title": 5, "content": "c"}]}')["status"] == "failed"


def test_registry(spark):
    boards, revision = archive.registry(spark, '[[board]]\ncompany="C"\nsource="lever"\nboard="b"\n[[board]]\ncompany="D"\nsource="ashby"\nboard="a"\ntags=["x"]')
    assert [r["board"] for r in boards.collect()] == ["a", "b"] and len(revision) == 64
    with pytest.raises(ValueError):
        archive.registry(spark, '[[board]]\ncompany="C"\nsource="workday"\nboard="b"')


def test_aligned_equals_all_pairs():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([(s, s + rng.randint(0, 12)) for s in (rng.randrange(60) for _ in range(rng.randrange(25)))] for _ in range(2))
        meet = sorted(agreement.overlapping(a, b))
        assert meet == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if agreement.jaccard(x, y) > 0]


def test_agreement_and_binding_take_all_blocks(spark, small):
    import __spark_entry__ as entry

    queries = entry.queries()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lines = {d: [x for x in (t or "").split("\n") if x.strip()] for d, t in docs.items()}
    for r in queries["agreement_report"](spark, small).collect():  # a sample shifted by a quarter agrees, one lacks each fourth block
        n = len(lines[r["doc_id"]])
        h = n - n // 4
        assert abs(r["mean_f1"] - (1 + 2 * (2 * h / (n + h))) / 3) < 1e-8
    got = {(r["doc_id"], r["block_id"]): r for r in queries["quote_binding"](spark, small).collect()}
    assert set(got) == {(d, f"b{k + 1:06}") for d, ls in lines.items() for k in range(len(ls))}
    for d, ls in lines.items():
        for k, x in enumerate(ls):
            if k % 2 and len(x) <= 20 or x.find(x[-20:]) == len(x) - 20:
                r = got[d, f"b{k + 1:06}"]
                assert k % 2 == 0 or (r["at_end"] and r["in_block"])


def test_binding(spark):
    from tidemark.functions import binding

    doc = "Needs **Rust** and “Go”.\nNeeds Go."
    assert binding.bind(doc, (25, 34), "Needs") == (25, 30, "block")
    assert binding.bind(doc, None, "Needs") is None and binding.bind(doc, None, "Needs", lenient=True) == (0, 5, "first_document")
    assert binding.bind(doc, None, '"Go"') == (19, 23, "document_typographic")
    assert binding.bind(doc, None, "needs rust") == (0, 12, "document_emphasis")
    assert binding.places("aaaa", "aa") == [0, 1, 2] and binding.first_difference("abcdef", "bcdx") == (3, 1)
    df = spark.createDataFrame([(doc, 25, 34, "Go"), (doc, None, None, None)], "d string, a int, b int, q string")
    assert [r[0] and tuple(r[0]) for r in df.select(binding.bound(F.col("d"), F.col("a"), F.col("b"), F.col("q"))).collect()] == [(31, 33, "block"), (None, None, None)]


def test_store_and_evaluation(spark, tmp_path):
    from tidemark.operators import evaluation
    from tidemark.plans.store import Store

    store = Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None and store.cursor("c") is None
    store.publish({"t": spark.range(3)})
    first = store.current()
    with pytest.raises(ZeroDivisionError):
        store.publish({"t": spark.range(9)}, check=lambda read: 1 / 0)
    assert store.current() == first and store.table("t").count() == 3
    store.publish({"t": spark.range(4)})
    assert store.table("t").count() == 4
    at = dt.datetime(2026, 1, 1)
    store.advance("c", at, [2])
    assert store.advance("c", at, [1]) == (at, [1, 2]) and store.cursor("c") == (at, [1, 2])
    rows = [("m", "all", k, 0.0, 1.0) for k in range(20)] + [("n", "all", k, 0.0, 1.0 if k % 2 else -1.0) for k in range(20)]
    got = {r["metric"]: r["verdict"] for r in evaluation.paired_bootstrap(spark.createDataFrame(rows, "metric string, split string, doc_id int, before double, after double"), resamples=1000).collect()}
    assert got == {"m": "up", "n": "flat"}


def test_agreement_takes_many_documents_at_once(spark, monkeypatch):
    monkeypatch.setattr(agreement, "DOCUMENTS_AT_ONCE", 3)
    rows = [(d, s, a, b, "qualification", "positive", [1.0] if d % 2 else [float(s + 1)]) for d in range(20) for s in range(2) for a, b in ((0, 10), (None, None))]
    found = agreement.agree(spark.createDataFrame(rows, "doc_id long, slot int, start int, end int, kind string, polarity string, numbers array<double>").coalesce(1))
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.mean_f1, r.numeric_conflict, r.n_samples) for r in found.collect()) == [(d, 0.5, d % 2 == 0, 2) for d in range(20)]


def test_character_references_are_resolved_few_texts_at_a_time(spark):
    texts = [None, "", "plain <b>", "a &lt;b&gt; &amp;amp; c", "&eacute;&#8217;&unknown;", "R&D"] * 150
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", adapters.unescaped(F.col("t")).alias("u"))
    assert [r["u"] for r in x.orderBy("i").collect()] == [None, "", "plain <b>", "a <b> &amp; c", "é’&unknown;", "R&D"] * 150
    assert "Contains" in x._jdf.queryExecution().optimizedPlan().toString()  # texts without an ampersand stay in the JVM


def test_texts_without_a_vocabulary_word_are_not_cut(monkeypatch):
    vocabulary = {"apache license": "A", "license": "L", "c++": "C"}
    assert texts.term_matches("The LICENSE. Apache / License, c++", vocabulary) == [("L", 4, 11), ("L", 22, 29), ("C", 31, 34)]
    assert texts.term_matches("Apache license license", vocabulary) == [("A", 0, 14), ("L", 15, 22)]
    monkeypatch.setattr(texts, "_TERM", None)
    assert texts.term_matches("apache only", vocabulary) == [] and texts.term_matches("", vocabulary) == []
