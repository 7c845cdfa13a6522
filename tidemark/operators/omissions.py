"""Facts that a record left out although a line of its document states them, by the library's own grammars.

Every line is read by every grammar inside its document's row, so only lines with a hit are ever shuffled. Lines in boilerplate do not count: a sweep over
lines and spans in buckets of the text finds them, so neither a range join nor a document's length decides the work of a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar

#: What ends a line, and the words that make a date a deadline.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
DEADLINE_HINT = r"(?iU)\b(?:deadline|apply by|applications?\s+close|closing date)\b"
EXCERPT = 80
#: Characters of a bucket of the sweep.
BUCKET = 4096


def stated_facts(line: Column) -> Column:
    """The facts that the grammars read in a line: compensation, deadline, experience_months."""
    numbered = line.rlike(r"(?U)\d")
    found = {
        "compensation": grammar.compensation(line).isNotNull(),
        "deadline": line.rlike(DEADLINE_HINT) & grammar.deadline(line).isNotNull(),
        "experience_months": grammar.experience_months(line).isNotNull(),
    }
    return F.when(numbered, F.array_compact(F.array(*[F.when(c, name) for name, c in found.items()]))).otherwise(F.array().cast("array<string>"))


def fact_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fact, line (from 0), start, end, excerpt: every line in which a grammar reads a fact. A null key or text has none."""
    lines = F.transform(F.split(F.col(text), LINE_END, -1), lambda t, k: F.struct(k.alias("line"), t.alias("text"), stated_facts(t).alias("facts")))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, lines.alias("_lines"))
    start = lambda x: F.aggregate(F.slice("_lines", F.lit(1), x["line"]), F.lit(0), lambda n, y: n + F.length(y["text"]) + 1)
    hits = F.transform(F.filter("_lines", lambda x: F.size(x["facts"]) > 0), lambda x: F.struct(x["facts"].alias("facts"), x["line"].alias("line"), start(x).alias("start"), x["text"].alias("text")))
    each = rows.select(key, F.explode(hits).alias("h")).select(key, F.explode("h.facts").alias("fact"), "h.line", "h.start", "h.text")
    shown = F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, EXCERPT)
    return each.select(key, "fact", "line", "start", (F.col("start") + F.length("text")).alias("end"), shown.alias("excerpt"))


def overlapped(rows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end of the distinct spans of rows (start, end) that overlap some of spans (start, end); empty spans overlap nothing.

    Both are dealt to the buckets they touch. In a bucket, in order of rows' ends and spans' starts, the furthest end so far tells whether a span reaches back
    over a row's start."""
    dealt = lambda d: d.where("start < end").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    a = dealt(rows.select(key, "start", "end").distinct()).select(key, "_bucket", F.col("end").alias("_at"), F.lit(0).alias("_side"), "start", "end", F.lit(None).cast("int").alias("_reach"))
    b = dealt(spans.select(key, F.col("start").cast("int"), F.col("end").cast("int"))).select(key, "_bucket", F.col("start").alias("_at"), F.lit(1).alias("_side"), "start", "end", F.col("end").alias("_reach"))
    before = Window.partitionBy(key, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = a.unionByName(b).withColumn("_reach", F.max("_reach").over(before))
    return swept.where((F.col("_side") == 0) & (F.col("_reach") > F.col("start"))).select(key, "start", "end").distinct()


def possible_omissions(docs: DataFrame, stated: DataFrame, boilerplate: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fact, line, excerpt: for every fact that the record of a document lacks, the first line outside boilerplate that states it.

    stated: key, fact. boilerplate: key, start, end; spans are cut to the text, so one that lies outside it or is empty says nothing. Rows of one key are
    one document. Nothing here fails a record: equity, a company's age or a posting date can look like a fact."""
    length = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("_n"))
    spans = boilerplate.select(key, "start", "end").join(length, key)
    spans = spans.select(key, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "_n").alias("end"))
    open_ = fact_lines(docs, key, text).join(stated.select(key, "fact"), [key, "fact"], "left_anti")
    kept = open_.join(overlapped(open_, spans, key), [key, "start", "end"], "left_anti")
    return kept.groupBy(key, "fact").agg(F.min(F.struct("start", "line", "excerpt")).alias("m")).select(key, "fact", "m.line", "m.excerpt")
