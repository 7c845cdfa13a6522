"""Text operators over documents and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binding, markdown, texts
from ..plans.snapshots import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def annotate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.annotate(_docs(spark, sf_dir))


def block_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.block_intervals(_docs(spark, sf_dir))


def find_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.occurrences(_docs(spark, sf_dir), "thth")


def document_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", texts.text_slice(t, 10, 60).alias("middle"), texts.text_slice(t, -25, None).alias("last"), texts.text_slice(t, None, -30).alias("front"))


def offset_line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, column = texts.line_column(F.col("text"), F.col("start"))
    found = texts.occurrences(_docs(spark, sf_dir), "thth").groupBy("doc_id").agg(F.max("start").alias("start"))
    return _docs(spark, sf_dir).join(found, "doc_id").select("doc_id", "start", line.alias("line"), column.alias("column"))


def section_heading_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth block as a heading of its first letters; every fifteenth has an empty label and ends a section."""
    n = F.substring("block_id", 2, 6).cast("int")
    label = F.when(n % 15 != 0, F.substring("text", 1, 12))
    return texts.under_headings(texts.annotate(_docs(spark, sf_dir)), heading=n % 5 == 0, label=label).select("doc_id", "block_id", "section_heading")


def coverage_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.repeated_lines(texts.annotate(_docs(spark, sf_dir)))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans around every occurrence."""
    found = texts.occurrences(_docs(spark, sf_dir), "tion")
    return found.select("doc_id", F.greatest(F.col("start") - 20, F.lit(0)).alias("start"), (F.col("start") + 4 + F.col("start") % 30).alias("end"))


def interval_merge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.merged_length(_spans(spark, sf_dir), ["doc_id"])


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span against the next of its document."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start", "end")
    pairs = _spans(spark, sf_dir).withColumns({"_s": F.lead("start").over(order), "_e": F.lead("end").over(order)}).where("_s is not null")
    return pairs.select("doc_id", "start", F.round(texts.span_jaccard(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")), 9).alias("jaccard"))


def typographic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(texts.typographic_fold(F.concat(F.lit("“q” – ‘x’ ‚a‛ „b‟ ‒ — − ‐\u00a0\u2009\u202f"), F.col("text")))).alias("folded"))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markdown.markdown_column("html").alias("markdown"))


def html_visible_text_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible letters of every page equal those of its Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", markdown.text_mismatch("html").alias("difference"))


def skill_pass_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a small vocabulary, leftmost-longest, per document."""
    vocabulary = {"apache license": "Apache License", "license": "License", "gnu general public license": "GPL", "all rights reserved": "Rights", "version": "Version"}

    def matches(series: pd.Series) -> pd.Series:
        return series.map(lambda t: [f"{name}:{a}:{b}" for name, a, b in texts.term_matches(t or "", vocabulary)])

    return _docs(spark, sf_dir).select("doc_id", F.explode(F.pandas_udf(matches, "array<string>")("text")).alias("match"))


def quote_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's last twenty characters (all of a shorter one), quoted with marks or typographic signs by turns, bound to the document."""
    d = _docs(spark, sf_dir)
    b = texts.annotate(d).withColumn("n", F.substring("block_id", 2, 6).cast("int")).withColumnRenamed("text", "_b")
    last = F.right("_b", F.lit(20))
    quote = F.when(F.col("n") % 2 == 1, F.concat(F.lit("*"), last, F.lit("*"))).otherwise(last)
    x = b.join(d, "doc_id").select("doc_id", "block_id", F.col("end").alias("_end"), binding.bound(F.col("text"), F.col("start"), F.col("end"), quote).alias("s"))
    return x.select("doc_id", "block_id", (F.col("s.end") == F.col("_end")).alias("at_end"), F.col("s.tier").startswith("block").alias("in_block"))


QUERIES = {f.__name__: f for f in (
    quote_binding, annotate_blocks, block_intervals, find_occurrences, document_slice, offset_line_column, section_heading_fill, coverage_repeated_lines, interval_merge_coverage, jaccard_pairs, typographic_fold,
    html_to_markdown, html_visible_text_equals, skill_pass_matches,
)}

LINES = """WITH sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), ln AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS line FROM sp),
  lo AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM ln),
  bl AS (SELECT doc_id, 'b' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY line))::VARCHAR, 6, '0') AS block_id, text, s AS start, (s + length(text))::INTEGER AS "end", line FROM lo WHERE regexp_matches(text, '[^\\s]'))"""
OCC = "SELECT doc_id, unnest([i - 1 FOR i IN range(1, length(text) + 1) IF text[i:i + 3] = '{0}'])::INTEGER AS start FROM documents WHERE contains(text, '{0}')"
SPANS = f"WITH o AS ({OCC.format('tion')}), sp AS (SELECT doc_id, greatest(start - 20, 0) AS s, start + 4 + start % 30 AS e FROM o)"

ORACLES = {
    "annotate_blocks": LINES + ' SELECT doc_id, block_id, text, start, "end" FROM bl',
    "block_intervals": LINES + ", r AS (SELECT *, sum((NOT regexp_matches(text, '[^\\s]'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM lo) SELECT doc_id, min(s) AS start, max(s + length(text))::INTEGER AS \"end\" FROM r WHERE regexp_matches(text, '[^\\s]') GROUP BY doc_id, run",
    "find_occurrences": OCC.format("thth"),
    "document_slice": "SELECT doc_id, substr(text, 11, 50) AS middle, CASE WHEN length(text) > 25 THEN right(text, 25) ELSE text END AS last, substr(text, 1, greatest(length(text) - 30, 0)) AS front FROM documents",
    "offset_line_column": f"WITH o AS ({OCC.format('thth')}), m AS (SELECT doc_id, max(start) AS start FROM o GROUP BY doc_id) SELECT d.doc_id, start, len(string_split(substr(text, 1, start), chr(10)))::INTEGER AS line, (length(string_split(substr(text, 1, start), chr(10))[-1]) + 1)::INTEGER AS \"column\" FROM documents d JOIN m ON m.doc_id = d.doc_id",
    "section_heading_fill": LINES + ", h AS (SELECT *, substr(block_id, 2)::INTEGER AS n FROM bl), g AS (SELECT *, last_value(CASE WHEN n % 5 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS hn FROM h) SELECT a.doc_id, a.block_id, CASE WHEN a.hn % 15 <> 0 THEN substr(b.text, 1, 12) END AS section_heading FROM g a LEFT JOIN h b ON a.doc_id = b.doc_id AND a.hn = b.n",
    "coverage_repeated_lines": LINES + " SELECT doc_id, text, count(*) AS n, min(block_id) AS first_block, max(block_id) AS last_block FROM bl GROUP BY doc_id, text HAVING count(*) > 1",
    "interval_merge_coverage": SPANS + ", w AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp) SELECT doc_id, sum(greatest(e - greatest(s, coalesce(r, s)), 0))::BIGINT AS covered FROM w GROUP BY doc_id",
    "jaccard_pairs": SPANS + ", w AS (SELECT doc_id, s, e, lead(s) OVER v AS s2, lead(e) OVER v AS e2 FROM sp WINDOW v AS (PARTITION BY doc_id ORDER BY s, e)), j AS (SELECT *, greatest(least(e, e2) - greatest(s, s2), 0) AS b FROM w WHERE s2 IS NOT NULL) SELECT doc_id, s AS start, round(CASE WHEN (e - s) + (e2 - s2) - b > 0 THEN b / ((e - s) + (e2 - s2) - b)::DOUBLE ELSE 0 END, 9) AS jaccard FROM j",
    "typographic_fold": "SELECT doc_id, md5('\"q\" - \'\'x\'\' \'\'a\'\' \"b\" - - - ‐   ' || translate(text, '‘’‚‛“”„‟‒–—−' || chr(160) || chr(8201) || chr(8239), '\'\'\'\'\'\'\'\'\"\"\"\"----   ')) AS folded FROM documents",
    "html_visible_text_equals": "SELECT page_id, NULL::VARCHAR AS difference FROM pages",
}
