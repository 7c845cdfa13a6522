"""Grammars over quoted spans, and over spans made from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar
from ..plans.snapshots import table


def quantity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes written as spans of several shapes, with comparisons and cited units by turns."""
    k, n = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    value = (
        F.when(k == 0, F.concat(n, F.lit("+ years"))).when(k == 1, F.concat(n, F.lit(" - "), (F.col("p_size") + 3).cast("string"), F.lit(" months"))).when(k == 2, F.concat(n, F.lit("%")))
        .when(k == 3, F.concat(n, F.lit(" days per year"))).when(k == 4, n).when(k == 5, F.concat(n, F.lit(" gadgets"))).when(k == 6, F.concat(n, F.lit(" times per week"))).otherwise(F.concat(F.lit("9 to "), n, F.lit(" yrs")))
    )
    cited = F.when((k == 4) & (F.col("p_size") % 2 == 0), "at least").when((k == 2) & (F.col("p_size") % 3 == 0), "Up to").when((k == 2) & (F.col("p_size") % 3 == 1), "roughly")
    unit = F.when((k == 4) & (F.col("p_size") % 5 == 0), "(years)")
    q = grammar.quantity(value, cited, unit)
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q")).select("p_partkey", *[F.col(f"q.{c}").alias(c) for c in ("dimension", "comparison", "min_value", "max_value", "unit")])


def money_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as pay spans."""
    k, whole = F.col("o_orderkey") % 5, F.floor("o_totalprice").cast("long")
    value = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(whole, 0))).when(k == 1, F.concat(F.lit("€"), F.floor(whole / 1000).cast("string"), F.lit("k")))
        .when(k == 2, F.concat(F.lit("$"), F.floor(whole / 1000).cast("string"), F.lit(" - $"), F.floor(whole / 1000 + 20).cast("string"), F.lit("K"))).when(k == 3, F.concat(F.lit("£"), whole.cast("string"), F.lit(" to €"), whole.cast("string"))).otherwise(whole.cast("string"))
    )
    m = grammar.money(value, F.when(k == 4, "up to"), F.when(k == 0, "usd"), F.when(k == 4, "paid Monthly").when(k == 0, "per annum"))
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", "m.*")


def date_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written by name and in numbers."""
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("apply by "), F.date_format(d, "MMMM d, yyyy"))).otherwise(F.date_format(d, "M/d/yyyy"))
    got = grammar.date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("g")).select("o_orderkey", F.col("g.date").cast("string").alias("date"), F.size(F.coalesce("g.candidates", F.array().cast("array<date>"))).cast("int").alias("n_candidates"))


def requirement_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ["must have", "nice to have", "Preferred", "required or preferred", "about us", "mandatory", "a plus", ""]))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(words, (F.col("p_partkey") % 8).cast("int")).alias("modal"), F.get(words, (F.col("p_size") % 8).cast("int")).alias("heading"))
    return p.select("p_partkey", grammar.requirement(F.col("modal"), F.col("heading"), F.when(F.col("p_partkey") % 3 == 0, "qualification")).alias("requirement"), grammar.modal_label(F.col("modal")).alias("label"))


def experience_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(n, F.lit("+ years of work"))).when(k == 1, F.concat(F.lit("at least "), n, F.lit(" years"))).when(k == 2, F.concat(n, F.lit("-10 yrs"))).when(k == 3, F.concat(n, F.lit(" years, then 3 years"))).otherwise(F.concat(n, F.lit(" years")))
    return table(spark, sf_dir, "part").select("p_partkey", grammar.experience_months(text).alias("e")).select("p_partkey", "e.*")


QUERIES = {f.__name__: f for f in (quantity_grammar, money_grammar, date_grammar, requirement_lexicon, experience_grammar)}

ORACLES = {
    "quantity_grammar": """WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 8 AS k FROM part)
      SELECT p_partkey,
        CASE k WHEN 0 THEN 'duration' WHEN 1 THEN 'duration' WHEN 2 THEN CASE WHEN n % 3 <> 1 THEN 'percentage' END WHEN 4 THEN CASE WHEN n % 5 = 0 THEN 'duration' ELSE 'count' END WHEN 6 THEN 'frequency' WHEN 7 THEN CASE WHEN n >= 9 THEN 'duration' END END AS dimension,
        CASE k WHEN 0 THEN 'gte' WHEN 1 THEN 'range' WHEN 2 THEN CASE n % 3 WHEN 0 THEN 'lte' WHEN 2 THEN 'unstated' END WHEN 4 THEN CASE WHEN n % 2 = 0 THEN 'gte' ELSE 'unstated' END WHEN 6 THEN 'unstated' WHEN 7 THEN CASE WHEN n >= 9 THEN 'range' END END AS comparison,
        (CASE k WHEN 0 THEN n * 12 WHEN 1 THEN n WHEN 2 THEN CASE WHEN n % 3 = 2 THEN n END WHEN 4 THEN CASE WHEN n % 5 = 0 THEN n * 12 ELSE n END WHEN 6 THEN n WHEN 7 THEN CASE WHEN n >= 9 THEN 108 END END)::DOUBLE AS min_value,
        (CASE k WHEN 1 THEN n + 3 WHEN 2 THEN CASE WHEN n % 3 <> 1 THEN n END WHEN 4 THEN CASE WHEN n % 2 = 1 THEN CASE WHEN n % 5 = 0 THEN n * 12 ELSE n END END WHEN 6 THEN n WHEN 7 THEN CASE WHEN n >= 9 THEN n * 12 END END)::DOUBLE AS max_value,
        CASE k WHEN 0 THEN 'month' WHEN 1 THEN 'month' WHEN 2 THEN CASE WHEN n % 3 <> 1 THEN 'percent' END WHEN 4 THEN CASE WHEN n % 5 = 0 THEN 'month' END WHEN 6 THEN 'per_week' WHEN 7 THEN CASE WHEN n >= 9 THEN 'month' END END AS unit
      FROM p""",
    "money_grammar": """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, floor(o_totalprice)::BIGINT AS w, floor(floor(o_totalprice) / 1000)::BIGINT AS t FROM orders)
      SELECT o_orderkey, CASE k WHEN 0 THEN 'unstated' WHEN 1 THEN 'unstated' WHEN 2 THEN 'range' WHEN 4 THEN 'lte' END AS comparison,
        CASE k WHEN 0 THEN w::VARCHAR WHEN 1 THEN (t * 1000)::VARCHAR WHEN 2 THEN (CASE WHEN t < 1000 THEN t * 1000 ELSE t END)::VARCHAR END AS min_amount,
        CASE k WHEN 0 THEN w::VARCHAR WHEN 1 THEN (t * 1000)::VARCHAR WHEN 2 THEN ((t + 20) * 1000)::VARCHAR WHEN 4 THEN w::VARCHAR END AS max_amount,
        CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency, CASE k WHEN 0 THEN 'year' WHEN 4 THEN 'month' END AS period FROM o""",
    "date_grammar": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
        CASE WHEN o_orderkey % 2 = 0 OR day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN 0 ELSE 2 END::INTEGER AS n_candidates FROM orders""",
    "requirement_lexicon": """WITH w(i, t, r, l) AS (VALUES (0, 'must have', 'required', 'must have'), (1, 'nice to have', 'preferred', 'nice to have'), (2, 'Preferred', 'preferred', 'preferred'), (3, 'required or preferred', NULL, 'required'), (4, 'about us', NULL, 'about us'), (5, 'mandatory', 'required', 'mandatory'), (6, 'a plus', 'preferred', 'plus'), (7, '', NULL, ''))
      SELECT p_partkey, coalesce(a.r, b.r, CASE WHEN p_partkey % 3 = 0 THEN 'preferred' END) AS requirement, a.l AS label FROM part JOIN w a ON a.i = p_partkey % 8 JOIN w b ON b.i = p_size % 8""",
    "experience_grammar": """WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 5 AS k FROM part)
      SELECT p_partkey, CASE k WHEN 0 THEN 'gte' WHEN 1 THEN 'gte' WHEN 2 THEN CASE WHEN n <= 10 THEN 'range' END WHEN 4 THEN 'exact' END AS comparison, (CASE k WHEN 0 THEN n * 12 WHEN 1 THEN n * 12 WHEN 2 THEN CASE WHEN n <= 10 THEN n * 12 END WHEN 4 THEN n * 12 END)::INTEGER AS min_months,
        (CASE k WHEN 2 THEN CASE WHEN n <= 10 THEN 120 END WHEN 4 THEN n * 12 END)::INTEGER AS max_months FROM p""",
}
