"""What records leave out: all documents, with a line of company history before their text and a line behind it that may state a fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar
from ..operators import omissions
from ..plans.snapshots import table

HISTORY = "  Founded over 10 years ago with $5 million  "
LINES = ["Pay: $120,000 - $150,000 per year", "Apply by March 3, 2027", "5+ years of work", "Applications close 12/01/2026, or 12/13/2026", "£100,000 - €120,000", "3 years or 5 years"]


def possible_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is boilerplate in every second document; some records state their pay or their experience."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.lit(HISTORY), "text", F.element_at(F.array(*map(F.lit, LINES)), (d % len(LINES) + 1).cast("int"))).alias("text"))
    stated = docs.select("doc_id", F.explode(F.array_compact(F.array(F.when(d % 5 == 0, "compensation"), F.when(d % 7 == 0, "experience_months")))).alias("fact"))
    boilerplate = docs.where(d % 2 == 0).select("doc_id", F.lit(-3).alias("start"), F.lit(9).alias("end"))
    return omissions.possible_omissions(docs, stated, boilerplate)


def pay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay from amounts of orders, in the shapes that postings use."""
    k, low = F.col("o_orderkey") % 8, F.floor("o_totalprice").cast("long") % 90000 + 1000
    high = low + F.col("o_orderkey") % 500 - 20
    grouped, s = lambda n: F.format_number(n, 0), lambda n: n.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), grouped(low), F.lit(".00 - $"), grouped(high), F.lit(" per year"))).when(k == 1, F.concat(s(low), F.lit(" - "), s(high), F.lit(" SEK annually")))
        .when(k == 2, F.concat(F.lit("EUR "), F.translate(grouped(low), ",", "."), F.lit(" to eur "), F.translate(grouped(high), ",", "."))).when(k == 3, F.concat(F.lit("Up to £"), grouped(high)))
        .when(k == 4, F.concat(F.lit("From kr "), F.translate(grouped(low), ",", " "), F.lit(" NOK or less"))).when(k == 5, F.concat(grouped(low), F.lit("−"), grouped(high), F.lit(" OTE, annual")))
        .when(k == 6, F.concat(F.lit("€"), s(low), F.lit(" - £"), s(high))).otherwise(F.concat(F.lit("$"), s(high), F.lit("/hr, not $"), s(low)))
    )
    pay = grammar.compensation(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", pay.alias("pay")).select("o_orderkey", F.col("pay.min").cast("long").alias("min_amount"), F.col("pay.max").cast("long").alias("max_amount"), "pay.currency", "pay.period")


QUERIES = {f.__name__: f for f in (possible_omissions, pay_lines)}

_TOKEN = r"""(?:(?:^|[^A-Za-z])(?:CA\$|NZ\$|HK\$|A\$|S\$|R\$|zł|Kč|RM|kr)|[$£€¥])\s*\d|\d(?:[.,]\d{1,2})?\s*k?\s*(?:USD|CAD|AUD|NZD|SGD|HKD|EUR|GBP|JPY|CNY|CHF|SEK|INR|TWD|KRW|DKK|NOK|PLN|CZK|MYR|BRL|MXN|ILS)\b|(?:USD|CAD|AUD|NZD|SGD|HKD|EUR|GBP|JPY|CNY|CHF|SEK|INR|TWD|KRW|DKK|NOK|PLN|CZK|MYR|BRL|MXN|ILS)\s*\d"""
#: Of the documents' own lines, those with one amount are pay; none is a range, a date or a number of years.
_OMISSIONS = f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, string_split(concat_ws(chr(10), '{HISTORY}', text, [{", ".join(f"'{x}'" for x in LINES)}][(doc_id % 6 + 1)::INTEGER]), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
  l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM d),
  h AS (SELECT *, unnest([CASE WHEN t = '{LINES[0]}' OR len(regexp_extract_all(t, '(?i){_TOKEN}')) = 1 THEN 'compensation' END, CASE WHEN t = '{LINES[1]}' THEN 'deadline' END,
    CASE WHEN t IN ('{HISTORY}', '{LINES[2]}') THEN 'experience_months' END]) AS fact FROM l)
SELECT doc_id, fact, min(line)::INTEGER AS line, arg_min(left(trim(t), 80), line) AS excerpt FROM h
WHERE fact IS NOT NULL AND NOT (line = 0 AND doc_id % 2 = 0) AND NOT (fact = 'compensation' AND doc_id % 5 = 0) AND NOT (fact = 'experience_months' AND doc_id % 7 = 0) GROUP BY doc_id, fact"""
_PAY = """WITH t AS (SELECT o_orderkey, o_orderkey % 8 AS k, floor(o_totalprice)::BIGINT % 90000 + 1000 AS lo, floor(o_totalprice)::BIGINT % 90000 + 980 + o_orderkey % 500 AS hi FROM orders),
  r AS (SELECT *, k NOT IN (4, 6, 7) AND (k = 3 OR lo <= hi) OR k = 4 AS ok FROM t)
SELECT o_orderkey, CASE WHEN ok AND k <> 3 THEN lo END AS min_amount, CASE WHEN ok AND k <> 4 THEN hi END AS max_amount, CASE WHEN ok THEN CASE k WHEN 1 THEN 'SEK' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'NOK' END END AS currency,
  CASE WHEN ok AND k IN (0, 1, 5) THEN 'year' END AS period FROM r"""
ORACLES = {"possible_omissions": _OMISSIONS, "pay_lines": _PAY}
