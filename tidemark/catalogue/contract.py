"""Record checks, reference resolution and small record functions as registered queries, over records made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resolving, texts
from ..operators import contract
from ..plans.snapshots import table
from .texts import LINES


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth block is a heading, every seventh a line that ends in a colon."""
    b = texts.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("_n", contract.block_number(F.col("block_id")))
    text = F.when(F.col("_n") % 4 == 1, F.concat(F.lit("# "), "text")).when(F.col("_n") % 7 == 3, F.concat("text", F.lit(":"))).otherwise(F.col("text"))
    return b.withColumn("text", text)


def coverage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth block is quoted: which blocks that covers."""
    b = _blocks(spark, sf_dir)
    return contract.covered_blocks(b.drop("_n"), b.where("_n % 5 = 0"))


def block_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks but for every sixth are accounted for: statements (which quote the block two before), exclusions without a reason, or context."""
    b = _blocks(spark, sf_dir)
    disposition = F.element_at(F.array(F.lit("statements"), F.lit("excluded"), F.lit("context")), F.col("_n") % 3 + 1)
    reason = F.when((F.col("_n") % 3 == 1) & (F.col("_n") % 2 == 1), "boilerplate")
    refs = F.when(F.col("_n") % 9 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), F.col("_n").cast("string"))))
    accounting = b.where("_n % 6 <> 0").select("doc_id", "block_id", disposition.alias("disposition"), reason.alias("exclusion_reason"), refs.alias("ref_ids"))
    quoted = b.select("doc_id", F.concat(F.lit("s"), (F.col("_n") + 2).cast("string")).alias("ref_id"), "block_id")
    return contract.accounting_errors(b.drop("_n"), accounting, quoted)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") + F.col("l_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    cites = lambda k: F.when(n % k == 0, F.array(F.lit("b1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("statement_id"), pick("qualification", "responsibility", "benefit").alias("kind"),
        F.when(n % 4 != 0, pick("required", "preferred", "assumed", "ambiguous", "not_required")).alias("importance"), cites(2).alias("importance_evidence"), F.when(n % 5 == 1, "expert").alias("proficiency"), cites(3).alias("proficiency_evidence"),
    )


def statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.statement_errors(_statements(spark, sf_dir))


def connective_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") + F.col("l_orderkey")
    operator = F.element_at(F.array(F.lit("all_of"), F.lit("any_of"), F.lit("unresolved")), (n % 3 + 1).cast("int"))
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("group_id"), operator.alias("operator"), F.when(n % 4 < 2, F.array(F.lit("b1"))).alias("evidence"))
    return contract.connective_errors(groups)


def record_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement and connective checks of every order's record, summed up by record."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return contract.verification([statement_checks(spark, sf_dir), connective_evidence(spark, sf_dir)], records)


def usability_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    usability = F.element_at(F.array(*map(F.lit, ["usable", "partial", "empty", "placeholder", "unsupported"])), (i % 5 + 1).cast("int"))
    n_blocks = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"(?U)\S")))
    codes = contract.usability_codes(usability, i % 2 == 0, n_blocks, (i % 3).cast("int"), F.lit(0))
    return d.select("doc_id", F.array_join(codes, ",").alias("codes"))


def section_heading_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that store their block's heading, but for every eleventh."""
    b = _blocks(spark, sf_dir)
    headed = texts.under_headings(b.drop("_n"), heading=F.col("text").startswith("# "), label=F.substring("text", 3, 20)).select("doc_id", "block_id", "section_heading")
    n = contract.block_number(F.col("block_id"))
    stored = headed.select("doc_id", "block_id", F.col("block_id").alias("statement_id"), F.when(n % 11 == 0, "other").otherwise(F.col("section_heading")).alias("section_heading"))
    return contract.heading_errors(stored, headed)


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block quoted once: as it stands, from the block before, with typographic signs, in capitals, with marks, whole, and with a wrong occurrence."""
    b = texts.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n", contract.block_number(F.col("block_id")))
    own = F.substring("text", 3, 40)
    quote = F.when(F.col("n") % 7 == 2, F.translate(own, "'-", "’–")).when(F.col("n") % 7 == 3, F.upper(own)).when(F.col("n") % 7 == 4, F.concat(F.lit("**"), own, F.lit("**"))).when(F.col("n") % 7 == 5, F.lit(None)).otherwise(own)
    cited = F.when((F.col("n") % 7 == 1) & (F.col("n") > 1), F.format_string("b%06d", F.col("n") - 1)).otherwise(F.col("block_id"))
    occurrence = F.when(F.col("n") % 7 == 6, 5).when(F.col("n") % 7 != 5, 0)
    refs = b.select("doc_id", F.col("block_id").alias("ref_id"), cited.alias("block_id"), quote.alias("quote"), occurrence.alias("occurrence"))
    return resolving.resolved(refs, b.drop("n")).drop("text")


def split_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    a, b = F.col("p_type"), F.split("p_name", " ")[0]
    raw = F.when(n % 6 == 0, F.concat(a, F.lit("/"), b)).when(n % 6 == 1, F.concat(a, F.lit(" and/or "), b, F.lit(" (any)"))).when(n % 6 == 2, F.concat(F.lit(" "), a, F.lit("/2 ."))).when(n % 6 == 3, F.concat(a, F.lit("/"), "p_name")).when(n % 6 == 4, F.lit("CI/CD")).otherwise(F.concat(a, F.lit(", "), b))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(texts.split_mention(raw), "|").alias("mentions"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modal terms, keys and invisible characters of every turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", contract.quotes_modality(t).alias("modal"), F.md5(contract.normalized_key(F.concat(F.lit(" \t"), t, F.lit("\n")))).alias("key"), contract.invisible_count(F.concat(t, F.lit("​\u0007"))).cast("int").alias("n_invisible"))


def authorization_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    word = F.element_at(F.array(*map(F.lit, ["yes", "no", "undeclared", "maybe"])), (n % 4 + 1).cast("int"))
    flag = F.element_at(F.array(*map(F.lit, ["true", "false", '"true"'])), (n % 3 + 1).cast("int"))
    profile = F.when(n % 7 == 0, "{}").when(n % 11 == 0, "not json").otherwise(F.concat(F.lit('{"authorization": {"sponsorship": "'), word, F.lit('", "citizenship_required": '), flag, F.lit("}}")))
    x = table(spark, sf_dir, "orders").select("o_orderkey", contract.authorization_row(profile).alias("r"))
    return x.where("r is not null").select("o_orderkey", "r.sponsorship", "r.citizenship_required")


def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return x.select("o_orderkey", contract.canonical_decimal((cents - cents % F.element_at(F.array(F.lit(1), F.lit(10), F.lit(1000)), (F.col("o_orderkey") % 3 + 1).cast("int"))).cast("decimal(20,0)") / 100).alias("spelling"))


QUERIES = {f.__name__: f for f in (
    coverage_units, block_accounting, statement_checks, connective_evidence, record_verification, usability_conflicts, section_heading_check, reference_resolution, split_mentions, record_texts, authorization_rows, canonical_decimals,
)}

BLOCKS = LINES + r""", b AS (SELECT doc_id, block_id, n, CASE WHEN n % 4 = 1 THEN '# ' || text WHEN n % 7 = 3 THEN text || ':' ELSE text END AS text FROM (SELECT *, substr(block_id, 2)::INTEGER AS n FROM bl)),
  u AS (SELECT *, regexp_matches(text, '^\s*(#{1,6}\s+\S|\*\*[^*].*\*\*\s*$|__[^_].*__\s*$)') AS hd, regexp_replace(text, '[*_`#>\s]+$', '') AS bare, trim(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))) AS copy FROM b),
  v AS (SELECT *, hd OR ends_with(bare, ':') AS li FROM u),
  w AS (SELECT *, NOT coalesce(NOT lag(li) OVER o AND NOT hd AND NOT regexp_matches(lag(bare) OVER o, '[.!?:;]$') AND regexp_matches(text, '^\s*[a-z]'), false) AS parts FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
  x AS (SELECT *, sum(parts::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS chain FROM w),
  y AS (SELECT *, coalesce(min(CASE WHEN hd THEN n END) OVER f, 1000000000) AS next_hd, coalesce(min(CASE WHEN li THEN n END) OVER f, 1000000000) AS next_li FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
_COVERS = "(q.n = p.n OR (p.copy <> '' AND q.copy = p.copy) OR q.chain = p.chain OR (p.hd AND q.n > p.n AND q.n < p.next_hd) OR (p.li AND NOT p.hd AND q.n > p.n AND q.n < p.next_li))"
_ST = """SELECT l_orderkey AS doc_id, 's' || l_linenumber AS sid, l_linenumber + l_orderkey AS n, ['qualification', 'responsibility', 'benefit'][(n % 3 + 1)::INTEGER] AS kind,
  CASE WHEN n % 4 <> 0 THEN ['required', 'preferred', 'assumed', 'ambiguous', 'not_required'][(n % 5 + 1)::INTEGER] END AS imp FROM lineitem"""
STATEMENTS = f"""WITH st AS ({_ST}), statement_checks AS (
  SELECT doc_id, 'statements/' || sid AS path, unnest([c FOR c IN [CASE WHEN kind = 'qualification' AND imp IS NULL THEN 'importance_missing' END, CASE WHEN kind <> 'qualification' AND imp IS NOT NULL THEN 'importance_unexpected' END,
    CASE WHEN n % 5 = 1 AND n % 3 <> 0 THEN 'proficiency_evidence_missing' END, CASE WHEN imp IN ('required', 'preferred', 'not_required', 'ambiguous') AND n % 2 <> 0 THEN 'importance_evidence_missing' END] IF c IS NOT NULL]) AS code FROM st),
  connective_evidence AS (SELECT l_orderkey AS doc_id, 'groups/' || l_linenumber AS path, 'connective_evidence_missing' AS code FROM lineitem WHERE (l_linenumber + l_orderkey) % 3 < 2 AND (l_linenumber + l_orderkey) % 4 >= 2)"""
ORACLES = {
    "coverage_units": BLOCKS + f" SELECT doc_id, block_id, n % 5 = 0 AS is_cited, EXISTS (SELECT 1 FROM y q WHERE q.doc_id = p.doc_id AND q.n % 5 = 0 AND {_COVERS}) AS is_covered FROM y p",
    "block_accounting": BLOCKS + f""", a AS (SELECT *, ['statements', 'excluded', 'context'][n % 3 + 1] AS d, 'block_accounting/' || block_id AS path, regexp_matches(text, '(?i)\\b(must|requir\\w*|minimum|at least|only candidates|need to|proficien\\w*|fluen\\w*)\\b') AS rq FROM y)
      SELECT doc_id, path, 'block_unaccounted' AS code FROM a WHERE n % 6 = 0
      UNION ALL SELECT doc_id, path, 'exclusion_reason_missing' FROM a WHERE n % 6 <> 0 AND d = 'excluded' AND n % 2 = 0
      UNION ALL SELECT doc_id, path, 'exclusion_requirement_language' FROM a WHERE n % 6 <> 0 AND d = 'excluded' AND rq
      UNION ALL SELECT doc_id, path, 'context_requirement_language' FROM a WHERE n % 6 <> 0 AND d = 'context' AND rq
      UNION ALL SELECT doc_id, path, 'refs_missing' FROM a WHERE n % 6 <> 0 AND d = 'statements' AND n % 9 = 3
      UNION ALL SELECT doc_id, path, 'coverage_unevidenced' FROM a p WHERE n % 6 <> 0 AND d = 'statements' AND n % 9 <> 3 AND NOT EXISTS (SELECT 1 FROM y q WHERE q.doc_id = p.doc_id AND q.n = p.n - 2 AND {_COVERS})""",
    "statement_checks": STATEMENTS + " SELECT * FROM statement_checks",
    "connective_evidence": STATEMENTS + " SELECT * FROM connective_evidence",
    "record_verification": STATEMENTS + """, e AS (SELECT * FROM statement_checks UNION ALL SELECT * FROM connective_evidence), g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM e GROUP BY doc_id)
      SELECT o_orderkey AS doc_id, coalesce(n, 0)::BIGINT AS n_errors, coalesce(codes, '') AS codes, CASE WHEN n IS NULL THEN 'pass' ELSE 'fail' END AS status FROM orders LEFT JOIN g ON g.doc_id = o_orderkey""",
    "usability_conflicts": """WITH d AS (SELECT doc_id, ['usable', 'partial', 'empty', 'placeholder', 'unsupported'][(doc_id % 5 + 1)::INTEGER] AS u, len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\s]')]) AS nb FROM documents)
      SELECT doc_id, array_to_string([c FOR c IN [CASE WHEN (u = 'empty') <> (nb = 0) THEN 'usability_conflict' END, CASE WHEN nb > 0 AND u IN ('partial', 'placeholder', 'unsupported') AND doc_id % 2 <> 0 THEN 'evidence_required' END,
        CASE WHEN u IN ('empty', 'placeholder') AND doc_id % 3 > 0 THEN 'empty_with_content' END] IF c IS NOT NULL], ',') AS codes FROM d""",
    "section_heading_check": BLOCKS + ", h AS (SELECT *, max(CASE WHEN n % 4 = 1 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS hn FROM b) SELECT doc_id, 'statements/' || block_id AS path, 'section_heading_mismatch' AS code FROM h WHERE n % 11 = 0",
    "split_mentions": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_type || '|' || split_part(p_name, ' ', 1) WHEN 1 THEN p_type || '|' || split_part(p_name, ' ', 1) WHEN 2 THEN p_type || '/2' WHEN 3 THEN p_type || '/' || p_name WHEN 4 THEN 'CI/CD' ELSE p_type || ', ' || split_part(p_name, ' ', 1) END AS mentions FROM part""",
    "record_texts": """SELECT conv_id, turn, list_bool_or([contains(lower(text), t) FOR t IN ['must', 'required', 'require', 'preferred', 'prefer', 'ideally', 'plus', 'nice to have', 'bonus', 'minimum', 'at least', 'strongly']]) AS modal,
      md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '^\\s+|\\s+$', '', 'g')) AS "key", (3 + length(text) - length(regexp_replace(text, '[\\p{Cc}\\p{Cf}\\p{Co}]', '', 'g')) - (length(text) - length(replace(text, chr(10), ''))) - (length(text) - length(replace(text, chr(9), ''))))::INTEGER AS n_invisible FROM conversations""",
    "authorization_rows": "SELECT o_orderkey, ['yes', 'no', 'undeclared'][(o_orderkey % 4 + 1)::INTEGER] AS sponsorship, o_orderkey % 3 = 0 AS citizenship_required FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 4 < 3 AND o_orderkey % 3 < 2",
    "canonical_decimals": """WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c, [1, 10, 1000][(o_orderkey % 3 + 1)::INTEGER] AS m FROM orders), r AS (SELECT o_orderkey, c - c % m AS c FROM c)
      SELECT o_orderkey, (c // 100)::VARCHAR || CASE WHEN c % 100 = 0 THEN '' WHEN c % 10 = 0 THEN '.' || (c % 100 // 10) ELSE '.' || lpad((c % 100)::VARCHAR, 2, '0') END AS spelling FROM r""",
}
