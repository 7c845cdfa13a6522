"""Sources, the record contract, event folds and agreement over data made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import agreement, fold, records
from ..plans.snapshots import table
from ..sources import adapters


def _payloads(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Documents as payload bodies, at most a hundred to a body; every eleventh has no title."""
    d = table(spark, sf_dir, "documents").withColumn("batch", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")))
    title = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit(" "), F.substring("text", 1, 20), F.lit(" ")))
    seconds = F.col("doc_id") * 1000 + 1700000000
    if source == "greenhouse":
        item = F.struct(F.col("doc_id").alias("id"), title.alias("title"), F.regexp_replace("text", "<", "&lt;").alias("content"), F.struct(F.col("lang").alias("name")).alias("location"), F.array(F.struct(F.lit("Remote").alias("location"))).alias("offices"), F.array(F.struct(F.col("source").alias("name"))).alias("departments"))
        return d.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(item).alias("jobs"))).alias("body")).withColumnRenamed("batch", "attempt_id")
    item = F.struct(F.col("doc_id").cast("string").alias("id"), title.alias("text"), F.col("text").alias("descriptionBody"), F.struct(F.lit("Full-time").alias("commitment"), F.col("lang").alias("location")).alias("categories"), F.lit("Remote").alias("workplaceType"), (seconds * 1000).alias("createdAt"), F.struct(F.col("n_chars").alias("min"), F.lit("EUR").alias("currency")).alias("salaryRange"))
    return d.groupBy("batch").agg(F.to_json(F.collect_list(item)).alias("body")).withColumnRenamed("batch", "attempt_id")


def source_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.records("greenhouse", _payloads(spark, sf_dir, "greenhouse")).select("source_id", "status", "title", F.md5("description_html").alias("content"), "locations", "department")


def source_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.records("lever", _payloads(spark, sf_dir, "lever"))
    return r.select("source_id", "status", "title", "employment_type", "workplace_type", "is_remote", F.col("compensation.min").alias("pay_min"), F.col("compensation.currency").alias("currency"), "source_created_at")


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as attempts and reviews of their user's document."""
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    n = F.col("event_id")
    outcome = F.when(F.col("event_type") == "purchase", F.when(n % 4 == 0, "over_budget").otherwise("attribution_failed")).when(n % 3 == 0, "schema_invalid").otherwise("ok")
    attempts = e.where("event_type in ('view', 'click', 'purchase')").select("user_id", "at", (n % 4 + 1).cast("int").alias("attempt_no"), F.format_string("a%08d", n).alias("attempt_key"), (n % 3).cast("int").alias("slot"), F.concat(F.lit("m-"), (n % 5).cast("string")).alias("model"), outcome.alias("outcome"), (n % 2 == 0).alias("exhausted"))
    verb = F.when(n % 5 == 0, "retry").when(n % 35 == 1, "reject").when(n % 5 == 2, "flag").when(n % 5 == 3, "refute").otherwise("accept")
    return attempts, e.where("event_type in ('error', 'signup')").select("user_id", "at", F.format_string("r%08d", n).alias("review_key"), verb.alias("verb"))


def event_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts, reviews = _streams(spark, sf_dir)
    # within an hour attempts go by their number, so numbers that tie go by key
    attempts = attempts.groupBy("user_id", "at", "attempt_no").agg(F.min_by(F.struct("attempt_key", "slot", "model", "outcome", "exhausted"), "attempt_key").alias("r")).select("user_id", "at", "attempt_no", "r.*")
    return fold.fold_states(attempts, reviews, ["user_id"], accepted="m-0,m-1,m-2,m-3").select("user_id", "status", "chosen", "k", "human_review")


def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples of each document's blocks: one shifted, one without some blocks, with numbers from the offsets."""
    b = texts.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n", F.substring("block_id", 2, 6).cast("int"))
    sample = F.explode(F.sequence(F.lit(0), F.lit(2)))
    s = b.select("doc_id", "n", "start", "end", sample.alias("slot")).where((F.col("slot") != 1) | (F.col("n") % 4 != 0)).withColumn("start", F.when(F.col("slot") == 2, F.col("start") + F.floor((F.col("end") - F.col("start")) / 4)).otherwise(F.col("start")).cast("int"))
    c = s.select("doc_id", "slot", "start", "end", F.lit("qualification").alias("kind"), F.when((F.col("doc_id") % 9 == 0) & (F.col("slot") == 2), "negative").otherwise("positive").alias("polarity"), F.array((F.col("n") + F.when((F.col("doc_id") % 7 == 0) & (F.col("slot") == 0), 1).otherwise(0)).cast("double")).alias("numbers"))
    return agreement.agree(c).select("doc_id", "passed", "medoid_slot", F.round("mean_f1", 9).alias("mean_f1"), "negation", "numeric_conflict", "n_samples")


def _record(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, statements (three of four blocks) and mentions (long words, linked to all blocks that hold them)."""
    b = texts.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n", F.substring("block_id", 2, 6).cast("int"))
    kinds = F.element_at(F.array(F.lit("qualification"), F.lit("responsibility"), F.lit("benefit")), (F.col("n") % 3 + 1).cast("int"))
    statements = b.where("n % 4 <> 0").select("doc_id", F.col("block_id").alias("statement_id"), kinds.alias("kind"))
    words = b.select("doc_id", "block_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)))).alias("surface"))
    mentions = words.groupBy("doc_id", "surface").agg(F.array_sort(F.collect_list("block_id")).alias("statement_ids")).select("doc_id", F.md5("surface").alias("mention_id"), "surface", F.lit("skill").alias("kind"), "statement_ids")
    return b, statements, mentions


def mention_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, statements, mentions = _record(spark, sf_dir)
    return records.claims(mentions, statements).select("doc_id", "surface", "statement_id", "kind")


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, statements, mentions = _record(spark, sf_dir)
    return records.dangling_links(mentions, statements).select("doc_id", "mention_id", F.array_join("live", ",").alias("live"), F.array_join("dropped", ",").alias("dropped"), "unknown_reference")


def profile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, statements, mentions = _record(spark, sf_dir)
    return records.digest(records.claims(mentions, statements)).select("doc_id", "kind", F.array_join("mentions", ",").alias("mentions"), F.col("n_omitted").cast("int").alias("n_omitted"))


def unaccounted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, statements, _ = _record(spark, sf_dir)
    return records.unaccounted_blocks(blocks, statements.withColumnRenamed("statement_id", "block_id"))


def attribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's first ten letters as a reference; some are shifted, some reach past the block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = texts.annotate(docs).withColumn("n", F.substring("block_id", 2, 6).cast("int"))
    shift, size = F.when(F.col("n") % 7 == 0, 1).otherwise(0), F.when(F.col("n") % 5 == 0, F.col("end") - F.col("start") + 1).otherwise(F.least(F.lit(10), F.col("end") - F.col("start")))
    refs = b.join(docs.withColumnRenamed("text", "_t"), "doc_id").select("doc_id", F.concat(F.lit("s/"), "block_id").alias("path"), "block_id", F.substring("_t", F.col("start") + shift + 1, size).alias("text"), "start", (F.col("start") + size).cast("int").alias("end"))
    return records.attribution_errors(refs, docs, b)


def group_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested groups: a part's parent is its number halved; some parents form a cycle."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select((k * 0).cast("int").alias("doc_id"), k.alias("group_id"), F.when(k == 0, None).when(k == 5, 11).when(k == 1, 0).otherwise(F.floor(k / 2)).cast("long").alias("parent_id"))
    return records.group_depth(g, 6).select("group_id", "depth")


QUERIES = {f.__name__: f for f in (source_greenhouse, source_lever, event_fold_state, agreement_report, mention_claims, dangling_links, profile_digest, unaccounted_blocks, attribution_check, group_nesting)}

BLOCKS = """WITH RECURSIVE sp AS (SELECT doc_id, text AS doc, string_split(text, chr(10)) AS ls FROM documents), ln AS (SELECT doc_id, doc, unnest(ls) AS text, unnest(range(len(ls))) AS line FROM sp),
  lo AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM ln),
  b AS (SELECT doc_id, doc, text, s, (s + length(text))::INTEGER AS e, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM lo WHERE regexp_matches(text, '[^\\s]')),
  bl AS (SELECT *, 'b' || lpad(n::VARCHAR, 6, '0') AS block_id FROM b),
  st AS (SELECT doc_id, block_id, ['qualification', 'responsibility', 'benefit'][n % 3 + 1] AS kind FROM bl WHERE n % 4 <> 0),
  m AS (SELECT doc_id, block_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{9,}'))) AS surface FROM bl)"""
DOCS = "WITH d AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN nullif(trim(substr(text, 1, 20), ' ' || chr(10)), '') END AS title FROM documents)"

ORACLES = {
    "source_greenhouse": DOCS + " SELECT doc_id::VARCHAR AS source_id, CASE WHEN title IS NULL THEN 'failed' ELSE 'ok' END AS status, title, md5(text) AS content, list_sort([lang, 'Remote']) AS locations, source AS department FROM d",
    "source_lever": DOCS + " SELECT doc_id::VARCHAR AS source_id, CASE WHEN title IS NULL THEN 'failed' ELSE 'ok' END AS status, title, 'full_time' AS employment_type, 'remote' AS workplace_type, true AS is_remote, n_chars::DOUBLE AS pay_min, 'EUR' AS currency, make_timestamp((doc_id * 1000 + 1700000000) * 1000000) AS source_created_at FROM d",
    "event_fold_state": """WITH RECURSIVE x AS (SELECT event_id AS n, user_id, event_type AS t, date_trunc('hour', ts)::TIMESTAMP AS h FROM events),
      a0 AS (SELECT user_id, h, n, n % 4 + 1 AS no, n % 3 AS slot, n % 5 AS model, CASE WHEN t = 'purchase' THEN CASE WHEN n % 4 = 0 THEN 'over_budget' ELSE 'attribution_failed' END WHEN n % 3 = 0 THEN 'schema_invalid' ELSE 'ok' END AS o FROM x WHERE t IN ('view', 'click', 'purchase')),
      a AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY user_id, h, no ORDER BY n) = 1),
      ev AS (SELECT user_id, h, 0 AS stream, printf('%08d', no) AS k, n, slot, o = 'ok' AND model <= 3 AS good, o = 'over_budget' OR (o IN ('schema_invalid', 'attribution_failed') AND no >= 3 AND n % 2 = 0) AS bad, NULL::VARCHAR AS verb FROM a
        UNION ALL SELECT user_id, h, 1, printf('r%08d', n), n, NULL, false, false, CASE WHEN n % 5 = 0 THEN 'retry' WHEN n % 35 = 1 THEN 'reject' WHEN n % 5 = 2 THEN 'flag' WHEN n % 5 = 3 THEN 'refute' ELSE 'accept' END FROM x WHERE t IN ('error', 'signup')),
      e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, stream, k) AS i FROM ev),
      s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS st, NULL::VARCHAR AS chosen, 'none' AS hr, []::BIGINT[] AS slots FROM e UNION ALL
        SELECT e.user_id, e.i, CASE WHEN verb = 'retry' THEN NULL WHEN st IS NULL AND good THEN 'validated' WHEN st IS NULL AND bad THEN 'quarantined' WHEN verb = 'reject' AND st IS NOT NULL THEN 'rejected' WHEN verb IN ('flag', 'refute') AND st = 'validated' THEN 'needs_review' WHEN verb = 'accept' AND st = 'needs_review' THEN 'validated' ELSE st END,
          CASE WHEN verb = 'retry' THEN NULL WHEN st IS NULL AND good THEN printf('a%08d', n) ELSE chosen END, CASE WHEN verb = 'retry' THEN 'none' WHEN verb = 'reject' AND st IS NOT NULL THEN 'rejected' WHEN verb = 'accept' AND st = 'needs_review' THEN 'accepted' ELSE hr END,
          CASE WHEN verb = 'retry' THEN [] WHEN slot IS NOT NULL THEN list_append(slots, slot) ELSE slots END
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
      SELECT user_id, st AS status, chosen, greatest(len(list_distinct(slots)), 1)::INTEGER AS k, hr AS human_review FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "mention_claims": BLOCKS + " SELECT m.doc_id, surface, m.block_id AS statement_id, kind FROM m JOIN st ON st.doc_id = m.doc_id AND st.block_id = m.block_id",
    "dangling_links": BLOCKS + " SELECT m.doc_id, md5(surface) AS mention_id, coalesce(string_agg(m.block_id, ',' ORDER BY m.block_id) FILTER (kind IS NOT NULL), '') AS live, coalesce(string_agg(m.block_id, ',' ORDER BY m.block_id) FILTER (kind IS NULL), '') AS dropped, count(kind) = 0 AS unknown_reference FROM m LEFT JOIN st ON st.doc_id = m.doc_id AND st.block_id = m.block_id GROUP BY m.doc_id, surface",
    "profile_digest": BLOCKS + ", g AS (SELECT m.doc_id, kind, list_sort(list_distinct(list(surface))) AS l FROM m JOIN st ON st.doc_id = m.doc_id AND st.block_id = m.block_id GROUP BY ALL) SELECT doc_id, kind, array_to_string(l[1:8], ',') AS mentions, greatest(len(l) - 8, 0)::INTEGER AS n_omitted FROM g",
    "unaccounted_blocks": BLOCKS + " SELECT doc_id, block_id FROM bl WHERE n % 4 = 0",
    "attribution_check": BLOCKS + """, r AS (SELECT doc_id, block_id, doc, s, e, s + (CASE WHEN n % 5 = 0 THEN e - s + 1 ELSE least(10, e - s) END) AS e2, substr(doc, s + 1 + (CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END), (CASE WHEN n % 5 = 0 THEN e - s + 1 ELSE least(10, e - s) END)) AS t FROM bl)
      SELECT doc_id, 's/' || block_id AS path, block_id, code FROM (SELECT *, CASE WHEN t <> substr(doc, s + 1, e2 - s) THEN 'text_mismatch' WHEN e2 > e THEN 'outside_block' END AS code FROM r) WHERE code IS NOT NULL""",
    "group_nesting": """WITH RECURSIVE g AS (SELECT p_partkey AS k, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey = 5 THEN 11 WHEN p_partkey = 1 THEN 0 ELSE p_partkey // 2 END AS p FROM part),
      r AS (SELECT k, 1 AS depth FROM g WHERE p IS NULL UNION ALL SELECT g.k, depth + 1 FROM g JOIN r ON g.p = r.k WHERE depth < 6) SELECT g.k AS group_id, coalesce(depth, -1)::INTEGER AS depth FROM g LEFT JOIN r ON g.k = r.k""",
}
