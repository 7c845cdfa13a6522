"""Pages, filters, joins, aggregates and evaluation measures over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import hash_slot, norm_list, norm_token
from ..operators import evaluation, pages, reads
from ..plans.snapshots import table


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, term: ASCII words of four letters and more, in lower case."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("term"))


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as settled extractions: status, model, cost and update times by fixed rules."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return x.select(
        "doc_id", F.sha2("text", 256).alias("document_hash"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "validated").when(F.col("quality") == 1, "needs_review").otherwise("quarantined").alias("status"),
        F.concat(F.lit("model-"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("prompt_version"), (F.col("doc_id") % 50).alias("cost_cents"),
        ((F.col("doc_id") * 7 % 101) / 100).alias("f1"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1000 % 2592000).alias("updated_at"),
        F.when(F.col("quality") == 0, F.array(F.lit("low_quality"), F.concat(F.lit("from_"), "source"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def events_after_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return pages.after_watermark(e, "at", "event_id", dt.datetime(2024, 1, 29), list(range(9300, 9700, 3)))


def events_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return pages.page(e, [("user_id", False), ("event_id", True)], after={"user_id": 3, "event_id": 500}, limit=100).rows


def postings_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first, filtered, behind a (date, key) cursor."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    return pages.page(o, [("o_orderdate", True), ("o_orderkey", True)], after={"o_orderdate": dt.date(1997, 1, 1), "o_orderkey": 5000}, limit=120).rows


def search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(pages.contains_ci(["p_name", "p_type"], "R_d")).select("p_partkey", "p_name", "p_type")


def model_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_brand").rlike(pages.glob_pattern("Brand#1?,Brand#2*"))).select("p_partkey", "p_brand")


def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their dearest line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", (-F.col("l_extendedprice")).alias("_down"))
    return reads.top_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["_down", "l_linenumber", "l_partkey"]).drop("_down")


def unsatisfied_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.unsatisfied(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def superseded_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.flag_exists(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "superseded")


def extraction_status_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.status_block(_extractions(spark, sf_dir), F.lit("2024-01-20 12:00:00").cast("timestamp"))


def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.consolidation(_extractions(spark, sf_dir))


def migration_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.reasons_top(_extractions(spark, sf_dir), "reasons", 10)


def next_attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.next_number(table(spark, sf_dir, "conversations").where("role = 'user'"), "turn")


def claims_by_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (term, source, status) with the documents that hold them, for terms of a vocabulary."""
    terms = _tokens(spark, sf_dir).where(F.col("term").isin("that", "tion", "with", "license", "worthless"))
    return terms.join(_extractions(spark, sf_dir).where("status in ('validated', 'needs_review')").select("doc_id", "status"), "doc_id").groupBy("term", "source", "status").agg(F.count_distinct("doc_id").alias("n_documents"))


def mention_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.document_frequency(_tokens(spark, sf_dir), least=20)


def skill_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that validated documents hold, against all documents that hold them."""
    t = _tokens(spark, sf_dir)
    emitted = t.join(_extractions(spark, sf_dir).where("status = 'validated'").select("doc_id"), "doc_id", "left_semi")
    return reads.vocabulary(emitted, t, ["that", "with"], share=0.3)


def content_dedup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed documents: one row for each hash, with its first id and how many share it."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("document_hash")).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_versions"))


def document_hash_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("document_hash")).agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n")).where("n > 1")


def hash_mod_sample_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(hash_slot(F.sha2("text", 256), 20) == 0).select("doc_id")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 6, "seed1")


def pairwise_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    return reads.set_jaccard(c, "conv_id", "turn", "words").groupBy("conv_id").agg(F.round(F.avg("jaccard"), 9).alias("mean_jaccard"), F.count("*").alias("n_pairs"))


def eval_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").withColumn("split", F.when(F.col("doc_id") % 3 == 2, "test").otherwise("train"))
    long = x.select("split", F.inline(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("toxic").alias("metric"), F.when(F.col("doc_id") % 5 != 0, F.col("toxic").cast("double")).alias("value")))))
    return reads.score_table(long).select("metric", "split", F.round("mean", 9).alias("mean"), "n")


def list_coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages of a listing whose first page tells a total."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("uid"), F.col("l_linenumber").alias("page"), F.lit(560).alias("total"))
    return reads.coverage_verdict(lines, ["l_suppkey"])


def detail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("uid"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    listed = e.where("ts >= '2024-01-29'").groupBy("board", "uid").agg(F.min("event_id").alias("pos"))
    history = e.where("ts < '2024-01-25'").groupBy("board", "uid").agg(F.max(F.date_trunc("day", "ts")).alias("last_at"))
    return reads.detail_budget(listed, history, F.lit("2024-01-29").cast("timestamp"), 7, 40).select("board", "uid", "rank")


def norm_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, distinct, sorted lists and snake-case tokens of user names."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit("  ")).alias("x"))
    return c.groupBy("c_nationkey").agg(F.collect_list("x").alias("_l"), F.min("x").alias("_m")).select("c_nationkey", norm_list("_l").alias("locations"), norm_token("_m").alias("token"))


def distinct_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("pos", "name"))
    return reads.distinct_by_first(words, ["doc_id"], "name", "pos")


def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _extractions(spark, sf_dir).withColumn("document_hash", F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string")))
    return evaluation.profile_choice(x, "p1").select("document_hash", "doc_id", "status", "prompt_version", "historical")


def extraction_fold_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extractions(spark, sf_dir).groupBy("model", "prompt_version", "status").agg(F.max("updated_at").alias("folded_at"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    profile_choice, extraction_fold_recency, events_after_watermark, events_keyset_page, postings_keyset_page, search_ilike, model_glob_filter, lateral_top1, unsatisfied_anti_join, superseded_exists, extraction_status_block, consolidation_report,
    migration_reasons, next_attempt_number, claims_by_mention, mention_document_frequency, skill_vocabulary, content_dedup_versions, document_hash_shared, hash_mod_sample_slot, stratified_sample,
    pairwise_set_jaccard, eval_score_table, list_coverage_verdict, detail_budget, norm_locations, distinct_spellings,
)}

EX = """WITH ex AS (
  SELECT l.doc_id, sha256(text) AS document_hash, source, CASE WHEN quality = 1 AND toxic = 0 THEN 'validated' WHEN quality = 1 THEN 'needs_review' ELSE 'quarantined' END AS status,
    'model-' || (l.doc_id % 3)::VARCHAR AS model, 'p' || (l.doc_id % 2)::VARCHAR AS prompt_version, l.doc_id % 50 AS cost_cents, (l.doc_id * 7 % 101) / 100.0::DOUBLE AS f1, quality,
    TIMESTAMP '2024-01-01' + to_seconds(l.doc_id * 1000 % 2592000) AS updated_at
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
TOK = "tok AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents)"

ORACLES = {
    "profile_choice": EX + " SELECT 'd' || (doc_id % 97)::VARCHAR AS document_hash, doc_id, status, prompt_version, prompt_version <> 'p1' AS historical FROM ex QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY prompt_version = 'p1' DESC, status = 'validated' DESC, updated_at DESC, model DESC) = 1",
    "extraction_fold_recency": EX + " SELECT model, prompt_version, status, max(updated_at) AS folded_at, count(*) AS n FROM ex GROUP BY ALL",
    "events_after_watermark": "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS at, event_type FROM events WHERE date_trunc('day', ts) > TIMESTAMP '2024-01-29' OR (date_trunc('day', ts) = TIMESTAMP '2024-01-29' AND NOT (event_id % 3 = 0 AND event_id BETWEEN 9300 AND 9699))",
    "events_keyset_page": "SELECT event_id, event_type, user_id, value FROM events WHERE user_id > 3 OR (user_id = 3 AND event_id < 500) ORDER BY user_id, event_id DESC LIMIT 100",
    "postings_keyset_page": "SELECT o_orderdate::DATE AS o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate::DATE, o_orderkey) < (DATE '1997-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 120",
    "search_ilike": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%R_d%' OR p_type ILIKE '%R_d%'",
    "model_glob_filter": "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^(?:Brand#1.|Brand#2.*)$')",
    "lateral_top1": "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1) ON l_orderkey = o_orderkey",
    "unsatisfied_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "superseded_exists": "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS superseded FROM documents d",
    "extraction_status_block": EX + """ SELECT count(*) FILTER (status = 'validated') AS n_validated, count(*) FILTER (status = 'needs_review') AS n_review, count(*) FILTER (status = 'quarantined') AS n_quarantined, count(DISTINCT document_hash) AS n_documents,
      count(DISTINCT model) FILTER (updated_at > TIMESTAMP '2024-01-13 12:00:00') AS n_recent_models, coalesce(sum(cost_cents) FILTER (updated_at::DATE = DATE '2024-01-20'), 0)::BIGINT AS spend_today,
      sum(cost_cents) FILTER (date_trunc('month', updated_at) = DATE '2024-01-01')::BIGINT AS spend_month, min(updated_at) AS oldest_update FROM ex""",
    "consolidation_report": EX + " SELECT model, prompt_version, count(*) AS n, count(*) FILTER (status = 'needs_review') AS n_review, avg(f1) AS mean_f1, count(*) FILTER (f1 < 0.8) AS n_poor, max(updated_at) AS folded_at FROM ex GROUP BY ALL",
    "migration_reasons": EX + " SELECT reason, count(*) AS n FROM (SELECT unnest(['low_quality', 'from_' || source]) AS reason FROM ex WHERE quality = 0) GROUP BY reason ORDER BY n DESC, reason LIMIT 10",
    "next_attempt_number": "SELECT coalesce(max(turn), 0) + 1 AS next_turn FROM conversations WHERE role = 'user'",
    "claims_by_mention": EX + ", " + TOK + " SELECT term, tok.source, status, count(DISTINCT tok.doc_id) AS n_documents FROM tok JOIN ex USING (doc_id) WHERE status IN ('validated', 'needs_review') AND term IN ('that', 'tion', 'with', 'license', 'worthless') GROUP BY ALL",
    "mention_document_frequency": "WITH " + TOK + " SELECT term, count(DISTINCT doc_id) AS n_documents FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 20",
    "skill_vocabulary": EX + ", " + TOK + ", e AS (SELECT term, count(DISTINCT doc_id) AS n_emitted FROM tok WHERE doc_id IN (SELECT doc_id FROM ex WHERE status = 'validated') GROUP BY term), s AS (SELECT term, count(DISTINCT doc_id) AS n_seen FROM tok GROUP BY term) SELECT term, n_emitted, n_seen FROM e JOIN s USING (term) WHERE term NOT IN ('that', 'with') AND n_emitted >= 20 AND n_seen >= 30 AND n_emitted >= 0.3 * n_seen",
    "content_dedup_versions": "SELECT sha256(text) AS document_hash, min(doc_id) AS first_doc_id, count(*) AS n_versions FROM documents GROUP BY 1",
    "document_hash_shared": "SELECT sha256(text) AS document_hash, count(DISTINCT source) AS n_sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "hash_mod_sample_slot": "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(text), 1, 8))::BIGINT % 20 = 0",
    "stratified_sample": "SELECT doc_id, source, rank::INTEGER AS rank, CASE WHEN (rank - 1) % 3 = 2 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('seed1:' || doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 6",
    "pairwise_set_jaccard": """WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
      p AS (SELECT a.conv_id, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn)
      SELECT conv_id, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE n / u::DOUBLE END), 9) AS mean_jaccard, count(*) AS n_pairs FROM p GROUP BY conv_id""",
    "eval_score_table": """WITH l AS (SELECT CASE WHEN doc_id % 3 = 2 THEN 'test' ELSE 'train' END AS split, 'quality' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT CASE WHEN doc_id % 3 = 2 THEN 'test' ELSE 'train' END, 'toxic', CASE WHEN doc_id % 5 <> 0 THEN toxic::DOUBLE END FROM labels)
      SELECT metric, split, round(avg(value), 9) AS mean, count(value) AS n FROM l GROUP BY ALL UNION ALL SELECT metric, 'all', round(avg(value), 9), count(value) FROM l GROUP BY metric""",
    "list_coverage_verdict": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_listed, 560::INTEGER AS total, count(DISTINCT l_partkey) >= 0.95 * 560 AS complete FROM lineitem GROUP BY l_suppkey",
    "detail_budget": """WITH l AS (SELECT event_type AS board, user_id AS uid, min(event_id) AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY ALL), h AS (SELECT event_type AS board, user_id AS uid, max(date_trunc('day', ts)) AS last_at FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL)
      SELECT board, uid, rank::INTEGER AS rank FROM (SELECT l.board, l.uid, row_number() OVER (PARTITION BY l.board ORDER BY last_at IS NOT NULL, last_at NULLS FIRST, pos, l.uid) AS rank FROM l LEFT JOIN h ON l.board = h.board AND l.uid = h.uid WHERE last_at IS NULL OR last_at < TIMESTAMP '2024-01-22') WHERE rank <= 40""",
    "norm_locations": "SELECT c_nationkey, list_sort(list_distinct(list(upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))))) AS locations, lower(min(c_mktsegment)) AS token FROM customer GROUP BY c_nationkey",
    "distinct_spellings": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS name, unnest(range(len(regexp_extract_all(text, '[A-Za-z]{7,}')))) AS pos FROM documents) SELECT doc_id, lower(name) AS folded, arg_min(name, pos) AS name FROM w GROUP BY doc_id, lower(name)",
}
