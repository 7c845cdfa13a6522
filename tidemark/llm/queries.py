"""The corpus operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, dart_minhash, decontaminate, importance, line_spread, packing, quality, suffix_dedup, token_count, token_file, toxicity, url_rules, whitening
from .common import table, written
from .default_rules import HOST_RULES, PATTERN_RULES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES).drop("n_candidates")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_lines")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_spread.dedup_lines(docs).select("doc_id", F.col(line_spread.LINES).alias("n_lines"), F.col(line_spread.REMOVED).alias("n_removed"), "text")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_file.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_file.read_ids(blocks)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, components=4)
    return whitening.by_component(whitening.whiten(rows, model), model)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the served policy and of the one before rejects, from one stored ledger."""
    kept = written(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return quality.ablations(kept, 3).unionByName(quality.ablations(kept, 2))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_suffix_dedup, op4_harmonic_packing, op5_token_counts, op6_quality_ledger, op7_dart_minhash, op8_toxicity, op9_line_spread, op10_token_file, op11_embedding_whitening, op12_best_fit_packing, op13_importance_resampling, quality_ablations)}

#: Host and path as the contract cuts them; each pattern rule tried on every URL.
OP2_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON starts_with(path, substr(rule, instr(rule, '/')))
    AND (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule,
  coalesce(f.verdict, CASE WHEN (
      regexp_matches(lower(url), '(^|[^a-z0-9])(casino|porn|xxx)($|[^a-z0-9])') OR regexp_matches(lower(url), '/wp-login\.php($|[^a-z0-9])')
      OR contains(lower(url), '/cgi-bin/') OR regexp_matches(lower(url), '[?&]sessionid='))
    AND NOT regexp_matches(lower(url), '/help/([^?#]*/)?casino($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits f USING (page_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
gram AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g, lead(i, 4) OVER o AS last
    FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE last IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gram, range(0, 5) AS x(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
c AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 16 * n_words)::BIGINT
    + 64 * (n_words > 1000000)::BIGINT AS failed
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, (failed & 3) <> 0 AS base_failed, (failed & 119) = 0 AS kept FROM b
"""

#: Exact distinct sites of every line.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
spread AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT doc_id, count(*) AS n, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS joined FROM l WHERE line NOT IN (SELECT line FROM spread) GROUP BY doc_id),
j AS (SELECT d.doc_id, text, len(ls) AS n_all, coalesce(n, 0) AS n_kept, coalesce(joined, '') AS joined FROM d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT doc_id, coalesce(n_all, 0)::BIGINT AS n_lines, coalesce(n_all - n_kept, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN joined END AS text
FROM j
"""

ABLATIONS_SQL = OP6_SQL.rstrip().rpartition("SELECT doc_id, n_words")[0] + r"""
SELECT rule, policy::INTEGER AS policy, count_if(failed & mask & bit <> 0) AS n_failed, count_if(failed & mask = bit) AS n_only, count_if(failed & mask & ~bit = 0) AS n_kept_without
FROM b, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('very_long', 64)) AS r(rule, bit), (VALUES (3, 119), (2, 127)) AS p(policy, mask)
WHERE mask & bit <> 0 GROUP BY rule, policy
"""

ORACLES = {"quality_ablations": ABLATIONS_SQL, "op9_line_spread": OP9_SQL, "op2_url_filter": OP2_SQL, "op6_quality_ledger": OP6_SQL}
