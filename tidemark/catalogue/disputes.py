"""What samples of the documents' blocks disagree about, and which audits stay clear of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import disputes
from ..plans.snapshots import table
from ..plans.store import written


def samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims and citations of three samples: every document has one with all blocks, one without each fourth, and one whose spans start late, some of
    them too late to align; which slot is which follows from the document. Some claims have no owner, and a sample cites blocks of its own."""
    b = texts.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n", F.substring("block_id", 2, 20).cast("int"))
    each = b.drop("text").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("part", (F.col("slot") + F.col("doc_id")) % 3).where("part <> 1 or n % 4 <> 0")
    each = written(each, "samples")  # narrow rows, read several times
    size = F.col("end") - F.col("start")
    late = F.when(F.col("part") == 2, F.when(F.col("n") % 5 == 0, F.floor(size * 2 / 3)).otherwise(F.floor(size / 4))).otherwise(0)
    owner = F.when((F.col("doc_id") % 11 != 0) | (F.col("n") % 5 != 0), F.concat(F.lit("s"), F.col("n").cast("string")))
    claims = each.select("doc_id", "slot", F.col("n").alias("claim"), (F.col("start") + late).cast("int").alias("start"), "end", owner.alias("owner"))
    more = F.when((F.col("part") == 1) & (F.col("n") % 3 == 0), F.concat(F.lit("x"), F.col("n").cast("string")))
    cited = each.select("doc_id", "slot", F.explode(F.array_compact(F.array(F.col("block_id"), more))).alias("block_id"))
    return claims, cited


def _disputed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    claims, cited = samples(spark, sf_dir)
    pairs = disputes.sample_pairs(claims)
    chosen = written(disputes.medoids(claims, pairs, disputes.alignments(claims, pairs)), "medoids")
    return (*disputes.dispute_set(claims, cited, chosen), chosen)


def dispute_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, scope, chosen = _disputed(spark, sf_dir)
    return chosen.select("doc_id", "medoid_slot", F.round("mean_f1", 9).alias("mean_f1")).join(scope, "doc_id").join(ids, "doc_id", "left")


def audit_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of every document with up to three items: warnings, findings and a question, at statements or blocks or at nothing; some hide one."""
    ids, scope, _ = _disputed(spark, sf_dir)
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id").where("doc_id is not null")
    part = F.when(d % 13 == 0, "error").when(d % 4 == 0, "no_findings").otherwise("findings")
    gates = F.array(F.when(d % 2 == 0, F.lit("negation")).otherwise(F.lit("numeric_conflict")))
    audits = docs.select("doc_id", part.alias("semantics"), F.when(d % 8 == 4, "findings").otherwise(part).alias("completeness"), F.when(d % 4 == 0, 0).when(d % 9 == 0, 4).otherwise(2).alias("blocking"), gates.alias("failed_gates"))
    item = F.explode(F.sequence(F.lit(0), F.lit(2)))
    k = F.col("item")
    target = F.when(d % 10 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (d % 7 + k * 3).cast("string"))))
    items = docs.where(d % 4 != 0).select("doc_id", item.alias("item")).select(
        "doc_id", "item", (k == 2).alias("question"), F.when(k == 0, "warning").otherwise("blocking").alias("severity"), F.when(d % 5 == 1, "polarity_subject").otherwise("other").alias("code"),
        target.alias("targets"), F.when((d + k) % 3 == 0, F.concat(F.lit("x"), (d % 5 + k).cast("string"))).alias("block_id"))
    return disputes.audit_scoping(audits, items, ids, scope)


QUERIES = {f.__name__: f for f in (dispute_sets, audit_scopes)}

#: Blocks of one sample do not overlap, so a claim can only align with its own block's: the greedy matching is an equality.
_DISPUTES = r"""WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
  b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n, length(t) AS len FROM parts WHERE regexp_matches(t, '[^\s]')),
  c AS (SELECT doc_id, n, len, slot, (slot + doc_id) % 3 AS part, CASE WHEN (slot + doc_id) % 3 <> 2 THEN 0 WHEN n % 5 = 0 THEN floor(len * 2 / 3) ELSE floor(len / 4) END AS late,
      CASE WHEN doc_id % 11 <> 0 OR n % 5 <> 0 THEN 's' || n END AS owner FROM b, (VALUES (0), (1), (2)) AS s(slot) WHERE (slot + doc_id) % 3 <> 1 OR n % 4 <> 0),
  al AS (SELECT x.doc_id, x.slot AS a, y.slot AS o, x.n FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.n = y.n AND x.slot <> y.slot WHERE (x.len - greatest(x.late, y.late)) >= 0.5 * (x.len - least(x.late, y.late))),
  sz AS (SELECT doc_id, slot, count(*) AS n FROM c GROUP BY ALL),
  f AS (SELECT x.doc_id, x.slot AS a, y.slot AS o, 2.0 * (SELECT count(*) FROM al WHERE al.doc_id = x.doc_id AND al.a = x.slot AND al.o = y.slot)::DOUBLE / (x.n + y.n) AS f1 FROM sz x JOIN sz y ON x.doc_id = y.doc_id AND x.slot <> y.slot),
  me AS (SELECT sz.doc_id, sz.slot, coalesce(avg(f1), 1.0) AS f1 FROM sz LEFT JOIN f ON f.doc_id = sz.doc_id AND f.a = sz.slot GROUP BY ALL),
  med AS (SELECT doc_id, slot::INTEGER AS m, f1 FROM me QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, slot) = 1),
  missed AS (SELECT DISTINCT c.doc_id, c.owner FROM med JOIN c ON c.doc_id = med.doc_id AND c.slot = med.m JOIN sz o ON o.doc_id = med.doc_id AND o.slot <> med.m
    WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.doc_id = c.doc_id AND al.a = c.slot AND al.o = o.slot AND al.n = c.n)),
  cited AS (SELECT doc_id, slot, 'b' || lpad(n::VARCHAR, 6, '0') AS id FROM c UNION ALL SELECT doc_id, slot, 'x' || n FROM c WHERE part = 1 AND n % 3 = 0),
  ids AS (SELECT doc_id, 'statement' AS kind, owner AS id FROM missed WHERE owner IS NOT NULL
    UNION ALL (SELECT doc_id, 'block', id FROM cited JOIN med USING (doc_id) WHERE slot <> m EXCEPT SELECT doc_id, 'block', id FROM cited JOIN med USING (doc_id) WHERE slot = m)),
  scope AS (SELECT doc_id, NOT EXISTS (SELECT 1 FROM missed WHERE missed.doc_id = med.doc_id AND owner IS NULL) AS scoped FROM med)"""
_AUDITS = f"""{_DISPUTES},
  it AS (SELECT doc_id, k, k = 2 AS question, doc_id % 5 = 1 AS pol, CASE WHEN doc_id % 10 = 3 THEN [] ELSE ['s' || (doc_id % 7 + k * 3)] END || CASE WHEN (doc_id + k) % 3 = 0 THEN ['x' || (doc_id % 5 + k)] ELSE [] END AS named
    FROM documents, (VALUES (1), (2)) AS v(k) WHERE doc_id % 4 <> 0),
  touched AS (SELECT DISTINCT it.doc_id FROM it LEFT JOIN scope USING (doc_id) WHERE NOT coalesce(scoped, false) OR len(named) = 0 OR (NOT question AND pol AND doc_id % 2 = 0)
    OR EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = it.doc_id AND list_contains(named, ids.id)))
SELECT doc_id, doc_id % 4 = 0 AND doc_id % 13 <> 0 AND doc_id % 8 <> 4 AS clean,
  doc_id % 13 <> 0 AND (doc_id % 4 = 0 OR doc_id % 9 <> 0) AND doc_id IN (SELECT doc_id FROM scope) AND doc_id NOT IN (SELECT doc_id FROM touched) AS off_dispute FROM documents WHERE doc_id IS NOT NULL"""
ORACLES = {
    "dispute_sets": f"{_DISPUTES} SELECT doc_id, m AS medoid_slot, round(f1, 9) AS mean_f1, scoped, kind, id FROM med JOIN scope USING (doc_id) LEFT JOIN ids USING (doc_id)",
    "audit_scopes": _AUDITS,
}
