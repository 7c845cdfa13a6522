"""Records assembled from emits that fixed rules make from the documents, sealed; the same hash in SQL from the record's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import assembly
from ..plans.snapshots import table
from ..plans.store import written

#: The closing lines that every document gets, so that each has a heading and a fact.
_TERMS = "\n# Terms\nAt least {} years of work"


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its closing lines and an emit over its blocks: statements on three blocks of four, mentions with dangling links, one fact.

    Every thirteenth cites an unknown block, every 26th also has a note with a character that no reader sees."""
    head, tail = (F.lit(x) for x in _TERMS.split("{}"))
    years = (F.col("doc_id") % 9 + 1).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), head, years, tail).alias("text"))
    # the blocks are numbered within the row, so no text is shuffled
    block = lambda t, i: F.struct((i + 1).alias("n"), F.concat(F.lit("b"), F.lpad((i + 1).cast("string"), 6, "0")).alias("block_id"), t.alias("text"))
    blocks = F.transform(F.filter(F.split("text", "\n", -1), lambda t: t.rlike(texts.SHOWN)), block)
    none = F.lit(None).cast("string")
    ref = lambda b, quote=none: F.struct(b["block_id"].alias("block_id"), quote.alias("text"), F.when(quote.isNotNull(), 0).alias("occurrence"))
    sid = lambda n: F.concat(F.lit("s"), n.cast("string"))
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("qualification", "benefit", "responsibility"))), n % 3 + 1)
    statement = lambda b: F.struct(
        sid(b["n"]).alias("id"), pick(b["n"]).alias("kind"), F.concat(F.lit("t"), (b["n"] % 5).cast("string")).alias("topic"), F.lit("positive").alias("polarity"),
        F.array(ref(b, F.when(b["n"] % 3 == 0, F.substring(b["text"], 1, 12)))).alias("evidence"), F.when(b["n"] % 5 == 0, F.array(ref(b))).alias("polarity_evidence"))
    mention = lambda b: F.struct(
        F.concat(F.lit("m"), b["n"].cast("string")).alias("id"), F.concat(F.lit("Straße "), b["n"].cast("string")).alias("surface"), ref(b).alias("evidence"),
        F.array(sid(b["n"]), sid(b["n"] + 3), F.lit("x")).alias("statement_ids"))
    last = F.element_at("b", -1)
    fact = F.struct(F.lit("f1").alias("id"), F.lit("experience").alias("family"), F.struct(
        F.array(ref(last, F.concat(years, F.lit(" years")))).alias("value"), F.array(ref(last, F.lit("At least"))).alias("comparison")).alias("evidence"))
    state = lambda s: F.struct(F.lit(s).alias("state"))
    unknown = F.when(F.col("doc_id") % 13 == 0, F.array(F.struct(F.lit("b999999").alias("block_id"), none.alias("text"), F.lit(None).cast("int").alias("occurrence"))))
    area = F.struct(F.lit("a1").alias("id"), F.lit("area").alias("name"), F.array(F.lit("s1")).alias("statement_ids"), unknown.alias("evidence"))
    emit = F.struct(
        F.struct(F.lit("usable").alias("usability"), F.when(F.col("doc_id") % 26 == 0, "a​b").alias("note")).alias("source_assessment"),
        F.transform(F.filter("b", lambda b: b["n"] % 4 != 0), statement).alias("statements"),
        F.struct(F.struct(state("none_found").alias("experience"), state("stated").alias("compensation")).alias("presence"), F.array(fact).alias("entries")).alias("facts"),
        F.transform(F.filter("b", lambda b: b["n"] % 6 == 1), mention).alias("mentions"), F.array(area).alias("areas"))
    emits = docs.where("doc_id is not null").withColumn("b", blocks).select("doc_id", "text", F.to_json(emit).alias("emit"))
    return emits.withColumns({"document_hash": F.sha2("text", 256), "normalizer_version": F.lit("md/1")})


def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = {"model": F.lit("m"), "schema_version": F.lit("4"), "at": F.lit("2026-01-01"), "parent_candidate_hash": F.lit(None).cast("string")}
    got = assembly.assemble(written(extractions(spark, sf_dir), "emits"), left)
    n = F.size(F.try_variant_get("record", "$.statements", "array<variant>"))
    return got.select("doc_id", F.when(F.col("record").isNotNull(), n).alias("n_statements"), "candidate_hash", F.array_join("errors", "; ").alias("errors"))


QUERIES = {"assembled_records": assembled_records}

_REF = """'{"block_id":"' || block_id || '","occurrence":0,"span":[' || s || ',' || e || '],"text":' || to_json(text) || '}'"""
_POLARIZED = '{"evidence":null,"polarity":null,"polarity_evidence":null,"state":null}'
ORACLES = {
    "assembled_records": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || '# Terms' || chr(10) || 'At least ' || (doc_id % 9 + 1) || ' years of work' AS text, doc_id % 9 + 1 AS k FROM documents),
  ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM d),
  lo AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM ln),
  b0 AS (SELECT doc_id, text, s, (s + length(text))::INTEGER AS e, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INTEGER AS n FROM lo WHERE regexp_matches(text, '[^\s]')),
  b AS (SELECT *, 'b' || lpad(n::VARCHAR, 6, '0') AS block_id, max(n) OVER (PARTITION BY doc_id) AS m,
    last_value(CASE WHEN regexp_matches(text, '^#{{1,6}}\s+\S') THEN trim(regexp_replace(text, '^#+\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS h FROM b0),
  r AS (SELECT *, {_REF} AS whole FROM b),
  q AS (SELECT * REPLACE (CASE WHEN n % 3 = 0 THEN s + least(12, e - s) ELSE e END AS e, CASE WHEN n % 3 = 0 THEN substr(text, 1, 12) ELSE text END AS text) FROM r),
  st AS (SELECT doc_id, count(*)::INTEGER AS c, string_agg('{{"condition_ids":[],"evidence":[' || {_REF} || '],"fact_ids":[],"id":"s' || n || '","kind":"' || ['qualification', 'benefit', 'responsibility'][n % 3 + 1]
      || '","modality_evidence":null,"polarity":"positive","polarity_evidence":' || CASE WHEN n % 5 = 0 THEN '[' || whole || ']' ELSE 'null' END || ',"section_heading":' || coalesce(to_json(h), 'null')
      || ',"subject":null,"topic":"t' || (n % 5) || '","unresolved":[]}}', ',' ORDER BY n) AS j FROM q WHERE n % 4 <> 0 GROUP BY doc_id),
  me AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS i, (n + 3) % 4 <> 0 AND n + 3 <= m AS live FROM r WHERE n % 6 = 1),
  mj AS (SELECT doc_id, string_agg('{{"evidence":' || whole || ',"id":"m' || n || '","normalized_key":"strasse ' || n || '","role":null,"statement_ids":["s' || n || '"' || CASE WHEN live THEN ',"s' || (n + 3) || '"' ELSE '' END
      || '],"surface":"Straße ' || n || '","type":null}}', ',' ORDER BY n) AS j,
    string_agg(CASE WHEN live THEN '' ELSE '{{"path":"mentions[' || i || '].statement_ids","ref_id":"s' || (n + 3) || '"}},' END || '{{"path":"mentions[' || i || '].statement_ids","ref_id":"x"}}', ',' ORDER BY n) AS lost FROM me GROUP BY doc_id),
  f AS (SELECT doc_id, k, '[{{"block_id":"' || block_id || '","occurrence":0,"span":[' || s || ',' || (s + 8) || '],"text":"At least"}}]' AS cmp,
    '[{{"block_id":"' || block_id || '","occurrence":0,"span":[' || (s + 9) || ',' || (s + 16) || '],"text":"' || k || ' years"}}]' AS val FROM b JOIN d USING (doc_id) WHERE n = m),
  rec AS (SELECT d.doc_id, c, '{{"areas":[{{"evidence":null,"id":"a1","kind":null,"name":"area","statement_ids":["s1"]}}],"authorization":{{"citizenship_required":false,"evidence":{{"citizenship":null,"sponsorship":null,"work_authorization":null}},"sponsorship":"undeclared"}},"block_accounting":[],"document":{{"annotation_version":"blocks/1","document_hash":"'
      || sha256(d.text) || '","normalizer_version":"md/1"}},"extraction":{{"at":"2026-01-01","candidate_hash":"","dropped_links":[' || lost || '],"model":"m","parent_candidate_hash":null,"schema_version":"4"}},"facts":{{"entries":[{{"component":null,"condition_ids":[],"date_kind":null,"derived":{{"date":null,"money":null,"quantity":{{"comparison":"gte","dimension":"duration","inclusive_max":null,"inclusive_min":true,"max_value":null,"min_value":'
      || (f.k * 12) || '.0,"unit":"month"}},"state":"parsed"}},"evidence":{{"applicability":null,"comparison":' || cmp || ',"component":null,"currency":null,"unit":null,"value":' || val || '}},"family":"experience","id":"f1","scope":null,"statement_ids":[]}}],"presence":{{"citizenship":{_POLARIZED},"compensation":{{"evidence":null,"state":"none_found"}},"dates":{{"evidence":null,"state":null}},"experience":{{"evidence":null,"state":"stated"}},"quantities":{{"evidence":null,"state":null}},"sponsorship":{_POLARIZED},"work_authorization":{_POLARIZED}}}}},"mentions":['
      || mj.j || '],"quality":null,"relations":{{"conditions":[],"example_sets":[],"groups":[],"tracks":null}},"source_assessment":{{"evidence":null,"note":null,"usability":"usable"}},"statements":[' || st.j || ']}}' AS j
    FROM d JOIN st USING (doc_id) JOIN mj USING (doc_id) JOIN f USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN c END AS n_statements, CASE WHEN doc_id % 13 <> 0 THEN sha256(j) END AS candidate_hash,
  CASE WHEN doc_id % 26 = 0 THEN 'emit.source_assessment.note: control character U+200B in emitted string; ' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN 'areas[0].evidence[0]: unknown_block' ELSE '' END AS errors FROM rec""",
}
