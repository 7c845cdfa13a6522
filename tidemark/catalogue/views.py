"""Views over several tables, attempt counts, queues, value signatures and vocabulary terms as registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, terms, texts
from ..operators import contract, views
from ..plans import lifecycle as lc
from ..plans.snapshots import attempts_and_observations, event_snapshots, table
from .lifecycle import LIFE
from .reads import EX, _extractions


def posting_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.posting_details(event_snapshots(spark, sf_dir))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    versions = F.transform("versions", lambda v: F.concat(F.left(v["version"], F.lit(8)), F.lit("@"), day(v["at"])))
    history = F.transform("events", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["kind"], F.lit("@"), day(e["at"])))
    return p.select("board", "uid", "state", "current_version", "version_count", "reopen_count", F.array_join(versions, " ").alias("versions"), F.array_join(history, " ").alias("history"))


def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts, observations = attempts_and_observations(table(spark, sf_dir, "events"))
    return views.attempt_counts(lc.replay(attempts, observations), observations)


def source_updated_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third sighting brings a time of update."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("uid"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("updated_at"))
    return views.carried(e, ["board", "uid"], "updated_at", "event_id")


def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(views.title_matches(F.col("p_name"), "^[A-M].* b")).select("p_partkey", "p_name")


def document_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version renders to the documents of its first and second digit."""
    life = event_snapshots(spark, sf_dir)
    versions = life.rows.where("vh IS NOT NULL").select("board", "uid", F.col("vh").alias("version")).distinct()
    documents = versions.select("version").distinct().withColumn("document_hash", F.explode(F.array_distinct(F.array(F.substring("version", 1, 1), F.substring("version", 2, 1)))))
    return views.document_reach(documents, versions, life.postings)


def _documents_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extractions(spark, sf_dir).withColumn("document_hash", F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string")))


def extraction_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inbox(_documents_extracted(spark, sf_dir), "p1").select("document_hash", "doc_id", "status", "superseded", "updated_at")


def extraction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the attempts of customers, under one priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_hash"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderkey").alias("attempt_no"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("prompt_version"))
    h = views.attempt_history(o, {"prompt_version": "5-LOW"})
    told = F.transform("attempts", lambda a: F.concat(a["attempt_no"].cast("string"), F.lit(":"), a["outcome"]))
    return h.select("document_hash", F.array_join(told, " ").alias("attempts"))


def refuter_verb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    actor = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "refuter:").otherwise("human:"), F.col("o_custkey").cast("string"))
    return views.refuter_verbs(o.select(actor.alias("actor"), F.col("o_orderpriority").alias("verb")))


def claims_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: a line is a statement of its return flag's kind, linked to its supplier's group; every third has no heading key, the next a null one."""
    line = F.struct(*[F.col(f"l_{c}").alias(c) for c in ("linenumber", "partkey", "suppkey", "linestatus", "returnflag")])
    records = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("xs"))
    named = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sid = lambda x: F.concat_ws("-", F.lit("s"), *[x[c].cast("string") for c in ("linenumber", "partkey", "suppkey", "linestatus")])
    surface = lambda x: F.concat(F.lit("Supplier "), (x["suppkey"] % 3).cast("string"))

    def statement(x):
        n = x["linenumber"]
        heading = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit(',"section_heading":"H'), x["linestatus"], F.lit('"'))).otherwise(',"section_heading":null')
        modality = F.when(n % 2 == 0, F.concat(F.lit('[{"text":"must '), n.cast("string"), F.lit('"}]'))).otherwise("[]")
        return F.concat(F.lit('{"id":'), named(sid(x)), F.lit(',"kind":'), named(x["returnflag"]), heading, F.lit(',"modality_evidence":'), modality, F.lit("}"))

    mention = lambda x: F.concat(F.lit('{"surface":'), named(surface(x)), F.lit(',"statement_ids":['), named(sid(x)), F.lit("]}"))
    of = lambda f: F.array_join(F.transform("xs", f), ",")
    profile = F.concat(F.lit('{"mentions":['), of(mention), F.lit('],"statements":['), of(statement), F.lit("]}"))
    wanted = F.array_distinct(F.transform("xs", lambda x: F.struct(surface(x).alias("surface"), x["returnflag"].alias("kind"))))
    raised = F.transform(wanted, lambda w: F.struct(F.upper(w["surface"]).alias("surface"), w["kind"].alias("kind")))
    found = records.select("l_orderkey", F.explode(F.arrays_zip(wanted.alias("r"), views.mention_contexts(profile, raised).alias("c"))).alias("x")).select("l_orderkey", "x.r.*", "x.c")
    return found.select("l_orderkey", "surface", "kind", F.col("c").isNotNull().alias("has_context"), "c.section_heading", "c.modality")


def profile_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _documents_extracted(spark, sf_dir).withColumn("profile", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("profile "), F.col("doc_id").cast("string"))))
    titles = x.where("doc_id % 97 % 3 > 0").select("document_hash", F.concat(F.lit("Title "), "document_hash").alias("title")).distinct()
    return views.served_profiles(x, titles, "p1").select("document_hash", "status", "model", "prompt_version", "historical", "profile", "title")


def bookkeeping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, their lines as findings."""
    k = F.col("o_orderkey")
    candidates = table(spark, sf_dir, "orders").select(k.alias("doc_id"), (k % 4).alias("extracted"), (k % 11).alias("accounted"), F.lit(10).alias("blocks"))
    n = F.col("l_linenumber")
    code = F.element_at(F.array(*map(F.lit, views.BOOKKEEPING_CODES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    odd, mild = F.col("l_suppkey") % 9 == 0, F.col("l_suppkey") % 9 == 1
    findings = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("line"), F.when(odd, "mentions").when(mild, "mentions").otherwise("accounting").alias("check"),
        F.when(odd, "skill_unbound").when(mild, "skill_outside_demand").otherwise(code).alias("code"), F.when(mild | (n % 5 == 0), "warning").otherwise("error").alias("severity"),
    )
    return views.bookkeeping_gaps(candidates, findings)


def value_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    when = lambda c, v: F.when(c, v)
    quantity = when(n % 3 == 0, F.struct(
        F.lit("months").alias("dimension"), F.lit("range").alias("comparison"), F.col("l_quantity").alias("min_value"), when(k % 2 == 0, F.col("l_quantity") + 0.5).alias("max_value"),
        (k % 2 == 0).alias("inclusive_min"), F.lit(None).cast("boolean").alias("inclusive_max"), when(k % 3 == 0, F.lit("m")).alias("unit")))
    money = when(n % 3 == 1, F.struct(
        F.lit("gte").alias("comparison"), k.cast("string").alias("min_amount"), F.lit(None).cast("string").alias("max_amount"), when(k % 2 == 0, F.lit("USD")).alias("currency"), F.lit("year").alias("period")))
    ship = F.to_date("l_shipdate")
    date = when(n % 3 == 2, F.struct(when(k % 2 == 0, ship).alias("date"), when(k % 2 == 1, F.array(ship, F.date_add(ship, 1))).alias("candidates")))
    signature = views.value_signature(F.col("l_returnflag"), when(k % 4 == 0, F.lit("role")), when(n % 3 == 2, F.lit("deadline")), F.lit(None).cast("string"), F.lit("parsed"), quantity, money, date)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", signature.alias("signature"))


def evaluation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(views.evaluation_name(F.col("text"))).alias("name"))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with one date, two, none, an impossible one, or a word that is no month."""
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(k == 0, F.concat(F.lit("Apply by "), f("MMMM d, yyyy"), F.lit("."))).when(k == 1, F.concat(F.lit("closes "), f("MM/dd/yy"))).when(k == 2, F.concat(f("MMM. d,yyyy"), F.lit(" or "), f("M/d/yyyy")))
        .when(k == 3, F.concat(F.lit("Feb 30, "), f("yyyy"))).when(k == 4, F.concat(F.lit("Room "), f("d, yyyy"), F.lit(" until "), f("M/d/yyyy"))).when(k == 5, F.concat(f("dd/MM/yyyy"), F.lit(" at noon"))).otherwise(F.lit("rolling"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", grammar.deadline(text).alias("deadline"))


def out_of_scope_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks: some end with boilerplate, some of those with a requirement."""
    t = F.col("turn") % 4
    text = F.concat("text", F.when(t == 0, " See our Privacy Notice.").when(t == 1, " E-Verify; it is required.").when(t == 2, " must").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", contract.out_of_scope(text).alias("out_of_scope"))


def skill_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents as quotes; the vocabulary is every long word and word pair of the benchmark's items; a document's own mention is its first long word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = texts.annotate(d)
    quotes = b.select("doc_id", F.col("block_id").alias("statement_id"), F.col("block_id").alias("rank"), F.col("text").alias("line"), F.col("start").alias("line_start"), F.lit(0).alias("lo"), F.length("text").alias("hi"))
    item = terms.window_spans(F.col("text"), F.lit(0), F.length("text"))
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(item).alias("w")).select("w.key").where("size(split(key, ' ')) = 2 OR (length(key) >= 7 AND NOT contains(key, ' '))").distinct()
    first = F.regexp_extract("text", "([A-Za-z]{7,})", 1)
    at = F.instr("text", first) - 1
    mentions = d.where("text rlike '[A-Za-z]{7,}'").select("doc_id", F.lower(first).alias("key"), at.alias("start"), (at + F.length(first)).alias("end"))
    found = terms.skill_pass(quotes, vocabulary, mentions)
    return found.select("doc_id", "key", "surface", "start", "end", F.array_join("statement_ids", ",").alias("statement_ids"))


QUERIES = {f.__name__: f for f in (
    posting_details, attempt_counts, source_updated_carry, title_filter, document_reach, extraction_inbox, extraction_history, refuter_verb_counts, claims_context, profile_views, bookkeeping_gaps,
    value_signatures, evaluation_names, deadlines, out_of_scope_turns, skill_pass,
)}

EXD = EX + ", x AS (SELECT *, 'd' || (doc_id % 97)::VARCHAR AS dh FROM ex)"
_KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("opened", "changed", "closed", "reopened"))
_COUNTS = ", ".join(f"CASE WHEN a.is_error THEN 0 ELSE coalesce({c}, 0) END::BIGINT AS {c}" for c in ("observed", "parsed", "failed", "pending", "duplicate_ids", "opened", "changed", "closed", "reopened"))
_CODES = "['coverage_unevidenced', 'block_unaccounted', 'context_requirement_language', 'exclusion_requirement_language']"
ORACLES = {
    "posting_details": """, v AS (SELECT board, uid, vh, min(at) AS at FROM rows_ WHERE vh IS NOT NULL GROUP BY ALL), vs AS (SELECT board, uid, string_agg(left(vh, 8) || '@' || strftime(at, '%Y-%m-%d'), ' ' ORDER BY at, vh) AS versions FROM v GROUP BY ALL),
      es AS (SELECT board, uid, string_agg(event_id || ':' || kind || '@' || strftime(at, '%Y-%m-%d'), ' ' ORDER BY event_id) AS history FROM ev GROUP BY ALL)
      SELECT board, uid, state, nullif(cv, '') AS current_version, version_count, reopen_count, coalesce(versions, '') AS versions, coalesce(history, '') AS history FROM posting LEFT JOIN vs USING (board, uid) LEFT JOIN es USING (board, uid)""",
    "attempt_counts": f""", u AS (SELECT board, attempt_id, uid, arg_min(status, pos) AS status, count(*) AS n FROM obs0 GROUP BY ALL),
      s AS (SELECT board, attempt_id, count(*) AS observed, count(*) FILTER (status = 'ok') AS parsed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, sum(n) - count(*) AS duplicate_ids FROM u GROUP BY ALL),
      m AS (SELECT board, attempt_id, {_KINDS} FROM ev GROUP BY ALL)
      SELECT board, attempt_id, at, health, {_COUNTS} FROM att a LEFT JOIN s USING (board, attempt_id) LEFT JOIN m USING (board, attempt_id)""",
    "source_updated_carry": "SELECT event_type AS board, user_id AS uid, arg_max(ts, event_id) FILTER (event_id % 3 = 0) AS updated_at FROM events GROUP BY ALL",
    "title_filter": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[A-M].* b', 'i')",
    "document_reach": """, v AS (SELECT DISTINCT board, uid, vh FROM rows_ WHERE vh IS NOT NULL), d AS (SELECT DISTINCT vh, unnest([vh[1], vh[2]]) AS document_hash FROM v)
      SELECT document_hash, count(DISTINCT vh) AS n_versions, count(DISTINCT board || '/' || uid) AS n_postings, count(DISTINCT CASE WHEN state = 'open' AND cv = vh THEN board || '/' || uid END) AS n_open FROM d JOIN v USING (vh) JOIN posting USING (board, uid) GROUP BY ALL""",
    "extraction_inbox": EXD + " SELECT dh AS document_hash, doc_id, status, dh IN (SELECT dh FROM x WHERE prompt_version = 'p1' AND status = 'validated') AS superseded, updated_at FROM x WHERE status IN ('needs_review', 'quarantined')",
    "extraction_history": "SELECT o_custkey AS document_hash, string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderdate, o_orderkey) AS attempts FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey",
    "refuter_verb_counts": "SELECT o_orderpriority AS verb, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL",
    "claims_context": """WITH l AS (SELECT *, 'Supplier ' || (l_suppkey % 3) AS surface, l_returnflag AS kind FROM lineitem), g AS (SELECT DISTINCT l_orderkey, surface, kind FROM l),
      f AS (SELECT * FROM l WHERE l_linenumber % 3 > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, surface, kind ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) = 1)
      SELECT g.*, f.l_orderkey IS NOT NULL AS has_context, CASE WHEN l_linenumber % 3 = 1 THEN 'H' || l_linestatus END AS section_heading, CASE WHEN l_linenumber % 2 = 0 THEN 'must ' || l_linenumber END AS modality FROM g LEFT JOIN f ON f.l_orderkey = g.l_orderkey AND f.surface = g.surface AND f.kind = g.kind""",
    "profile_views": EXD + """, c AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY dh ORDER BY prompt_version = 'p1' DESC, status = 'validated' DESC, updated_at DESC, model DESC) = 1)
      SELECT dh AS document_hash, status, model, prompt_version, prompt_version <> 'p1' AS historical, 'profile ' || doc_id AS profile, CASE WHEN doc_id % 97 % 3 > 0 THEN 'Title ' || dh END AS title FROM c WHERE status <> 'quarantined' AND doc_id % 5 > 0""",
    "bookkeeping_gaps": f"""WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN l_suppkey % 9 < 2 THEN 'mentions' ELSE 'accounting' END AS "check",
        CASE l_suppkey % 9 WHEN 0 THEN 'skill_unbound' WHEN 1 THEN 'skill_outside_demand' ELSE {_CODES}[(l_partkey % 4 + 1)::INTEGER] END AS code, CASE WHEN l_suppkey % 9 = 1 OR l_linenumber % 5 = 0 THEN 'warning' ELSE 'error' END AS severity FROM lineitem)
      SELECT f.* FROM f JOIN orders ON o_orderkey = doc_id WHERE o_orderkey % 4 >= 1 AND 2 * (o_orderkey % 11) > 10 AND severity = 'error' AND NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.code = 'skill_unbound')""",
    "value_signatures": """WITH l AS (SELECT *, l_linenumber % 3 AS m, l_partkey % 2 = 0 AS even, l_shipdate::DATE AS ship FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || '|' || CASE WHEN l_partkey % 4 = 0 THEN 'role' ELSE '' END || '|' || CASE WHEN m = 2 THEN 'deadline' ELSE '' END || '||parsed' || CASE m
        WHEN 0 THEN '|q|months|range|' || l_quantity::INTEGER || '|' || CASE WHEN even THEN (l_quantity + 0.5)::VARCHAR ELSE 'None' END || '|' || CASE WHEN even THEN 'True' ELSE 'False' END || '|None|' || CASE WHEN l_partkey % 3 = 0 THEN 'm' ELSE 'None' END
        WHEN 1 THEN '|m|gte|' || l_partkey || '|None|' || CASE WHEN even THEN 'USD' ELSE 'None' END || '|year'
        ELSE '|d|' || CASE WHEN even THEN ship || '|' ELSE 'None|' || ship || ',' || (ship + 1) END END AS signature FROM l""",
    "evaluation_names": r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}+#./ ]', ' ', 'g'), ' +', ' ', 'g'))) AS name FROM conversations",
    "deadlines": r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, 'Apply by %B %-d, %Y.') WHEN 1 THEN strftime(o_orderdate, 'closes %m/%d/%y') WHEN 2 THEN strftime(o_orderdate, '%b. %-d,%Y or %-m/%-d/%Y') WHEN 3 THEN strftime(o_orderdate, 'Feb 30, %Y')
        WHEN 4 THEN strftime(o_orderdate, 'Room %-d, %Y until %-m/%-d/%Y') WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y at noon') ELSE 'rolling' END AS t FROM orders),
      w AS (SELECT *, [x FOR x IN regexp_extract_all(t, '[A-Za-z]+\.?\s+\d{1,2},\s*\d{4}') IF regexp_matches(lower(x), '^(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)[^a-z]')] AS a, regexp_extract_all(t, '\b\d{1,2}/\d{1,2}/\d{2}(?:\d{2})?\b') AS b FROM t)
      SELECT o_orderkey, CASE WHEN len(a) + len(b) <> 1 THEN NULL WHEN len(a) = 1 THEN try_strptime(left(a[1], 3) || ' ' || regexp_extract(a[1], '(\d{1,2}),\s*(\d{4})', 1) || ' ' || right(a[1], 4), '%b %-d %Y')::DATE
        ELSE try_cast((CASE WHEN length(string_split(b[1], '/')[3]) = 2 THEN '20' ELSE '' END || string_split(b[1], '/')[3]) || '-' || lpad(string_split(b[1], '/')[1], 2, '0') || '-' || lpad(string_split(b[1], '/')[2], 2, '0') AS DATE) END AS deadline FROM w""",
    "out_of_scope_turns": r"""WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' See our Privacy Notice.' WHEN 1 THEN ' E-Verify; it is required.' WHEN 2 THEN ' must' ELSE '' END AS t FROM conversations)
      SELECT conv_id, turn, regexp_matches(t, '(?i)privacy (notice|statement|policy)|e-verify|phishing|fraudulent|fair chance|affirmative action') AND NOT regexp_matches(t, '(?i)\b(must|requir\w*|minimum|at least|only candidates|need to|proficien\w*|fluen\w*)\b') AS out_of_scope FROM t""",
}
ORACLES |= {name: re.sub(r"\bat\b", '"at"', LIFE + ORACLES[name]) for name in ("posting_details", "attempt_counts", "document_reach")}  # DuckDB reads a bare at as a keyword
