"""The served slice of a record: its claim index, from the record's flat tables.

Tables (one row per object, doc_id in each): statements (statement_id, topic, kind, importance, proficiency, polarity, subject,
section_heading, modality, pos), mentions (mention_id, surface, statement_ids, pos), facts (fact_id, family, statement_ids, signature, pos), groups
(operator, members) and references (owner: statement, mention or fact; owner_id, start, end, text). pos is an object's place in its list.

Every assertion of a record becomes a claim with one footprint, the envelope of the spans it cites: a claim for each statement, for each
(mention, statement) link and for each fact. The tables become one table of objects, which is shuffled once, by doc_id; what rows tell of each other is
found by windows inside a document: which ids are statements, then an object's spans and a fact's anchor (the first of its statement ids that is a
statement), then what a statement's rows tell of it. Rows are narrow until that last window, and none is sorted after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import case_fold

#: The importance of an area without a verdict (a fixed value).
NO_IMPORTANCE = "contextual"
SOURCES = ["statement", "mention", "fact"]
_STATEMENT = ["topic", "kind", "importance", "proficiency", "polarity", "subject", "section_heading", "modality", "pos"]
_AREA = ["doc_id", "area_id", "area_name", "area_kind", "area_importance", "area_level", "area_pos"]


def objects(statements: DataFrame, mentions: DataFrame, facts: DataFrame, groups: DataFrame, references: DataFrame) -> DataFrame:
    """What `claims` takes, a row for each object and each reference: doc_id, source (of a reference: its owner's), owner_id, pos, names (the statement ids it
    names; a statement its own), statement (its columns), told (a mention's surface, a fact's signature, a group's operator), family, cites (spans with
    texts, on the object's row or on rows without `object`), object (whether the row is one)."""
    of = lambda rows, source, **columns: rows.select("doc_id", F.lit(source).alias("source"), F.lit(True).alias("object"), *[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()])
    rows = of(statements, "statement", owner_id="statement_id", pos="pos", names=F.array("statement_id"), statement=F.struct(*_STATEMENT))
    each = F.struct("start", "end", F.coalesce("text", F.lit("")).alias("text"))
    for more in (
        of(mentions, "mention", owner_id="mention_id", pos="pos", names="statement_ids", told="surface"),
        of(facts, "fact", owner_id="fact_id", pos="pos", names="statement_ids", told="signature", family="family"),
        of(groups, "group", names="members", told="operator"),
        references.where(F.col("owner").isin(SOURCES)).select("doc_id", F.col("owner").alias("source"), "owner_id", F.array(each).alias("cites")),
    ):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def claims(objects: DataFrame) -> DataFrame:
    """The claims (see claim_index) of the objects of records. Objects that are dealt by doc_id are not shuffled again."""
    is_ = lambda source: F.col("source") == source
    # a fact's own row comes before the places where it names a statement
    names = F.when(is_("fact") & F.col("object"), F.concat(F.array(F.lit(None).cast("string")), F.coalesce("names", F.array().cast("array<string>")))).otherwise(F.col("names"))
    rows = objects.withColumns({
        "_names": names, "_link": F.when(is_("mention"), case_fold(F.col("told"))), "_route": F.when(is_("group"), F.struct(F.col("told").alias("operator"), F.col("names").alias("members")))})
    rows = rows.select("doc_id", "source", "owner_id", "object", "pos", "statement", "told", "family", "cites", "_link", "_route", F.posexplode_outer("_names").alias("_at", "statement_id"))
    first = F.coalesce("_at", F.lit(0)) == 0
    own = is_("fact") & F.col("object") & first
    named = F.col("doc_id").isNotNull() & F.col("statement_id").isNotNull()
    rows = rows.withColumns({"_own": F.coalesce(own, F.lit(False)), "cites": F.when(first & F.col("doc_id").isNotNull() & F.col("owner_id").isNotNull(), F.col("cites"))})
    rows = rows.where(named | is_("statement") | F.col("_own") | F.col("cites").isNotNull())

    def by_statement():
        return Window.partitionBy("doc_id", "statement_id")

    owner = Window.partitionBy("doc_id", "source", "owner_id")
    rows = rows.withColumn("_known", F.max(is_("statement") & F.col("object")).over(by_statement()))
    anchor = F.min_by("statement_id", F.when(F.col("_known") & is_("fact") & ~F.col("_own") & F.col("owner_id").isNotNull(), F.col("_at"))).over(owner)
    spans = F.sort_array(F.flatten(F.collect_list("cites").over(owner)))
    rows = rows.withColumns({"_anchor": anchor, "_spans": spans}).where(F.col("object") & (named | is_("statement") | F.col("_own")))
    quote = F.when(F.size("_spans") > 0, F.array_join("_spans.text", " "))
    rows = rows.select(
        "doc_id", "source", "owner_id", "pos", "statement", "told", "family", "_link", "_route", "_own", F.when(F.col("_own"), F.col("_anchor")).otherwise(F.col("statement_id")).alias("statement_id"),
        F.array_min("_spans.start").alias("start"), F.array_max("_spans.end").alias("end"), quote.alias("quote"))

    every = lambda column, collect=F.collect_list: collect(column).over(by_statement())
    rows = rows.withColumns({
        "_areas": every(F.when(is_("statement"), F.col("statement"))), "_values": every(F.when(is_("fact") & ~F.col("_own"), F.col("told"))), "_links": every("_link", F.collect_set), "_routes": every("_route")})
    rows = rows.where(is_("statement") | is_("mention") | F.col("_own"))
    # a list may name a statement twice: both are claims; a mention of an unknown one makes none
    areas = F.when(is_("statement"), F.array("statement")).when(F.col("statement_id").isNotNull(), F.col("_areas"))
    rows = rows.withColumn("_s", F.explode_outer(areas)).where(F.col("_s").isNotNull() | F.col("_own")).withColumnRenamed("pos", "_pos").withColumns({n: F.col(f"_s.{n}") for n in _STATEMENT})

    known = F.col("_s").isNotNull()
    routes, links = F.sort_array("_routes"), F.when(known, F.sort_array("_links")).otherwise(F.array().cast("array<string>"))
    rank = F.when(is_("statement"), 0).when(is_("mention"), 1).otherwise(2)
    place = F.struct(rank.alias("rank"), F.when(is_("statement"), 0).otherwise(F.col("_pos")).alias("pos"))
    return rows.select(
        "doc_id", "source", "owner_id", F.when(known, F.col("statement_id")).otherwise(F.col("owner_id")).alias("area_id"), F.when(known, F.col("topic")).otherwise(F.col("family")).alias("area_name"),
        F.when(known, F.col("kind")).otherwise("fact").alias("area_kind"), F.coalesce("importance", F.lit(NO_IMPORTANCE)).alias("area_importance"), F.col("proficiency").alias("area_level"),
        F.struct(F.when(known, 0).otherwise(1).alias("kind"), F.when(known, F.col("pos")).otherwise(F.col("_pos")).alias("pos")).alias("area_pos"),
        *[c.alias(n) for n, c in _labels(F.when(known, F.col("statement_id"))).items()], links.alias("entity_links"), F.when(known & (F.size(routes) > 0), routes).alias("alternatives"),
        F.when(F.col("_own"), F.array("told")).otherwise(F.sort_array("_values")).alias("values"), place.alias("claim_pos"), "start", "end", "quote")


def _labels(statement_id: Column) -> dict[str, Column]:
    """What a claim takes from its statement; nothing where there is none."""
    known, plain = statement_id.isNotNull(), F.col("polarity") == "positive"
    target = F.when(known & ~plain, F.concat_ws(":", "polarity", "subject"))
    return {
        "importance": F.when(known, F.col("importance")), "level": F.col("proficiency"), "negated": known & ~F.coalesce(plain, F.lit(False)), "kind": F.col("kind"),
        "polarity_target": target, "section_heading": F.col("section_heading"), "modality": F.col("modality"),
    }


def claim_index(statements: DataFrame, mentions: DataFrame, facts: DataFrame, groups: DataFrame, references: DataFrame) -> DataFrame:
    """A row per claim: its area (a statement, or a fact that no statement claims), its source, place, envelope, quote, labels, values, links and routes.

    Within an area claims are ordered by claim_pos: the statement's own, then its mentions, then its facts, each in the record's order.
    A mention whose statement is unknown makes no claim; an object that cites nothing has a claim without a span."""
    return claims(objects(statements, mentions, facts, groups, references).repartition("doc_id"))


def profiles(claims: DataFrame) -> DataFrame:
    """Per document its areas in order, each with its claims in order: the index as one nested column."""
    claim = F.struct("claim_pos", "source", "owner_id", "quote", "start", "end", "importance", "level", "negated", "kind", "polarity_target", "values", "alternatives", "entity_links", "section_heading", "modality")
    area = claims.groupBy(*_AREA).agg(F.array_sort(F.collect_list(claim), lambda a, b: _ordered(a["claim_pos"], b["claim_pos"])).alias("claims"))
    row = F.struct("area_pos", F.col("area_id").alias("id"), F.col("area_name").alias("name"), F.col("area_kind").alias("kind"), F.col("area_importance").alias("importance"), F.col("area_level").alias("level"), "claims")
    return area.groupBy("doc_id").agg(F.array_sort(F.collect_list(row), lambda a, b: _ordered(a["area_pos"], b["area_pos"])).alias("areas"))


def _ordered(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
