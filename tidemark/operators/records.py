"""The record contract: references, links, coverage, projection and eligibility, as joins and array expressions.

Tables: blocks (doc_id, block_id, text, start, end), references (doc_id, path, block_id, text, start, end), statements (doc_id,
statement_id, kind, ...), mentions (doc_id, mention_id, surface, kind, statement_ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribution_errors(references: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """References whose span does not hold their text, or lies outside their block.

    The document comes last: a text is shuffled once as itself, and never with each of its references."""
    placed = references.join(blocks.select("doc_id", "block_id", F.col("start").alias("_s"), F.col("end").alias("_e")), ["doc_id", "block_id"], "left")
    x = placed.join(documents.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    cited = F.substring("_doc", F.col("start") + 1, F.col("end") - F.col("start"))
    code = F.when(F.col("_s").isNull(), "unknown_block").when(~cited.eqNullSafe(F.col("text")), "text_mismatch").when((F.col("start") < F.col("_s")) | (F.col("end") > F.col("_e")), "outside_block")
    return x.withColumn("code", code).where("code is not null").select("doc_id", "path", "block_id", "code")


def duplicate_ids(objects: DataFrame, id_column: str) -> DataFrame:
    return objects.groupBy("doc_id", id_column).agg(F.count("*").alias("n")).where("n > 1")


def dangling_links(mentions: DataFrame, statements: DataFrame) -> DataFrame:
    """Per mention: the links that resolve, those that were dropped, and whether none is left."""
    each = mentions.select("doc_id", "mention_id", F.posexplode("statement_ids").alias("pos", "statement_id"))
    known = statements.select("doc_id", "statement_id", F.lit(True).alias("_live"))
    linked = each.join(known, ["doc_id", "statement_id"], "left")
    in_order = lambda live: F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("pos", "statement_id")))), lambda s: s["statement_id"])
    return linked.groupBy("doc_id", "mention_id").agg(in_order(F.col("_live").isNotNull()).alias("live"), in_order(F.col("_live").isNull()).alias("dropped")).withColumn("unknown_reference", F.size("live") == 0)


def unaccounted_blocks(blocks: DataFrame, accounting: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block_id").join(accounting.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")


def claims(mentions: DataFrame, statements: DataFrame) -> DataFrame:
    """A row for each mention and each statement it links to."""
    each = mentions.select("doc_id", "mention_id", "surface", F.col("kind").alias("mention_kind"), F.explode("statement_ids").alias("statement_id"))
    return each.join(statements, ["doc_id", "statement_id"])


def mention_index(projected: DataFrame, requirement: Column) -> DataFrame:
    return projected.where("mention_kind = 'skill'").select("doc_id", F.lower("surface").alias("mention"), F.col("kind").alias("area_kind"), requirement.alias("requirement")).distinct()


def digest(projected: DataFrame, most: int = 8) -> DataFrame:
    """Per document and area: its first mentions in name order, and how many are left out."""
    grouped = projected.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_set("surface")).alias("_all"))
    return grouped.select("doc_id", "kind", F.slice("_all", 1, most).alias("mentions"), F.greatest(F.size("_all") - most, F.lit(0)).alias("n_omitted"))


def presence(stated: Column, n_entries: Column) -> Column:
    """Entries make a family stated; stated without entries is unresolved."""
    return F.when(n_entries > 0, "stated").when(stated == "stated", "unresolved").otherwise(stated)


def authorization(sponsorship: Column, has_evidence: Column) -> Column:
    return F.when(sponsorship.isin("yes", "no") & has_evidence, sponsorship).otherwise("undeclared")


def search_eligible(q: dict[str, Column]) -> Column:
    """All conditions of the quality policy; null counts as not met."""
    found = F.lit(True)
    for c in q.values():
        found = found & F.coalesce(c, F.lit(False))
    return found


def group_depth(groups: DataFrame, most: int = 8) -> DataFrame:
    """Nested groups (doc_id, group_id, parent_id): depth of each, and -1 for those on a cycle or nested too deep."""
    level = groups.where("parent_id is null").select("doc_id", "group_id", F.lit(1).alias("depth"))
    out = level
    for depth in range(2, most + 1):
        level = groups.join(level.select("doc_id", F.col("group_id").alias("parent_id")), ["doc_id", "parent_id"]).select("doc_id", "group_id", F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return groups.select("doc_id", "group_id").join(out, ["doc_id", "group_id"], "left").select("doc_id", "group_id", F.coalesce("depth", F.lit(-1)).alias("depth"))
