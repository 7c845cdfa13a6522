"""What a retry of an extraction dropped without being asked to.

Candidates are nested records as JSON, of any shape: the tracked lists are taken out of a VARIANT by path and flattened to rows of (doc_id, path,
index, id), so two records are compared as sets of rows. A record's own parts are never gathered: rows are matched by (doc_id, path, id). Spark takes the
flattened rows for no larger than the records' files, so the joins ask for a merge: as many rows as there are objects would not fit a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists of a record whose objects a retry may not lose.
TRACKED = ["statements", "relations.groups", "relations.conditions", "relations.example_sets", "facts.entries", "mentions"]


def tracked_objects(records: DataFrame, record: str = "record", paths: list[str] | None = None) -> DataFrame:
    """doc_id, path, index, id: the objects of the tracked lists that have a non-empty string as id. What is no list, or no JSON, has none."""
    value = F.try_parse_json(F.col(record))
    lists = F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get(value, f"$.{p}", "array<variant>").alias("items")) for p in paths or TRACKED])
    held = records.select("doc_id", F.explode(lists).alias("l")).select("doc_id", "l.path", F.posexplode("l.items").alias("index", "item"))
    of = F.try_variant_get("item", "$.id", "variant")
    is_text = F.schema_of_variant(of) == "STRING"
    return held.select("doc_id", "path", "index", F.when(is_text, F.try_variant_get("item", "$.id", "string")).alias("id")).where("id <> ''")


def _named(error: Column, token: Column) -> Column:
    """Whether the error names the token, not as a part of a longer name."""
    quoted = F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_like(error, F.concat(F.lit("(?<![0-9A-Za-z_-])"), quoted, F.lit("(?![0-9A-Za-z_-])")))


def unexplained_deletions(retries: DataFrame) -> DataFrame:
    """From retries (doc_id, prior, current, fed: the errors that the retry was told): doc_id, path, index, id of what went and no error named.

    An error names an object by its id or by its place in the prior record, in either spelling (`list[3]` or `list/3`)."""
    before = tracked_objects(retries, "prior")
    kept = tracked_objects(retries, "current").select("doc_id", "path", "id").distinct()
    gone = before.join(kept.hint("merge"), ["doc_id", "path", "id"], "left_anti").join(retries.select("doc_id", "fed").hint("merge"), "doc_id")
    place = F.col("index").cast("string")
    tokens = [F.col("id"), F.concat("path", F.lit("["), place, F.lit("]")), F.concat(F.translate("path", ".", "/"), F.lit("/"), place)]
    explained = F.exists(F.coalesce("fed", F.array().cast("array<string>")), lambda e: F.coalesce(_named(e, tokens[0]) | _named(e, tokens[1]) | _named(e, tokens[2]), F.lit(False)))
    return gone.where(~explained).select("doc_id", "path", "index", "id")
