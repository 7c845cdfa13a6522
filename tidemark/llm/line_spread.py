"""Line dedup by distinct-site spread, in DataFrame functions only.

Every non-blank line is hashed; a HyperLogLog sketch of the sites it occurs on is built per line hash, map-side first, and
merged by aggregation. Lines whose estimate is clearly over the threshold are boilerplate; lines near it get an exact
distinct count (of those lines only). Boilerplate lines are then removed wherever they occur.

Every such line goes, whatever share of a document it is. A caller who does not want the lines of copies of one document to count as spread
says so when the lines are looked for (apart, in spread_lines); the lines are removed from all documents (remove_lines).

Defined results: a null text stays null with no lines, an empty text stays empty, blank lines are never removed, a null
site counts as no site. Repeated rows are each cleaned. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import written

#: Added columns; columns of the input that are so named are replaced, all others stay.
LINES, REMOVED = "__lines", "__removed"
MIN_SITES = 10
LG_K = 11
#: Lines whose estimate is within this share of the threshold are counted exactly: over four standard errors of the sketch.
NEAR = 0.1
#: So many boilerplate lines at most go into the plan as literals (160 kB); more are joined.
MOST_LITERALS = 20_000


def _hashes(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    lines = docs.select(*keep, F.explode(F.split(docs[text], "\n", -1)).alias("__line"))
    return lines.where(F.col("__line").rlike(r"\S")).select(*[c for c in lines.columns if c != "__line"], F.xxhash64("__line").alias("_hash"))


def _literals(hashes: DataFrame) -> str:
    return ", ".join(f"cast('{r[0]}' as bigint)" for r in hashes.collect())


def _holders(docs: DataFrame, hashes: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs that have a line of these hashes."""
    n = hashes.count()
    if not n:
        return docs.where("false")
    if n <= MOST_LITERALS:
        own = _free(docs, "__spread_lines")
        return docs.withColumn(own, F.split(docs[text], "\n", -1)).where(f"exists(`{own}`, x -> xxhash64(x) IN ({_literals(hashes)}))").drop(own)
    keys = _hashes(docs, text, docs[key].alias("_holds")).join(hashes, "_hash", "left_semi").select("_holds").distinct()
    return docs.join(keys, docs[key].eqNullSafe(keys["_holds"]), "left_semi")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text", key: str = "doc_id", apart: bool = False) -> DataFrame:
    """The hashes of lines that occur on at least min_sites distinct sites: a written table with the column _hash.

    apart: of near copies, among the documents that hold a line on so many sites, only the one of the least key counts. Copies can but take sites from a
    line, so only those documents are compared, and only such lines are counted again."""
    of_site = docs[site].cast("string").alias("_site")
    lines = _hashes(docs, text, of_site)
    judged = _judged(lines, min_sites)
    if apart:
        some = _holders(docs, judged.select("_hash"), key, text)
        copies = near_copies.copied_keys(some, key, text)
        held = _hashes(some, text, of_site, docs[key].alias("_key")).join(judged.select("_hash"), "_hash", "left_semi").distinct()
        lines = written(held.join(copies.toDF("_key"), "_key", "left_anti").select("_site", "_hash"), "line-sites")
        judged = _judged(lines, min_sites)
    near = judged.where(F.col("_sites") <= min_sites * (1 + NEAR)).select("_hash")
    exact = lines.join(near, "_hash", "left_semi").groupBy("_hash").agg(F.count_distinct("_site").alias("_sites")).where(F.col("_sites") >= min_sites)
    clear = judged.where(F.col("_sites") > min_sites * (1 + NEAR)).select("_hash")
    return written(clear.unionByName(exact.select("_hash")), "line-boilerplate")


def _judged(lines: DataFrame, min_sites: int) -> DataFrame:
    """_hash, _sites (an estimate) of the lines that are on or near the threshold, or over it: a written table."""
    sketches = lines.groupBy("_hash").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"))
    judged = sketches.select("_hash", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= min_sites * (1 - NEAR))
    return written(judged, "line-spread")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def remove_lines(docs: DataFrame, boilerplate: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cleaned, and LINES and REMOVED: how many lines it had and how many went."""
    n = boilerplate.count()
    own = [c for c in docs.columns if c not in (LINES, REMOVED)]
    of, hits, all_, kept = (_free(docs, f"__spread_{x}") for x in ("key", "hits", "all", "kept"))
    gone = lambda line: F.lit(False)
    cleaned = docs
    if n > MOST_LITERALS:
        found = _hashes(docs, text, docs[key].alias(of)).distinct().join(boilerplate, "_hash", "left_semi").groupBy(of).agg(F.collect_set("_hash").alias(hits))
        cleaned = docs.join(found, docs[key].eqNullSafe(found[of]), "left").drop(of)
        gone = lambda line: F.coalesce(F.array_contains(hits, F.xxhash64(line)), F.lit(False))
    elif n:
        bound = _literals(boilerplate)
    cleaned = cleaned.withColumn(all_, F.split(docs[text], "\n", -1))
    if 0 < n <= MOST_LITERALS:
        cleaned = cleaned.withColumn(kept, F.expr(f"filter(`{all_}`, x -> xxhash64(x) NOT IN ({bound}))"))
    else:
        cleaned = cleaned.withColumn(kept, F.filter(F.col(all_), lambda line: ~gone(line)))
    size = lambda c: F.when(F.col(text).isNull(), 0).otherwise(F.size(c))
    return cleaned.select(
        *[F.array_join(kept, "\n").alias(text) if c == text else F.col(f"`{c}`") for c in own],
        size(all_).cast("long").alias(LINES), (size(all_) - size(kept)).cast("long").alias(REMOVED),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    return remove_lines(docs, spread_lines(docs, min_sites, site, text), key, text)
