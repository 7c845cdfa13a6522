"""Near copies of documents in DataFrame functions only, for steps that may run no Python on the executors.

A document is the set of its five-word shingles (a shorter one is one shingle), sorted by 64-bit hashes. The range of hashes is parted into COORDINATES
equal parts, and the least shingle of each part is its signature (one-permutation MinHash); signatures are banded. Equal sets are one node, so exact
copies never meet in a bucket, and each node is paired with the least and the greatest node of its buckets. Pairs are checked by the exact Jaccard similarity
of the whole sets; what passes is linked, and linked nodes form classes. Rows stay linear in documents, whatever the size of a bucket.

A link is lost if its texts meet in no bucket (0.04 % at similarity 0.8), or only where neither is the least or greatest, and nothing else links their
classes. Sets, not multisets as in dart_minhash: a shingle counts once however often a text has it. Documents without words or without a key are no copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS


def _shingled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _cells (sorted distinct shingles) and _node (their hash) of the rows that have a key and words. Words are letters and digits between blanks."""
    bare = F.regexp_replace(F.lower(docs[text].cast("string")), r"(?U)[^\p{L}\p{N}\s]+", "")
    words = F.transform(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = docs.where(docs[key].isNotNull()).select(docs[key].alias("_key"), words.alias("_w")).where("size(_w) > 0")
    run = lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, SHINGLE)])
    shingles = F.when(F.size("_w") < SHINGLE, F.array(F.xxhash64("_w"))).otherwise(F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(0))), run))
    cells = rows.select("_key", F.sort_array(F.array_distinct(shingles)).alias("_cells"))
    return cells.select("_key", "_cells", F.xxhash64("_cells").alias("_node"))


def _part(x: Column, n: int) -> Column:
    """Which of n equal parts of the 64-bit range x lies in; rises with x."""
    return F.floor(x * F.lit(n / 2.0**64))


def _buckets() -> Column:
    """The band hashes of _least, the first shingle of each part; a band whose parts are all empty has none."""
    of_band = lambda b: F.filter("_least", lambda x: _part(x, BANDS) == b)
    bands = F.transform(F.sequence(F.lit(-BANDS // 2), F.lit(BANDS // 2 - 1)), lambda b: F.struct(b.alias("b"), of_band(b).alias("x")))
    return F.transform(F.filter(bands, lambda s: F.size(s["x"]) > 0), lambda s: F.xxhash64(s["b"], s["x"]))


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _node, _size (shingles), _buckets."""
    first = F.filter("_cells", lambda x, i: (i == 0) | (_part(x, COORDINATES) != _part(F.get("_cells", i - 1), COORDINATES)))
    least = _shingled(docs, key, text).select("_key", "_node", F.size("_cells").alias("_size"), first.alias("_least"))
    return least.select("_key", "_node", "_size", _buckets().alias("_buckets"))


def pairs(nodes: DataFrame) -> DataFrame:
    """(_node, _size, _buckets) -> a, b: each node with the least and the greatest of its buckets, where their sizes let them be similar."""
    rows = nodes.select(F.struct("_node", "_size").alias("_x"), F.explode("_buckets").alias("_bucket"))
    ends = rows.groupBy("_bucket").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo._node <> _hi._node")
    met = rows.join(ends, "_bucket").select("_x", F.explode(F.array("_lo", "_hi")).alias("_y")).where("_x._node <> _y._node")
    met = met.where(F.least("_x._size", "_y._size") >= SIMILAR * F.greatest("_x._size", "_y._size"))
    return met.select(F.least("_x._node", "_y._node").alias("a"), F.greatest("_x._node", "_y._node").alias("b")).distinct()


def copied_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One column, key: the keys of all documents of each class of near copies but that of the least key."""
    rows = written(sketched(docs, key, text), "copy-sketches")
    nodes = written(rows.groupBy("_node").agg(F.min("_key").alias("_rep"), F.any_value("_size").alias("_size"), F.any_value("_buckets").alias("_buckets")), "copy-nodes")
    near = written(pairs(nodes.select("_node", "_size", "_buckets")), "copy-pairs")
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(nodes.select("_node", "_rep"), "_node"), "copy-wanted")
    texts = docs.join(wanted.select(F.col("_rep").alias("_want")).distinct(), docs[key] == F.col("_want"), "left_semi")
    cells = _shingled(texts, key, text).join(wanted.select("_node"), "_node", "left_semi")  # a key may stand on rows of other texts too
    cells = written(cells.groupBy("_node").agg(F.any_value("_cells").alias("_cells")), "copy-cells")
    both = near.join(cells.select(F.col("_node").alias("a"), F.col("_cells").alias("_of_a")), "a").join(cells.select(F.col("_node").alias("b"), F.col("_cells").alias("_of_b")), "b")
    shared = both.select("a", "b", F.size("_of_a").alias("_m"), F.size("_of_b").alias("_n"), F.size(F.array_intersect("_of_a", "_of_b")).alias("_both"))
    links = shared.where(F.col("_both") >= SIMILAR * (F.col("_m") + F.col("_n") - F.col("_both"))).select("a", "b")
    again = rows.groupBy("_key").agg(F.min("_node").alias("a"), F.max("_node").alias("b")).where("a <> b").select("a", "b")  # rows that share a key are one document
    found = components(links.unionByName(again))
    classed = nodes.select("_node", "_rep").join(found, F.col("_node") == F.col("node"), "left").select("_node", "_rep", F.coalesce("root", "_node").alias("_root"))
    best = classed.groupBy("_root").agg(F.min("_rep").alias("_best"))
    member = rows.select("_key", "_node").join(classed.join(best, "_root").select("_node", "_best"), "_node")
    return member.where("_key <> _best").select(F.col("_key").alias(key)).distinct()
