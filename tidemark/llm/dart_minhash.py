"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (weight: how often each occurs). Every element owns a region:
its weight times a rank axis. Darts are thrown at the region by hashing: unit cell (element, copy) receives a Poisson
stream of darts whose ranks are sums of hashed exponential gaps, and each dart names a coordinate. Only darts of rank
up to (t ln t + 2 t) / weight are made, about as many for any document, and a coordinate keeps its earliest dart. Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.

A node is a distinct text (64 bits of a hash of its words). Signatures of the nodes are banded; in a bucket each node is linked to
the first leader it agrees with (or else becomes one, with a link to the nearest), in runs of RUN rows, so links are linear
in a bucket's size however large it is. Links are checked by the exact weighted Jaccard similarity of the whole texts, and linked nodes
form classes. That settles most rows but not all: a link may fail the check, and rows may be near that follow different
leaders. So a bucket that still holds several classes is searched again, exactly: its rows come in blocks with the cells of
their texts, every pair of blocks is one task row, the shared cells of all pairs of texts in it are counted by a product of incidence
matrices, and what leaves the task is at most one link for each class that it joins. So no rows are made for pairs, and a
large bucket is spread over tasks. A link is lost only if its texts meet in no bucket: with 20 bands of 5 rows a pair of
similarity 0.8 meets in one with probability 0.9996.

Defined results: a document without words (null, empty, only punctuation) is alone in its class; one of fewer than five
words is one shingle; class_id is the least key of the class; rows that share a key are one document, in one class whatever their
texts are; a row without a key has no class_id, but its text links others as any text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import coded_chunks, parted, small_batches, written
from .components import components
from .decontaminate import term

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
#: Signatures that agree less than this are not candidates (four standard errors under SIMILAR).
MAYBE = 0.64
#: Rows of a bucket are led in runs of at most so many.
RUN = 1024
#: Rows of a mixed bucket are compared in blocks of about so many rows and cells (8 bytes each) at most.
BLOCK_ROWS, BLOCK_CELLS = 256, 1_000_000
#: Pairs of blocks of one bucket are dealt to tasks in squares of so many blocks.
BLOCKS_AT_ONCE = 16
_COLUMNS = 4096  # of an incidence matrix at a time
#: A key list of this size at most (16 MB) is broadcast; longer ones are joined by shuffles.
MOST_BROADCAST_KEYS = 2_000_000

#: Words whose hashes a worker remembers (200 bytes each, about).
MOST_WORDS = 50_000
#: Leaders leave a task in batches of so many.
EMITTED = 20_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, chunk: str) -> int:
        t = term(chunk)
        h = xxhash.xxh64_intdigest(t) | 1 if t else 0
        if len(self) >= MOST_WORDS:
            self.clear()
        self[chunk] = h
        return h


_WORDS = _WordHashes()


def words_of_all(texts: pa.Array) -> list[np.ndarray]:
    """word_hashes of every text of an Arrow array."""
    chunks, which, offsets = coded_chunks(texts)
    flat = np.fromiter(map(_WORDS.__getitem__, chunks), np.uint64, len(chunks))[which]
    return parted(flat, offsets, flat != 0)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word; punctuation alone is no word."""
    chunks = text.split() if text else []
    out = np.fromiter(map(_WORDS.__getitem__, chunks), np.uint64, len(chunks))
    return out[out != 0]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    size = min(SHINGLE, n)
    h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = h * _GOLD + mixed(words[j : n - size + 1 + j])
    return mixed(h)


def copies(shingles: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each shingle of concatenated documents, how many equal ones of its document come before it."""
    order = np.argsort(shingles, kind="stable")  # documents stay in order among equal shingles
    s, d = shingles[order], doc[order]
    new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
    start = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return out


def signatures(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t 32-bit values for each multiset of shingles (none may be empty)."""
    out = np.empty((len(sets), t), np.uint32)
    todo, reach = np.arange(len(sets)), t * np.log(t) + 2 * t
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        flat, doc = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes)
        cell = mixed(flat + mixed(copies(flat, doc).astype(np.uint64)))
        limit = (reach / sizes)[doc]
        earliest = np.full(len(todo) * t, np.inf)
        rank, dart = np.zeros(len(flat)), 0
        while len(cell):
            dart += 1
            h = mixed(cell + np.uint64(dart * int(_GOLD) % (1 << 64)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank <= limit
            cell, rank, limit, doc, h = cell[live], rank[live], limit[live], doc[live], h[live]
            np.minimum.at(earliest, doc * t + (mixed(h) % np.uint64(t)).astype(np.int64), np.round(rank, 9))
        earliest = earliest.reshape(-1, t)
        full = np.isfinite(earliest).all(axis=1)
        out[todo[full]] = (mixed(earliest[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        todo, reach = todo[~full], reach * 2  # some coordinate met no dart: throw farther
    return out


def cells(words: np.ndarray) -> np.ndarray:
    """A text's unit cells in order: a hash for each shingle and copy of it, so that weighted sets are compared as sets."""
    h = shingle_hashes(words)
    return np.unique(mixed(h + mixed(copies(h, np.zeros(len(h), np.int8)).astype(np.uint64))))


def node_of(words: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes()))))


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _node, _size (shingles), _sig (32-bit signature values), for rows that have words."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_text", 4_000_000):
                words = words_of_all(batch.column(1))
                has = [i for i, w in enumerate(words) if len(w)]
                if has:
                    sets = [shingle_hashes(words[i]) for i in has]
                    columns = [pa.array([node_of(words[i]) for i in has], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), *columns], names=["_key", "_node", "_size", "_sig"])

    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return narrow.mapInArrow(body, f"_key {docs.schema[key].dataType.simpleString()}, _node long, _size long, _sig binary")


def _led(bucket: np.ndarray, keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows in bucket order -> which rows lead, and links (leader row, row)."""
    leads, links = np.ones(len(bucket), bool), []
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(bucket)))
    runs = -(-size // RUN)
    start = np.repeat(start, runs) + RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    size = np.diff(np.append(start, len(bucket)))
    pair = start[size == 2]
    agree = (sig[pair] == sig[pair + 1]).mean(axis=1) if len(pair) else np.zeros(0)
    links += [(p, p + 1) for p in pair[agree >= MAYBE]]
    leads[pair[agree >= SIMILAR] + 1] = False
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        rest = np.arange(s, s + n)
        nearest, best = np.zeros(n, np.int64), np.zeros(n)
        while len(rest):
            leader, rest = rest[0], rest[1:]
            if best[leader - s] >= MAYBE:
                links.append((int(nearest[leader - s]), int(leader)))
            if not len(rest):
                break
            agree = (sig[rest] == sig[leader]).mean(axis=1)
            follows = agree >= SIMILAR
            links += [(int(leader), int(r)) for r in rest[follows]]
            leads[rest[follows]] = False
            rest, agree = rest[~follows], agree[~follows]
            better = agree > best[rest - s]
            best[rest[better] - s], nearest[rest[better] - s] = agree[better], leader
    return leads, links


def _emit(bucket, nodes, sig, leads, links) -> Iterator[pa.RecordBatch]:
    """Leaders as rows with a signature, links as rows with a second node."""
    names = ["_bucket", "_node", "_other", "_sig"]
    all_ = np.flatnonzero(leads) if bucket is not None else np.empty(0, np.int64)
    for start in range(0, len(all_), EMITTED):
        at = all_[start : start + EMITTED]
        sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(at), [None, pa.py_buffer(np.ascontiguousarray(sig[at]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(nodes[at]), pa.nulls(len(at), pa.int64()), sigs], names=names)
    if links:
        a, b = np.array(links).T
        a, b = nodes[a], nodes[b]
        differ = a != b
        if differ.any():
            a, b = a[differ], b[differ]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=names)


def banded(full: np.ndarray) -> np.ndarray:
    """The BANDS buckets of each signature."""
    bucket = np.empty((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(full), b + 1, np.uint64)
        for r in range(ROWS):
            h = mixed(h * _GOLD + full[:, b * ROWS + r])
        bucket[:, b] = h
    return bucket.view(np.int64)


def candidates(reps: DataFrame) -> DataFrame:
    """(_node, _sig) -> candidate links (a, b), about one for each node and bucket at most."""

    def thrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                full = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                nodes, low = batch.column(0).to_numpy(), (full & 0xFF).astype(np.uint8)
                bucket, row = banded(full).ravel(), np.repeat(np.arange(len(full)), BANDS)
                order = np.lexsort((nodes[row], bucket))
                bucket, row = bucket[order], row[order]
                nodes, sig = nodes[row], low[row]
                leads, links = _led(bucket, nodes, sig)
                yield from _emit(bucket, nodes, sig, leads, links)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in bucket order; the last bucket of a batch waits for the next batch, unless it is long."""
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket = rows.column(0).to_numpy()
            multiple = np.append(bucket[1:] == bucket[:-1], False) | np.append(False, bucket[1:] == bucket[:-1])
            if multiple.any():
                rows, bucket = rows.filter(pa.array(multiple)), bucket[multiple]
                nodes = rows.column(1).to_numpy()
                sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                leads, links = _led(bucket, nodes, sig)
                for out in _emit(None, nodes, sig, leads, links):
                    yield out.select(["_node", "_other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held[:-1]) >= RUN:
                yield from done(pa.Table.from_batches(held))
                held = []
                continue
            last = batch.column(0)[-1].as_py()
            if batch.column(0)[0].as_py() != last:
                cut = int(np.searchsorted(batch.column(0).to_numpy(), last))
                yield from done(pa.Table.from_batches(held[:-1] + [batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from done(pa.Table.from_batches(held))

    local = written(reps.mapInArrow(thrown, "_bucket long, _node long, _other long, _sig binary"), "darts")
    leaders = local.where(F.col("_other").isNull()).select("_bucket", "_node", "_sig")
    spread = leaders.repartitionByRange("_bucket", "_node").sortWithinPartitions("_bucket", "_node")  # a large bucket lies in several partitions
    links = spread.mapInArrow(met, "_node long, _other long")
    links = links.unionByName(local.where(F.col("_other").isNotNull()).select("_node", "_other"))
    return links.select(F.least("_node", "_other").alias("a"), F.greatest("_node", "_other").alias("b")).distinct()


def cells_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """_node, _cells (see cells) of the wanted nodes (_node, _rep: a key with that text, null where no row with that text has a key)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_text", 4_000_000):
                nodes, found = [], []
                for want, words in zip(batch.column(0).to_pylist(), words_of_all(batch.column(1))):
                    if len(words) and want in (None, own := node_of(words)):  # a key may stand on rows of other texts too
                        nodes.append(own)
                        found.append(cells(words).tobytes())
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["_node", "_cells"])

    wanted = written(wanted, "wanted")
    few = wanted.count() <= MOST_BROADCAST_KEYS
    keyed = wanted.where(F.col("_rep").isNotNull())
    texts = docs.select(docs[key].alias("_rep"), docs[text].cast("string").alias("_text"))
    rows = texts.join(F.broadcast(keyed) if few else keyed, "_rep").select("_node", "_text")
    own = rows.mapInArrow(body, "_node long, _cells binary")
    if not wanted.where(F.col("_rep").isNull()).isEmpty():
        loose = texts.where(F.col("_rep").isNull()).select(F.lit(None).cast("long").alias("_node"), "_text").mapInArrow(body, "_node long, _cells binary")
        own = own.unionByName(loose.join(wanted.where(F.col("_rep").isNull()).select("_node"), "_node", "left_semi"))
    return own.groupBy("_node").agg(F.any_value("_cells").alias("_cells"))


def verified(links: DataFrame, cells_: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Links (a, b) whose texts have at least that similarity."""
    with_b = links.join(cells_.select(F.col("_node").alias("b"), F.col("_cells").alias("_of_b")), "b")
    pairs = with_b.join(cells_.select(F.col("_node").alias("a"), F.col("_cells").alias("_of_a")), "a").select("a", "b", "_of_a", "_of_b")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if min(len(x), len(y)) >= least * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both / (len(x) + len(y) - both) >= least:
                        keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return pairs.mapInArrow(body, "a long, b long").distinct()


def shared_cells(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many cells each of left shares with each of right."""
    n, sizes = len(left), np.array([len(x) for x in [*left, *right]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[times[column[order]] > 1]
    row, column = row[order], (np.cumsum(times > 1) - 1)[column[order]]
    out, held = np.zeros((n, len(right))), int(column[-1]) + 1 if len(column) else 0
    for at in range(0, held, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        incidence = np.zeros((len(sizes), min(_COLUMNS, held - at)), np.float32)
        incidence[row[a:b], column[a:b] - at] = 1
        out += incidence[:n] @ incidence[n:].T
    return out


def crossing(reps: DataFrame, classes: DataFrame, cells_for) -> DataFrame:
    """Links (a, b) between classes that hold texts of one bucket with at least SIMILAR.

    reps: _node, _rep, _size, _sig. classes: node, root, for nodes that are not their class's root. cells_for(nodes) gives their cells."""

    def thrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket = banded(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES))
                row = pa.array(np.repeat(np.arange(len(bucket)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *(batch.column(c).take(row) for c in range(3))], names=["_bucket", "_node", "_class", "_size"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in batch.to_pylist() for x in _joined(r["_left"], r["_right"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    own = reps.join(classes, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("root", "_node").alias("_class"), "_size", "_sig")
    rows = own.mapInArrow(thrown, "_bucket long, _node long, _class long, _size long")
    sizes = rows.groupBy("_bucket", "_class").agg(F.count("*").alias("n"), F.sum("_size").alias("c"))
    # of a bucket: its largest class, and rows and cells of that class and of all
    mixed_ = sizes.groupBy("_bucket").agg(F.max_by("_class", "n").alias("_main"), F.max("n").alias("_most"), F.max_by("c", "n").alias("_most_cells"), F.sum("n").alias("_all"), F.sum("c").alias("_all_cells")).where("_all > _most")
    mixed_ = written(mixed_, "mixed-buckets")
    # rows of the largest class meet the others only; both sides come in blocks
    held = rows.join(mixed_, "_bucket").withColumn("_other", F.col("_class") != F.col("_main"))
    parts = F.when(F.col("_other"), F.col("_others")).otherwise(F.col("_mains"))
    in_blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_CELLS))
    others = in_blocks(F.col("_all") - F.col("_most"), F.col("_all_cells") - F.col("_most_cells"))
    held = held.withColumns({"_others": others, "_mains": in_blocks(F.col("_most"), F.col("_most_cells"))})
    held = written(held.withColumn("_part", F.pmod(F.xxhash64("_node"), parts)).select("_bucket", "_node", "_class", "_other", "_part", "_others", "_mains"), "mixed-rows")
    held = held.join(cells_for(held.select("_node").distinct()), "_node")
    blocks = written(held.groupBy("_bucket", "_other", "_part").agg(F.min("_others").alias("_others"), F.min("_mains").alias("_mains"), F.collect_list(F.struct("_node", "_class", "_cells")).alias("_rows")), "bucket-blocks")
    return block_pairs(blocks).select("_left", "_right").mapInArrow(met, "a long, b long").distinct()


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Every pair of blocks of a bucket that have to meet, with their rows (_left, _right): blocks of other classes with each other and with the main class's.

    blocks: _bucket, _other, _part, _others and _mains (how many blocks of either kind the bucket has), _rows. Blocks are numbered through,
    the main class's last, and meet in squares of BLOCKS_AT_ONCE: a small bucket is one square and no block is copied; a large one is spread over
    tasks by squares, and a block is sent once per square of its row or column, not once per partner."""
    at = lambda n: F.floor(n / BLOCKS_AT_ONCE).cast("long")
    number = F.col("_part").cast("long") + F.when(F.col("_other"), 0).otherwise(F.col("_others"))
    left = blocks.where("_other").select("_bucket", at(number).alias("_row"), F.explode(F.sequence(at(number), at(F.col("_others") + F.col("_mains") - 1))).alias("_column"), number.alias("_p"), F.col("_rows").alias("_left"))
    right = blocks.select("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.least(at(number), at(F.col("_others") - 1)))).alias("_row"), at(number).alias("_column"), number.alias("_q"), F.col("_rows").alias("_right"))
    return left.join(right, ["_bucket", "_row", "_column"]).where("_p <= _q")


def _joined(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """Links that join the classes of two blocks as far as their texts do; none between classes that others of them join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    x, y = ([np.frombuffer(e["_cells"], np.uint64) for e in side] for side in (left, right))
    both = shared_cells(x, y)
    union = np.array([len(c) for c in x])[:, None] + np.array([len(c) for c in y]) - both
    out = []
    for i, j in np.argwhere(both / union >= SIMILAR).tolist():
        a, b = find(left[i]["_class"]), find(right[j]["_class"])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((left[i]["_class"], right[j]["_class"]))
    return out


def _classed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_key, _node) of the rows with words, and of every node its class: _node, _best (the class's least key), _first (its least node)."""
    sigs = written(signed(docs, key, text), "signatures")
    reps = written(sigs.groupBy("_node").agg(F.min("_key").alias("_rep"), F.any_value("_size").alias("_size"), F.any_value("_sig").alias("_sig")), "distinct-texts")
    cells_for = lambda nodes: cells_of(docs, key, text, reps.select("_node", "_rep").join(nodes, "_node", "left_semi"))
    links = written(candidates(reps.select("_node", "_sig")), "candidates")
    near = verified(links, written(cells_for(links.select(F.explode(F.array("a", "b")).alias("_node")).distinct()), "cells"))
    shared = sigs.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_node").alias("a"), F.max("_node").alias("_last")).where("a <> _last")
    one_key = sigs.join(shared.select("_key", "a"), "_key").select("a", F.col("_node").alias("b"))  # rows that share a key are one document
    found = components(near.unionByName(one_key))
    cross = written(crossing(reps, found, cells_for), "crossing")
    joined = reps.select("_node", "_rep").join(found, F.col("_node") == F.col("node"), "left").select("_node", "_rep", F.coalesce("root", "_node").alias("_root"))
    if not cross.isEmpty():
        more = components(cross)
        joined = joined.join(more, F.col("_root") == F.col("node"), "left").select("_node", "_rep", F.coalesce("root", "_root").alias("_root"))
    joined = written(joined, "classes")
    best = joined.groupBy("_root").agg(F.min("_rep").alias("_best"), F.min("_node").alias("_first"))
    return sigs.select("_key", "_node"), joined.join(best, "_root").select("_node", "_best", "_first")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key and class_id, the least key among its near duplicates."""
    sigs, classes = _classed(docs, key, text)
    member = sigs.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_node").alias("_node")).join(classes, "_node").select("_key", "_best")
    rows = docs.select(docs[key].alias("_own"))
    return rows.join(member, F.col("_own") == F.col("_key"), "left").select(F.col("_own").alias(key), F.coalesce("_best", "_own").alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns of docs: that of the least key, or where no row of the class has a key, of the least node.

    Rows that share a key are one document, so one of them stays (the longest text); rows without a key are judged by their texts; rows
    with neither key nor words all stay."""
    sigs, classes = _classed(docs, key, text)
    sigs = sigs.groupBy("_key").agg(F.min("_node").alias("_node")).where(F.col("_key").isNotNull())
    beaten = sigs.join(classes, "_node").where("_key <> _best").select(F.col("_key").alias("__near_key"))
    again = written(docs.groupBy(docs[key].alias("__near_again")).count().where("count > 1").select("__near_again"), "repeated-keys")
    rows = docs.join(beaten, docs[key] == beaten["__near_key"], "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(-F.length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), F.xxhash64(F.col(f"`{text}`")))
    picked = lambda grouped: grouped.agg(F.min_by(whole, order).alias("__near_row")).select("__near_row.*")
    if again.where(F.col("__near_again").isNotNull()).isEmpty():
        out = rows.where(rows[key].isNotNull())
    else:
        once = rows.where(rows[key].isNotNull()).join(again, rows[key] == again["__near_again"], "left_anti")
        out = once.unionByName(picked(rows.join(again, rows[key] == again["__near_again"], "left_semi").groupBy(f"`{key}`")))
    if again.where(F.col("__near_again").isNull()).isEmpty() and docs.where(docs[key].isNull()).isEmpty():
        return out

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, text, 4_000_000):
                nodes = [node_of(w) if len(w) else None for w in words_of_all(batch.column(text).cast(pa.string()))]
                yield batch.append_column("__near_node", pa.array(nodes, pa.int64()))

    loose = docs.where(docs[key].isNull()).mapInArrow(body, StructType([*docs.schema.fields, StructField("__near_node", LongType())]))
    firsts = classes.where(F.col("_best").isNull() & (F.col("_node") == F.col("_first"))).select(F.col("_node").alias("__near_first"))
    kept = loose.join(firsts, loose["__near_node"] == firsts["__near_first"], "left_semi")
    return out.unionByName(picked(kept.groupBy("__near_node"))).unionByName(loose.where(F.col("__near_node").isNull()).drop("__near_node"))
