"""Passages that documents share, by sparse suffix arrays.

Suffixes are kept only at minimiser positions: the word position whose SEED-word hash is least in a window of seeds. A run of
SEED + WINDOW - 1 = 50 words always keeps one, the same one in every copy, so each repeated run of 50 words shows as
suffixes with equal seeds. Each kept suffix carries the hashes of the 50-word runs for which it is the minimiser: they
say how far two suffixes match to the left and to the right of the seed.

Suffixes are range-partitioned and sorted by seed and then by context, so equal ones lie side by side and a seed shared by very
many documents is spread over partitions. Neighbours with one seed are compared run by run, and matches are extended by joining
all matching runs of a document. Only a seed that lies across a partition's edge needs more: its runs that found no partner inside
are met by their hashes in a small aggregation. So the result is exact: every word that lies in a run of
50 words that another document also holds, and no other (up to collisions of 64-bit hashes).

Defined results: words are blank-separated and compared without case and punctuation; null, empty and short texts (under 50
words) hold no passage; rows that share a key are one document (its rows do not match each other); null keys are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .dart_minhash import mixed, word_hashes

SEED, WINDOW = 25, 26
LENGTH = SEED + WINDOW - 1
_BASE = 0x9E3779B97F4A7C15


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words, by prefix sums of words times powers (modulo 2^64)."""
    n = len(words)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = pow(_BASE, -1, 1 << 64)
    back = np.full(n + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    prefix = np.append(np.uint64(0), np.cumsum(words * powers[:n], dtype=np.uint64))
    return mixed((prefix[size:] - prefix[:-size]) * back[: n - size + 1])


def minimisers(seeds: np.ndarray) -> np.ndarray:
    """For each window of WINDOW seeds, the position of its least seed hash (the last of equals)."""
    n = len(seeds) - WINDOW + 1
    best, at, span = seeds.copy(), np.arange(len(seeds)), 1
    while span < WINDOW:  # doubling: the best of 2, 4, ... and at last WINDOW seeds
        step = min(span, WINDOW - span)
        left, right = best[: len(best) - step], best[step:]
        later = right <= left
        at = np.where(later, at[step:], at[: len(at) - step])
        best = np.minimum(left, right)
        span += step
    return at[:n]


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's mixed word hashes: kept positions, their seeds, first run, number of runs, and all run hashes."""
    seeds = rolled(words, SEED)
    at = minimisers(seeds)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[start], seeds[at[start]].view(np.int64), start, np.diff(np.append(start, len(at))), rolled(words, LENGTH)


def kept_suffixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_seed, _context, _key, _first (start of the first run), _lead (of the seed behind it), _runs (their hashes)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_text", 1_000_000):
                seeds, contexts, rows, firsts, leads, runs = [], [], [], [], [], []
                for i, t in enumerate(batch.column(1)):
                    words = word_hashes(t.as_py())
                    if len(words) < LENGTH:
                        continue
                    at, seed, first, n, hashes = suffixes(mixed(words))
                    seeds.append(seed)
                    firsts.append(first)
                    leads.append(at - first)
                    rows.append(np.full(len(at), i))
                    runs += [hashes[f : f + k].tobytes() for f, k in zip(first.tolist(), n.tolist())]
                    contexts.append(np.bitwise_xor.reduceat(mixed(hashes), first).view(np.int64))
                if runs:
                    arrays = [pa.array(np.concatenate(seeds)), pa.array(np.concatenate(contexts)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(leads).astype(np.int32)), pa.array(runs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["_seed", "_context", "_key", "_first", "_lead", "_runs"])

    narrow = docs.where(docs[key].isNotNull()).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return narrow.mapInArrow(body, f"_seed long, _context long, _key {docs.schema[key].dataType.simpleString()}, _first int, _lead int, _runs binary")


_OUT = ["_key", "_first", "_end", "_seed", "_run", "_low", "_high"]


def _compare(rows: pa.Table, edge: tuple[int, int] | None, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in seed order -> spans of runs that another document holds (with _end), and for seeds at the partition's edge the
    runs that are still open (with _run, and the least and largest key that holds it here)."""
    seed = rows.column(0).to_numpy()
    same = seed[1:] == seed[:-1]
    multiple = np.append(same, False) | np.append(False, same)
    if edge is not None:
        multiple |= (seed == edge[0]) | (seed == edge[1])
    if not multiple.any():
        return
    rows, seed = rows.filter(pa.array(multiple)), seed[multiple]
    keys, first, lead = (rows.column(c).to_numpy() for c in ("_key", "_first", "_lead"))
    hashes = rows.column("_runs").to_pylist()
    sizes = np.array([len(h) // 8 for h in hashes])
    runs = np.frombuffer(b"".join(hashes), np.uint64)
    row = np.repeat(np.arange(len(rows)), sizes)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(runs)) - start[row]
    offset = (lead[row] - place).astype(np.uint64)  # how far the run starts before the seed
    run = (mixed(seed.view(np.uint64)[row] + mixed(offset)) ^ (runs * np.uint64(_BASE))).view(np.int64)
    order = np.argsort(run, kind="stable")
    new = np.flatnonzero(np.append(True, run[order][1:] != run[order][:-1]))
    low, high = np.minimum.reduceat(keys[row][order], new), np.maximum.reduceat(keys[row][order], new)
    group = np.empty(len(run), np.int64)
    group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(run))))
    shared = (low != high)[group]
    if shared.any():
        at = np.flatnonzero(shared)
        begin = np.append(True, (np.diff(at) != 1) | (row[at][1:] != row[at][:-1]))
        left, right = at[begin], at[np.append(begin[1:], True)]
        k = row[left]
        yield _rows(key_type, keys[k], first[k] + place[left], first[k] + place[right] + LENGTH)
    if edge is not None:
        at_edge = np.isin(seed, list(edge))[row]
        left = np.flatnonzero(at_edge & ~shared)
        if len(left):
            begin = (first[row] + place)[left]
            yield _rows(key_type, keys[row][left], begin, begin + LENGTH, seed[row][left], run[left], low[group][left], high[group][left])
        held = np.unique(group[at_edge & shared])
        if len(held):  # what is closed here may be the partner of what is open elsewhere
            g = order[new[held]]
            yield _rows(key_type, low[held], np.full(len(held), -1), np.full(len(held), -1), seed[row][g], run[g], low[held], high[held])


def _rows(key_type, keys, first, end, seed=None, run=None, low=None, high=None) -> pa.RecordBatch:
    n = len(keys)
    arrays = [pa.array(keys, key_type), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))]
    arrays += [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (seed, run)]
    arrays += [pa.nulls(n, key_type) if x is None else pa.array(x, key_type) for x in (low, high)]
    return pa.RecordBatch.from_arrays(arrays, names=_OUT)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_word, end_word: the maximal spans of words that lie in 50-word runs which another document holds."""
    kind = docs.schema[key].dataType.simpleString()
    # context and key after the seed: a seed of very many suffixes is cut between partitions
    ordered = kept_suffixes(docs, key, text).repartitionByRange("_seed", "_context", "_key").sortWithinPartitions("_seed", "_context", "_key", "_first")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first_seed = None
        for batch in batches:
            seeds = batch.column(0).to_numpy()
            if first_seed is None:
                first_seed = int(seeds[0])
            held.append(batch)
            if seeds[0] != seeds[-1]:
                cut = int(np.searchsorted(seeds, seeds[-1]))
                table = pa.Table.from_batches(held[:-1] + [batch.slice(0, cut)])
                edge = (first_seed, first_seed) if int(table.column(0)[0].as_py()) == first_seed else None
                yield from _compare(table, edge, batch.schema.field(2).type)
                held = [batch.slice(cut)]
        if held:
            table = pa.Table.from_batches(held)
            yield from _compare(table, (first_seed, int(table.column(0)[-1].as_py())), held[0].schema.field(2).type)

    found = written(ordered.mapInArrow(neighbours, f"_key {kind}, _first int, _end int, _seed long, _run long, _low {kind}, _high {kind}"), "neighbours")
    open_runs = found.where(F.col("_run").isNotNull())
    met = open_runs.groupBy("_seed", "_run").agg(F.min("_low").alias("_l"), F.max("_high").alias("_h")).where("_l <> _h").select("_seed", "_run")
    closed = open_runs.where("_first >= 0").join(met, ["_seed", "_run"], "left_semi")
    spans = found.where(F.col("_run").isNull()).select("_key", "_first", "_end").unionByName(closed.select("_key", "_first", "_end"))
    return merged(spans).withColumnRenamed("_key", key)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one."""
    order = Window.partitionBy("_key").orderBy("_first", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("_new", (F.col("_first") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy("_key", "_island").agg(F.min("_first").alias("start_word"), F.max("_end").alias("end_word")).drop("_island")
