"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

A document's ids (with its end id) stay together unless they are more than a sequence holds; then they are cut into whole sequences,
the first piece being the shorter one. A piece of more than half a sequence opens one of its own. The other pieces are placed in
rounds of falling length, each of two supersteps over narrow rows (no ids are moved):

1. The round's pieces and all gaps they might use are range-sorted by size. Each partition is swept from the largest size down: a gap
   joins the open gaps, a piece takes the smallest open gap that holds it (its successor), and what is left of the gap is open again.
2. A partition's pieces that met no gap have their successors in partitions of larger sizes, and several partitions may want the
   same gaps. The conflict is settled by rank: the driver sees counts per partition only, and hands the unused gaps of the nearest larger
   partition down, smallest first, in the order of the partitions. Pieces and handed gaps are swept again; a piece that still
   meets no gap opens a sequence, whose gap is open to the pieces after it.

The gaps are then updated (a written table), and the next round begins. The number of rounds follows from the capacity alone.

Defined results: null and empty texts are documents of the end id alone; repeated rows are packed as often as they occur, null keys
like any others; extra columns are ignored; an empty table gives no rows. Memory per task: the open gaps of its own partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_ids import byte_ids
from .common import small_batches, written

CAPACITY, END_ID = 2048, 0
BATCH_BYTES = 4_000_000
#: Rounds halve the length; pieces of at most this share of a sequence share the last one.
LAST_ROUND = 32
#: Gaps are handed to a partition until they hold this many times the tokens it still has to place (or one gap per piece).
SUPPLY = 1.25
_WORKER_BITS, _ROUND_BITS = 36, 58
_STATE = ("is_piece", "size", "piece", "start", "ids_crc32", "sequence_id", "offset", "part", "rank")
_FIELDS = "is_piece boolean, size long, piece int, start long, ids_crc32 long, sequence_id long, offset long, part long, rank long"


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, in order."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def bounds(capacity: int) -> list[tuple[int, int]]:
    """(longest, shortest) piece of each round."""
    out, high = [], capacity // 2
    while high > capacity // LAST_ROUND:
        out.append((high, high // 2 + 1))
        high //= 2
    return [*out, (high, 1)] if high else out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written pieces: key, piece, start, length, ids_crc32, and a sequence_id for those of more than half a sequence."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, next_id = byte_ids(tokenizer_path), TaskContext.get().partitionId() << _WORKER_BITS
        for batch in (small for whole in batches for small in small_batches(whole, "_text", BATCH_BYTES)):
            rows: list[tuple] = []
            for i, ids in enumerate(own.encode_batch(batch.column(1))):
                raw, at = ids.astype("<u4").tobytes() + end, 0
                for k, length in enumerate(cut(len(raw) // 4, capacity)):
                    alone = 2 * length > capacity
                    rows.append((i, k, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), next_id if alone else None))
                    next_id, at = next_id + alone, at + length
            of, k, start, length, crc, sequence = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(k, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, sequence))],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id"],
            )

    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return written(narrow.mapInArrow(body, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long"), "best-fit-pieces")


class OpenGaps:
    """Sequences by the size of their gap; the smallest gap of at least a size is found in a bit set of sizes."""

    def __init__(self):
        self.held: dict[int, list[int]] = {}
        self.sizes = 0

    def add(self, size: int, sequence: int) -> None:
        if size:
            self.held.setdefault(size, []).append(sequence)
            self.sizes |= 1 << size

    def take(self, size: int) -> tuple[int, int] | None:
        """(gap, sequence) of the successor of size, which is no longer open."""
        above = self.sizes >> size
        if not above:
            return None
        gap = size + (above & -above).bit_length() - 1
        found = self.held[gap]
        sequence = found.pop()
        if not found:
            self.sizes ^= 1 << gap
        return gap, sequence

    def left(self) -> list[tuple[int, int]]:
        """(gap, sequence), from the smallest gap up."""
        return [(gap, s) for gap in sorted(self.held) for s in self.held[gap]]


def _sweep(batches: Iterator[pa.RecordBatch], key: str, capacity: int, new_ids: Iterator[int] | None) -> Iterator[pa.RecordBatch]:
    """Rows by part and falling size, gaps before pieces: pieces with their place, if they found one, and, behind each part, its open gaps.

    Without new_ids no sequence is opened, all rows are of this task's part, and gaps that any smaller piece could use are ranked."""
    gaps, part, least, kind = OpenGaps(), None, 0, None
    own = TaskContext.get().partitionId()

    def closed() -> pa.RecordBatch:
        left, n_small = gaps.left(), 0
        if new_ids is None:
            n_small = sum(g < least for g, _ in left)
        n, rank = len(left), [None] * n_small + list(range(len(left) - n_small))
        columns = [pa.array([False] * n, pa.bool_()), pa.array([g for g, _ in left], pa.int64()), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64())),
                   pa.array([s for _, s in left], pa.int64()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(rank if new_ids is None else [None] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), *columns], names=[key, *_STATE])

    for batch in batches:
        kind = batch.column(0).type
        rows = {c: batch.column(c).to_pylist() for c in ("is_piece", "size", "sequence_id", "part")}
        at, sequences, offsets, ended = [], [], [], []
        for i, (is_piece, size, sequence, of) in enumerate(zip(*rows.values())):
            of = own if new_ids is None else of
            if of != part:
                if part is not None:
                    ended.append(closed())
                gaps, part = OpenGaps(), of
            least = size
            if not is_piece:
                gaps.add(size, sequence)
                continue
            found = gaps.take(size)
            if found is None and new_ids is not None:
                found = capacity, next(new_ids)
            at.append(i)
            sequences.append(found and found[1])
            offsets.append(found and capacity - found[0])
            if found:
                gaps.add(found[0] - size, found[1])
        yield from ended
        if at:
            placed = batch.take(pa.array(at))
            columns = [placed.column(c) for c in ("is_piece", "size", "piece", "start", "ids_crc32")]
            columns += [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), pa.array([own] * len(at), pa.int64()) if new_ids is None else placed.column("part"), pa.nulls(len(at), pa.int64())]
            yield pa.RecordBatch.from_arrays([placed.column(0), *columns], names=[key, *_STATE])
    if part is not None:
        yield closed()


def hand_down(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """From (part, pieces left, their tokens, ranked gaps, their size) per partition, by falling size of what it holds: (giver, first rank, end rank, taker).

    A taker gets gaps of the nearest givers before it, the smallest first, until it has enough."""
    out, open_ = [], []
    for part, n_pieces, tokens, n_gaps, size in sorted(parts):
        needed = SUPPLY * tokens
        while n_pieces and needed > 0 and open_:
            giver, first, end, mean = open_.pop()
            take = min(end - first, n_pieces, -int(-needed // mean))
            out.append((giver, first, first + take, part))
            n_pieces, needed = n_pieces - take, needed - take * mean
            if first + take < end:
                open_.append((giver, first + take, end, mean))
        if n_gaps:
            open_.append((part, 0, n_gaps, size / n_gaps))
    return out


def _state(key: str, rows: DataFrame, of: Column, **told: Column) -> DataFrame:
    """rows with the columns of the state, null where they are not told."""
    kinds = dict(f.split() for f in _FIELDS.split(", "))
    return rows.select(of.alias(key), *[told.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _STATE])


def _round(number: int, todo: DataFrame, gaps: DataFrame, capacity: int, key: str) -> tuple[list[DataFrame], DataFrame]:
    """([rows of placed pieces], open gaps), from todo (pieces) and gaps (sequence_id, size)."""
    spark, kind = todo.sparkSession, todo.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, {_FIELDS}"
    of = F.col(f"`{key}`")
    of_pieces = _state(key, todo, of, is_piece=F.lit(True), size=F.col("length"), piece=F.col("piece"), start=F.col("start"), ids_crc32=F.col("ids_crc32"))
    of_gaps = _state(key, gaps, F.lit(None).cast(kind), is_piece=F.lit(False), size=F.col("size"), sequence_id=F.col("sequence_id"))
    tie = F.xxhash64(of, "piece", "start", "ids_crc32", "sequence_id")
    order = [F.col("size").desc(), F.col("is_piece"), F.col("_tie")]
    both = of_pieces.unionByName(of_gaps).withColumn("_tie", tie)
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    swept = written(ranged.mapInArrow(lambda b: _sweep(b, key, capacity, None), fields), "best-fit-sweep")

    left = F.col("is_piece") & F.col("sequence_id").isNull()
    ranked = F.col("rank").isNotNull()
    sizes = swept.groupBy("part").agg(*[F.coalesce(a, F.lit(0)) for a in (F.count_if(left), F.sum(F.when(left, F.col("size"))), F.count_if(ranked), F.sum(F.when(ranked, F.col("size"))))])
    parts = [tuple(r) for r in sizes.collect()]  # a row per partition
    placed = [swept.where("is_piece and sequence_id is not null")]
    if not any(p[1] for p in parts):
        return placed, swept.where("not is_piece")
    plan: dict[int, tuple[list[int], list[int]]] = {}
    for giver, first, end, taker in sorted(hand_down(parts)):
        ends, takers = plan.setdefault(giver, ([], []))
        ends.append(end)
        takers.append(taker)
    shared = spark.sparkContext.broadcast({g: (np.array(e), np.array(t)) for g, (e, t) in plan.items()})  # two rows per partition at most

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of a ranked gap becomes its taker's, or null if no one takes it; pieces stay in theirs."""
        plan = shared.value
        for batch in batches:
            part, rank = batch.column("part").to_numpy(), batch.column("rank").to_numpy(zero_copy_only=False)
            out, none = part.copy(), ~batch.column("is_piece").to_numpy(zero_copy_only=False)
            for giver in np.unique(part[none]).tolist():
                if giver in plan:
                    ends, takers = plan[giver]
                    at = np.flatnonzero(none & (part == giver) & (rank < ends[-1]))  # no rank is not less
                    out[at], none[at] = takers[np.searchsorted(ends, rank[at], side="right")], False
            at = batch.schema.get_field_index("part")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.int64(), mask=none))

    routed = written(swept.where(left | ~F.col("is_piece")).mapInArrow(handed, fields), "best-fit-handed")
    order = [F.col("part"), F.col("size").desc(), F.col("is_piece")]

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (number + 1 << _ROUND_BITS) + (TaskContext.get().partitionId() << _WORKER_BITS)
        return _sweep(batches, key, capacity, iter(range(first, first + (1 << _WORKER_BITS))))

    again = routed.where("part is not null").repartition("part").sortWithinPartitions(*order)
    opened = written(again.mapInArrow(opening, fields), "best-fit-opened")
    return [*placed, opened.where("is_piece")], routed.where("part is null").unionByName(opened.where("not is_piece"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = pieces(docs, tokenizer_path, end_id, capacity, key, text)
    names = [F.col(f"`{key}`"), "piece", "start", "length", "ids_crc32", "sequence_id"]
    placed = cut_up.where("sequence_id is not null").select(*names, F.lit(0).cast("long").alias("offset"))
    gaps = cut_up.where(F.col("sequence_id").isNotNull() & (F.col("length") < capacity)).select("sequence_id", (F.lit(capacity) - F.col("length")).alias("size"))
    rounds = bounds(capacity)
    open_ = cut_up.where("sequence_id is null")
    number_of = F.lit(len(rounds) - 1)
    for k, (_, low) in reversed(list(enumerate(rounds[:-1]))):
        number_of = F.when(F.col("length") >= low, k).otherwise(number_of)
    filled = {r[0] for r in open_.select(number_of).distinct().collect()}  # a row per round
    for k in sorted(filled):
        high, low = rounds[k]
        now, gaps = _round(k, open_.where(F.col("length").between(low, high)), gaps.where(F.col("size") >= low), capacity, key), gaps.where(F.col("size") < low)
        gaps = gaps.unionByName(now[1].select("sequence_id", "size"))
        for rows in now[0]:
            placed = placed.unionByName(rows.select(F.col(f"`{key}`"), "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset"))
    return placed
