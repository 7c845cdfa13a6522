"""Harmonic packing of tokenised documents into fixed-size sequences.

A document's ids (with its end id) are cut into pieces whose lengths fall into reciprocal-capacity classes: class j holds
lengths in (C/(j+1), C/j], and a bin of class j is filled with exactly j pieces. Whole sequences (class 1) are cut off first;
while the rest is longer than C/shortest_class, a piece of the class's exact length C//j is cut off, so its bins are full but for
rounding; the rest then is a piece of its own class. Each worker fills its bins on its own: there is no shuffle and no
shared state. What is left in open bins at the end of a worker's partition is laid end to end into further sequences,
cut where a sequence is full, and its tail is split at powers of two, which need no padding.

Defined results: null and empty texts are documents of the end id alone; repeated rows are packed as often as they occur;
extra columns are ignored. Memory per task: the lengths and checksums of its own pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .word_ids import word_ids

SHORTEST_CLASS = 16
BATCH_BYTES = 2_000_000
_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cuts(n: int, capacity: int, shortest_class: int = SHORTEST_CLASS) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of n tokens, in order."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest * shortest_class > capacity:
        j = -(-capacity // rest)
        out.append((j, capacity // j))
        rest -= capacity // j
    if rest:
        out.append((capacity // rest, rest))
    return out


def tail_sizes(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Bins:
    """The open bins of one worker. A piece is (row number of its document, start, length, crc)."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next_id, self.open = capacity, worker << 40, {}
        self.rows: list[tuple] = []

    def add(self, j: int, piece: tuple) -> None:
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            self.close(self.open.pop(j))

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, length, crc, total, _ in pieces:
            self.rows.append((doc, start, length, crc, total, self.next_id, at))
            at += length
        self.next_id += 1

    def finish(self) -> None:
        """The open bins' pieces, end to end."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity) + tail_sizes(total % self.capacity)
        todo = iter(left)
        doc = start = length = doc_total = 0
        ids = b""
        for size in sizes:
            held, room = [], size
            while room:
                if not length:
                    doc, start, length, _, doc_total, ids = next(todo)
                take = min(room, length)
                held.append((doc, start, take, zlib.crc32(ids[: 4 * take]), doc_total, b""))
                ids = ids[4 * take :]
                start, length, room = start + take, length - take, room - take
            self.close(held)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins = word_ids(tokenizer_path), _Bins(TaskContext.get().partitionId(), capacity)

        def out() -> pa.RecordBatch:
            columns = list(zip(*bins.rows))
            bins.rows = []
            arrays = [pa.array(columns[0], type=key_type)] + [pa.array(np.asarray(c, np.int64)) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *_FIELDS])

        key_type = None
        for batch in (small for whole in batches for small in small_batches(whole, "_text", BATCH_BYTES)):
            key_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode_batch(batch.column(1))):
                ids = ids.tobytes() + end
                total, at = len(ids) // 4, 0
                for j, length in cuts(total, capacity):
                    piece = ids[4 * at : 4 * (at + length)]
                    bins.add(j, (doc, at, length, zlib.crc32(piece), total, piece))
                    at += length
            if len(bins.rows) > 50_000:
                yield out()
        bins.finish()
        if bins.rows:
            yield out()

    narrow = docs.select(F.col(key), docs[text].cast("string").alias("_text"))
    return narrow.mapInArrow(body, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in _FIELDS))
