"""Token-ID output: documents as coded blocks in key order, and the way back.

Documents are range-partitioned and sorted by key (and by a hash of the text behind it, so that rows that share a key, or have
none, are spread over partitions); each partition writes one Parquet file whose rows are blocks in order.
A block row holds the coded ids (see id_coder), the keys and lengths of its documents (an Arrow stream, deflated), and where its
first id stands in its partition, so a reader needs only the number of ids of each partition to place any document. Files are
written by Spark's writer into the shared folder: a lost executor's file is written again, and every block is checked when it is read.

Defined results: keys may be of any type that can be sorted; a null or empty text is the end id alone; documents of equal keys lie
side by side in the order of their texts' hashes; null keys come first. A document is never cut between blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .id_coder import BlockError, decode, encode
from .word_ids import word_ids

BLOCK_IDS = 1 << 21
BATCH_BYTES = 8_000_000


def _packed(keys: list, kind: pa.DataType, lengths: list[int]) -> bytes:
    """Keys and lengths of a block's documents as a deflated Arrow stream."""
    rows = pa.record_batch([pa.array(keys, kind), pa.array(lengths, pa.int64())], names=["key", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return zlib.compress(sink.getvalue())


def _unpacked(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zlib.decompress(packed)).read_next_batch()


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """The written blocks: part, block, start (in the part), n_ids, documents (deflated keys and lengths), coded."""
    end = np.asarray([end_id], "<u4").tobytes()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = word_ids(tokenizer_path), TaskContext.get().partitionId()
        keys, parts, held, block, start, kind = [], [], 0, 0, 0, None

        def out() -> pa.RecordBatch:
            nonlocal keys, parts, held, block, start
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[part], [block], [start], [len(ids)], [len(keys)], [_packed(keys, kind, [len(p) // 4 for p in parts])], [encode(ids)]]
            keys, parts, held, block, start = [], [], 0, block + 1, start + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "start", "n_ids", "n_documents", "documents", "coded"])

        for batch in (small for whole in batches for small in small_batches(whole, "_text", BATCH_BYTES)):
            kind = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), own.encode_batch(batch.column(1))):
                ids = ids.astype("<u4").tobytes() + end
                keys.append(k)
                parts.append(ids)
                held += len(ids) // 4
                if held >= block_ids:
                    yield out()
        if keys:
            yield out()

    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"), F.xxhash64(docs[text].cast("string")).alias("_hash"))
    ordered = narrow.repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash").select("_key", "_text")
    return written(ordered.mapInArrow(body, "part int, block long, start long, n_ids long, n_documents long, documents binary, coded binary"), "token-ids")


def read_ids(blocks: DataFrame, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """From the files: key (of key_type, the type it was written with), start, n_tokens, ids_crc32 of each document."""
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each file
    before = dict(zip([p for p, _ in sizes], np.append(0, np.cumsum([n for _, n in sizes]))[:-1].tolist()))
    shared = blocks.sparkSession.sparkContext.broadcast(before)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, n, n_docs, documents, coded in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n_ids", "n_documents", "documents", "coded"))):
                ids, told = decode(coded), _unpacked(documents)
                lengths = told.column("length").to_numpy()
                if len(ids) != n or len(lengths) != n_docs or lengths.sum() != n:
                    raise BlockError("the documents' lengths do not add up to the block's ids")
                raw, at = memoryview(ids.tobytes()), np.append(0, np.cumsum(lengths))
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([told.column("key"), pa.array(shared.value[part] + start + at[:-1]), pa.array(lengths), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "start", "n_ids", "n_documents", "documents", "coded").mapInArrow(body, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")
