"""Helpers shared by the corpus operators: table access, written intermediates and batched Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Folders of the intermediate tables of this driver, so that a job's caller can drop them.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); in local mode a folder of our own where that is unset."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tidemark-"))
    return "file://" + _OWN_DIR[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, cut from its lineage, and readable by every executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int, until: int | None = None, keep: str = "\0") -> None:
    """Deletes the intermediate tables written between two marks of written_so_far(), but for those whose tag starts with keep.

    Only for a caller who knows that nothing reads them any more."""
    jvm, until = spark.sparkContext._jvm, len(_WRITTEN) if until is None else until
    for k in range(since, until):
        path = _WRITTEN[k]
        if path and not path.rpartition("/")[2].startswith(keep):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _WRITTEN[k] = ""


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow body that handles one batch at a time, so memory is bounded by a batch; with text, by a few megabytes of that column or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, text) if text else (whole,):
                if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                    yield out

    return run


def small_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most about most_bytes of text each (one row at least), so long texts do not meet in memory.

    After each slice Arrow gives back what it freed; else a worker, which Spark keeps for the next task, holds the most it ever had."""
    start = size = 0
    for i, x in enumerate(batch.column(column)):
        n = len(x.as_buffer()) if x.is_valid else 0
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def coded_chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The blank-separated chunks of an Arrow array of texts (null: none): distinct chunks, each chunk's number, and where each text's begin (and end)."""
    lists = pc.utf8_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()


def parted(flat: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """Each text's part of flat, without the places that are not held."""
    before = np.append(0, np.cumsum(held))[offsets]
    kept = flat[held]
    return [kept[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
