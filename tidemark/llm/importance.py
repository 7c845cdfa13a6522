"""Importance resampling of documents towards a target distribution of hashed n-grams, by external sort and count.

1. `bucket_streams`: the features of every whole text (runs of one to three words, see gram_buckets) become packed unsigned 16-bit
   bucket numbers, written to the shared folder in blocks with the documents' offsets; a text is hashed once.
2. `bucket_counts`: each block's stream is sorted and run-length encoded; runs are merged within a partition and summed by bucket
   in Spark. The result has one row per bucket at most, whatever the corpus holds.
3. `gains`: the log ratio of target to corpus for each bucket, with add-one smoothing, as an integer in thousandths.
4. `weights`: a second pass over the streams (not the texts) gathers each feature's gain and adds them per document
   (np.add.reduceat at the documents' offsets).
5. `draw`: Gumbel noise from a hash of the key is added and the highest scores of the eligible documents are taken, which samples
   without replacement in proportion to exp(weight / 1000). Ranks come from a range sort: only counts per partition meet in the driver.

Memory per task is a block of a stream (about `BLOCK_BYTES` of text, or one text) and a table of bucket counts. Defined results: a null,
empty or wordless text has no features and weight 0; repeated rows are weighed and may be drawn each; a null key is hashed as
an empty one and sorts before others at equal scores; an empty corpus gives no rows, an empty target gives T = 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .gram_buckets import gram_buckets

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
BLOCK_BYTES = 4_000_000
_COUNTS = "bucket int, n long"


def bucket_streams(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The written streams, a row per block of documents: keys, n_words, ends (of each document in the stream), stream (little-endian uint16)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket number has 16 bits")
    kind = docs.schema[key].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for whole in batches for small in small_batches(whole, "_text", BLOCK_BYTES)):
            stream, bounds, n_words = gram_buckets(batch.column(1), buckets, longest)
            keys, ends = batch.column(0), bounds[1:].astype(np.int64)
            one = pa.array([0, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, pa.array(n_words.astype(np.int64))), pa.ListArray.from_arrays(one, pa.array(ends)),
                 pa.array([stream.astype("<u2").tobytes()], pa.binary())],
                names=["keys", "n_words", "ends", "stream"],
            )

    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return written(narrow.mapInArrow(body, f"keys array<{kind}>, n_words array<long>, ends array<long>, stream binary"), "bucket-streams")


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of the sorted stream."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def bucket_counts(streams: DataFrame) -> DataFrame:
    """bucket, n: how many features of all documents fall into each bucket (buckets without one are absent)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, np.int64)  # the runs met so far, merged
        for batch in batches:
            for packed in batch.column(0):
                values, lengths = runs(np.frombuffer(packed.as_buffer(), "<u2"))
                held[values] += lengths
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(held[found])], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(body, _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def _held_counts(counts: DataFrame, buckets: int) -> np.ndarray:
    found = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row per bucket
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, from two tables of bucket counts."""
    s, t = _held_counts(corpus, buckets), _held_counts(target, buckets)
    of_s, of_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(streams: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight of every document of the streams."""
    kind = streams.schema["keys"].dataType.elementType.simpleString()
    shared = streams.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n_words, ends = (batch.column(c)[i].values for c in range(3))
                each = gain[np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")]
                starts = np.append(0, ends.to_numpy()[:-1]) if len(ends) else np.zeros(0, np.int64)
                size = ends.to_numpy() - starts
                weight = np.zeros(len(ends), np.int64)
                if len(each):
                    weight[size > 0] = np.add.reduceat(each, starts[size > 0])
                yield pa.RecordBatch.from_arrays([keys, n_words, pa.array(size), pa.array(weight)], names=[key, "n_words", "n_features", "weight"])

    return streams.select("keys", "n_words", "ends", "stream").mapInArrow(body, f"`{key}` {kind}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, key: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: rank 1, 2, ... for the floor(share * N / 100) highest scores of the N rows of at least so many words, else null.

    Rows are range-partitioned by eligibility, score and key and written; a row's rank is its place in its partition and the counts before it."""
    spark = weighed.sparkSession
    text_key = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_key), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("_fits", F.col("n_words") >= least_words)
    order = [F.col("_fits").desc(), F.col("score").desc(), F.col(f"`{key}`").asc_nulls_first(), F.col("weight").desc(), F.col("n_words").desc()]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, "importance-order")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in placed.where("_fits").groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row per partition
    total, before, so_far = sum(n for _, n in sizes), [], 0
    for p, n in sizes:
        before.append((p, so_far))
        so_far += n
    told = spark.createDataFrame(before, "_part long, _before long")
    drawn = F.when(F.col("_fits") & (F.col("_before") + at < share * total // 100), F.col("_before") + at + 1)
    ranked = placed.withColumn("_part", part).join(F.broadcast(told), "_part", "left")
    return ranked.select(*[F.col(f"`{c}`") for c in weighed.columns], "score", drawn.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """key, n_words, n_features, weight, score, rank of every document of docs, drawn towards the n-grams of target."""
    streams = bucket_streams(docs, key, text, buckets, longest)
    goal = bucket_streams(target.select(F.lit(0).alias("_one"), target[target_text].alias("_goal")), "_one", "_goal", buckets, longest)
    return draw(weights(streams, gains(bucket_counts(streams), bucket_counts(goal), buckets), key), key, share, least_words, seed)
