"""The corpus pipeline: each stage is one operator of tidemark.llm, written as Parquet and read again by the next.

STAGES lists (name, function(spark, docs, sf_dir)); run(spark, sf_dir) applies them to the table documents. All but the last return
the columns of documents. SQL cannot express toxicity, near duplicates, tokens or bins: tests/llm compares with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dart_minhash, decontaminate, line_spread, packing, toxicity
from tidemark.llm.common import drop_written, table, written, written_so_far


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents of the corpus."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from every document; n_chars follows the text. A line is boilerplate by the sites of documents that are no near copies
    of each other, so what is one document on many sites is not, and the next stage sees its copies as they are."""
    before = written_so_far()
    boilerplate = line_spread.spread_lines(docs, apart=True)
    drop_written(spark, before, keep="line-boilerplate-")
    cleaned = line_spread.remove_lines(docs, boilerplate)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(line_spread.REMOVED) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays: the one with the least id."""
    return dart_minhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way, and the documents before the last, are dropped when they are read for the last time."""
    docs, before = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs, here = written(stage(spark, docs, sf_dir), f"pipeline-{name}"), written_so_far()
        drop_written(spark, before, here - 1)
        before = here - 1
    return STAGES[-1][1](spark, docs, sf_dir)
