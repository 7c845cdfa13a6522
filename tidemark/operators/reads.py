"""Joins and aggregates of the read side, as plain DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """left with the first right row of each key by order (null where there is none): one aggregate, then a left join."""
    rest = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(key, "_f.*")
    return left.join(first, key, "left")


def unsatisfied(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return queue.join(done.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def flag_exists(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean: does other hold the key?"""
    keys = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_has", F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.col("_has").isNotNull()).drop("_has")


def next_number(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias(f"next_{column}"))


def distinct_by_first(df: DataFrame, keys: list[str], name: str, pos: str) -> DataFrame:
    """Distinct case-folded names; the first spelling wins."""
    return df.groupBy(*keys, F.lower(name).alias("folded")).agg(F.min_by(name, pos).alias(name))


def status_block(extractions: DataFrame, now: Column, since_days: int = 7) -> DataFrame:
    """Counts by status, distinct models of the last days, spend today and this month, and the oldest update."""
    at = F.col("updated_at")
    return extractions.agg(
        F.count_if(F.col("status") == "validated").alias("n_validated"), F.count_if(F.col("status") == "needs_review").alias("n_review"), F.count_if(F.col("status") == "quarantined").alias("n_quarantined"),
        F.count_distinct("document_hash").alias("n_documents"), F.count_distinct(F.when(at > now - F.make_dt_interval(F.lit(since_days)), F.col("model"))).alias("n_recent_models"),
        F.sum(F.when(F.to_date(at) == F.to_date(now), F.col("cost_cents")).otherwise(0)).alias("spend_today"),
        F.sum(F.when(F.date_trunc("month", at) == F.date_trunc("month", now), F.col("cost_cents")).otherwise(0)).alias("spend_month"), F.min("updated_at").alias("oldest_update"),
    )


def consolidation(extractions: DataFrame) -> DataFrame:
    """Per engine tuple: documents by status, mean agreement, how many agree poorly, and the latest fold."""
    return extractions.groupBy("model", "prompt_version").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "needs_review").alias("n_review"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") < 0.8).alias("n_poor"), F.max("updated_at").alias("folded_at"),
    )


def reasons_top(extractions: DataFrame, reasons: str, n: int) -> DataFrame:
    """The most frequent reasons; ties by name."""
    return extractions.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def document_frequency(mentions: DataFrame, key: str = "term", doc: str = "doc_id", least: int = 20) -> DataFrame:
    """mentions: distinct pairs of a term and a document, so a count that combines before the shuffle is enough."""
    return mentions.groupBy(key).agg(F.count(doc).alias("n_documents")).where(F.col("n_documents") >= least)


def vocabulary(emitted: DataFrame, seen: DataFrame, stop: list[str], least: int = 20, least_seen: int = 30, share: float = 0.4) -> DataFrame:
    """Terms that enough documents emit and, of the documents in which they are seen, a large enough share."""
    n = lambda df, name: df.groupBy("term").agg(F.count("*").alias(name))  # noqa: E731  pairs are distinct
    both = n(emitted, "n_emitted").join(n(seen, "n_seen"), "term").where(~F.col("term").isin(stop))
    return both.where((F.col("n_emitted") >= least) & (F.col("n_seen") >= least_seen) & (F.col("n_emitted") >= share * F.col("n_seen")))


def coverage_verdict(rows: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """A paged listing is complete if it holds a share of the first page's total."""
    return rows.groupBy(*keys).agg(F.count_distinct("uid").alias("n_listed"), F.min_by("total", "page").alias("total")).withColumn("complete", F.col("n_listed") >= share * F.col("total"))


def detail_budget(listed: DataFrame, history: DataFrame, now: Column, stale_days: int, budget: int) -> DataFrame:
    """Which details to fetch of each board: new uids in list order, then stale ones, oldest first, within a budget."""
    joined = listed.join(history, ["board", "uid"], "left")
    wanted = joined.where(F.col("last_at").isNull() | (F.col("last_at") < now - F.make_dt_interval(F.lit(stale_days))))
    order = Window.partitionBy("board").orderBy(F.col("last_at").isNotNull(), "last_at", "pos", "uid")
    return wanted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by the order of a seeded hash, every third one of a stratum for testing."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumn("split", F.when((F.col("rank") - 1) % 3 == 2, "test").otherwise("train"))


def set_jaccard(sets: DataFrame, group: str, item: str, values: str) -> DataFrame:
    """Jaccard of each pair of a group's samples (groups are small: the k samples of a document); empty against empty is 1."""
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    both, either = F.size(F.array_intersect(f"a.{values}", f"b.{values}")), F.size(F.array_union(f"a.{values}", f"b.{values}"))
    return pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{item}").alias("i"), F.col(f"b.{item}").alias("j"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def score_table(scores: DataFrame, split: str = "split") -> DataFrame:
    """Mean of each metric by split and over all; missing values do not count."""
    one = scores.groupBy("metric", split).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return one.unionByName(scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).withColumn(split, F.lit("all")))
