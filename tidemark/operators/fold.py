"""The state of extractions from two event streams, attempts and reviews, without a fold loop.

Order is (time, attempts before reviews, key). A retry review clears what came before it, so only events after the last retry count. What
is left has a closed form: the first deciding attempt gives the base state; a reject after it is final; else the last flag, refute or
accept decides, and only where the base was validated. One shuffle by key; windows over each key's own events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pages import glob_pattern

LADDER = 3


def fold_states(attempts: DataFrame, reviews: DataFrame, keys: list[str], accepted: str = "*") -> DataFrame:
    """keys, status, chosen, k (sample slots tried), human_review, cohort (accepted attempts that no review precedes).

    attempts: at, attempt_no, attempt_key, slot, model, outcome, exhausted. reviews: at, review_key, verb."""
    ok = (F.col("outcome") == "ok") & F.col("model").rlike(glob_pattern(accepted))
    a = attempts.select(
        *keys, "at", F.lit(0).alias("stream"), F.lpad(F.col("attempt_no").cast("string"), 8, "0").alias("order_key"), "attempt_key", "slot", F.lit(None).cast("string").alias("verb"),
        F.when(ok, "validated").when(F.col("outcome") == "over_budget", "quarantined").when(F.col("outcome").isin("schema_invalid", "attribution_failed") & (F.col("attempt_no") >= LADDER) & F.col("exhausted"), "quarantined").alias("decides"),
    )
    r = reviews.select(*keys, "at", F.lit(1).alias("stream"), F.col("review_key").alias("order_key"), F.lit(None).cast("string").alias("attempt_key"), F.lit(None).cast("int").alias("slot"), "verb", F.lit(None).cast("string").alias("decides"))
    order = Window.partitionBy(*keys).orderBy("at", "stream", "order_key")
    n = a.unionByName(r).withColumn("i", F.row_number().over(order))
    every = Window.partitionBy(*keys)
    live = n.withColumn("_retry", F.max(F.when(F.col("verb") == "retry", F.col("i"))).over(every)).withColumn("_old", F.coalesce(F.col("i") <= F.col("_retry"), F.lit(False)))
    base = F.min(F.when(F.col("decides").isNotNull() & ~F.col("_old"), F.struct("i", "decides", "attempt_key"))).over(every)
    live = live.withColumn("_base", base)
    verb = F.when(~F.col("_old") & (F.col("i") > F.col("_base.i")), F.col("verb"))
    live = live.withColumn("_verb", verb)
    live = live.withColumn("_ruled", F.min(F.when(F.col("_verb").isin("reject") | (F.col("_verb").isin("flag", "refute", "accept") & (F.col("_base.decides") == "validated")), F.col("i"))).over(every))
    flagged = F.col("_verb").isin("flag", "refute")
    last = F.max(F.when(flagged | (F.col("_verb") == "accept"), F.struct("i", "_verb")))
    first_flag, last_accept = F.min(F.when(flagged, F.col("i"))), F.max(F.when(F.col("_verb") == "accept", F.col("i")))
    got = live.groupBy(*keys).agg(
        F.any_value("_base").alias("base"), F.bool_or(F.col("_verb") == "reject").alias("rejected"), last.alias("last"), (last_accept > first_flag).alias("accepted"),
        F.count_distinct(F.when(~F.col("_old"), F.col("slot"))).alias("k"),
        F.array_sort(F.collect_list(F.when(~F.col("_old") & (F.col("decides") == "validated") & (F.col("_ruled").isNull() | (F.col("i") < F.col("_ruled"))), F.col("attempt_key")))).alias("cohort"),
    )
    status = F.when(F.col("rejected"), "rejected").when((F.col("base.decides") == "validated") & F.col("last._verb").isin("flag", "refute"), "needs_review").otherwise(F.col("base.decides"))
    review = F.when(F.col("rejected"), "rejected").when((F.col("base.decides") == "validated") & F.col("accepted"), "accepted").otherwise("none")
    return got.select(*keys, status.alias("status"), F.when(F.col("base.decides") == "validated", F.col("base.attempt_key")).alias("chosen"), F.greatest("k", F.lit(1)).cast("int").alias("k"), review.alias("human_review"), "cohort")


def settled(states: DataFrame, agreement: DataFrame, keys: list[str]) -> DataFrame:
    """States of cohorts of two or more samples under their agreement (passed, medoid_key, failures): a failed gate parks."""
    joined = states.join(agreement, keys, "left")
    decided = (F.size("cohort") > 0) & (F.col("k") >= 2) & F.col("passed").isNotNull() & (F.col("human_review") == "none") & (F.col("status") == "validated")
    return joined.select(*keys, F.when(decided & ~F.col("passed"), "needs_review").otherwise(F.col("status")).alias("status"), F.when(decided, F.col("medoid_key")).otherwise(F.col("chosen")).alias("chosen"), "k", "human_review")
