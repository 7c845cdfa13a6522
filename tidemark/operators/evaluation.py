"""Comparison of two runs over the same documents, and choices among rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def interval(differences: np.ndarray, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean of paired differences."""
    if not len(differences):
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    n = np.asarray(differences, float)
    means = np.concatenate([n[rng.integers(0, len(n), (k, len(n)))].mean(axis=1) for k in [500] * (resamples // 500)])
    return float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))


def paired_bootstrap(scores: DataFrame, n_metrics: int = 17, resamples: int = 10_000) -> DataFrame:
    """scores: metric, split, doc_id, before, after (an answer key of some dozens of documents) -> mean change, interval, up, down or flat."""

    def body(g: pd.DataFrame) -> pd.DataFrame:
        d = (g["after"] - g["before"]).dropna().sort_index().to_numpy()
        low, high = interval(d, resamples, 0.05 / (2 * n_metrics))
        return pd.DataFrame([{"metric": g["metric"].iloc[0], "split": g["split"].iloc[0], "change": float(d.mean()) if len(d) else None, "low": low, "high": high, "verdict": "up" if low > 0 else "down" if high < 0 else "flat"}])

    return scores.groupBy("metric", "split").applyInPandas(body, "metric string, split string, change double, low double, high double, verdict string")


def profile_choice(extractions: DataFrame, current_prompt: str) -> DataFrame:
    """One extraction of each document: of the current prompt first, then validated, then the newest, then the greatest model.

    Rows that tie in all of this are told apart by their other columns, in order of name (the greatest wins), so the choice never depends on the order of rows."""
    rest = [c for c in extractions.columns if c != "document_hash"]
    told = sorted(c for c in rest if not isinstance(extractions.schema[c].dataType, (MapType, VariantType)))  # those that have an order
    rank = F.struct((F.col("prompt_version") == current_prompt).cast("int"), (F.col("status") == "validated").cast("int"), F.col("updated_at"), F.col("model"), *told)
    return extractions.groupBy("document_hash").agg(F.max_by(F.struct(*rest), rank).alias("_r")).select("document_hash", "_r.*", (F.col("_r.prompt_version") != current_prompt).alias("historical"))


def earliest_samples(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first good attempt of each sample slot."""
    return attempts.where("outcome = 'ok'").groupBy(*keys, "slot").agg(F.min_by("attempt_key", F.struct("at", "attempt_no")).alias("attempt_key"))
