"""PCA whitening of embeddings: streaming Welford moments per partition, merged by the parallel formula, and a symmetric QR eigen-solve.

Entries become integers (floor(256 c)), so sums are exact. `fit` takes each distinct integer vector once (a copy that fills a third of the
rows is collapsed before the shuffle), writes that list, and folds every partition of it row by row: the mean moves by delta / n and
the scatter matrix takes one rank-one update. States (a matrix per partition) are merged in two levels, first in about the root of
their number of tasks, then in one, so only a single state ever reaches the driver, which solves for the components. A second pass over
the list measures the covariance of the whitened vectors in the same way. `whiten` applies the model row by row, without a shuffle.

Defined results: rows whose vector is null, or holds a null or non-finite entry, or an entry of 2^54 or more in size (whose integer would
not fit), have no result; of vectors of several lengths those of the length with most distinct vectors are whitened (the longer one at a
tie), others have no result; a component without variance (an eigenvalue of 0 up to rounding) has null as its whitened value
and is left out of identity_error; an empty table gives no rows. Repeated rows, null keys and further columns are allowed.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .symmetric_qr import eigen

SCALE, MOST_ENTRY = 256, 2.0**54
_STATE = "part long, size int, n long, sums array<decimal(38,0)>, mean array<double>, scatter binary"


@dataclasses.dataclass
class Whitening:
    """n fitted vectors with per-dimension sums; components as unit rows, by falling eigenvalue, and what they explain."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """The whitened values of rows of integers; NaN for a component without variance."""
        centred = x - np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))
        return centred @ self.components.T / scale

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """sum over dimensions of (n x - S)^2, exactly."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * max(1, len(self.sums)) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return (off * off).sum(axis=1).tolist()


class _Moments:
    """Count, exact sums, mean and scatter of vectors of one length."""

    def __init__(self, size: int):
        self.n, self.sums, self.mean, self.scatter = 0, [0] * size, np.zeros(size), np.zeros((size, size))

    def add(self, rows: np.ndarray) -> None:
        """Welford: one rank-one update per row."""
        if rows.dtype == np.int64:
            whole = rows if np.abs(rows).max(initial=0) * len(rows) < 1 << 62 else rows.astype(object)
            self.sums = [a + int(b) for a, b in zip(self.sums, whole.sum(axis=0))]
        update = np.empty_like(self.scatter)
        for x in rows.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            self.scatter += np.outer(delta, x - self.mean, out=update)

    def merge(self, other: _Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        delta = other.mean - self.mean
        self.scatter += other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


def _out(part: int, held: dict[int, _Moments]) -> pa.RecordBatch:
    found = sorted(held.items())
    columns = [
        pa.array([part] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.int32()), pa.array([m.n for _, m in found], pa.int64()),
        pa.array([[Decimal(s) for s in m.sums] for _, m in found], pa.list_(pa.decimal128(38, 0))), pa.array([m.mean.tolist() for _, m in found], pa.list_(pa.float64())),
        pa.array([m.scatter.tobytes() for _, m in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "size", "n", "sums", "mean", "scatter"])


def _read(row: dict) -> _Moments:
    m = _Moments(row["size"])
    m.n, m.sums, m.mean = row["n"], [int(s) for s in row["sums"]], np.array(row["mean"], np.float64)
    m.scatter = np.frombuffer(row["scatter"], np.float64).reshape(row["size"], row["size"]).copy()
    return m


def _merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, _Moments] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["size"] in held:
                held[row["size"]].merge(_read(row))
            else:
                held[row["size"]] = _read(row)
    if held:
        yield _out(TaskContext.get().partitionId(), held)


def _moments(rows: DataFrame, of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """The merged moments of all rows, one state per vector length. of: an Arrow list column -> matrices of rows of one length each."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Moments] = {}
        for batch in batches:
            for matrix in of(batch.column(0)):
                held.setdefault(matrix.shape[1], _Moments(matrix.shape[1])).add(matrix)
        if held:
            yield _out(TaskContext.get().partitionId(), held)

    groups = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    states = rows.mapInArrow(body, _STATE).withColumn("group", F.pmod("part", F.lit(groups)))
    first = states.repartition(groups, "group").sortWithinPartitions("part").drop("group").mapInArrow(_merge_states, _STATE)
    return first.repartition(1).sortWithinPartitions("part").mapInArrow(_merge_states, _STATE)


def _matrices(column: pa.Array, most: float = MOST_ENTRY) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of rows, their vectors) by vector length, of an Arrow list column, without the rows that have no result: those that are null or hold an entry that is null, not finite, or `most` or more in size."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~(np.abs(flat.astype(np.float64)) < most)))
    size = np.diff(offsets)
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for k in np.unique(size[good]).tolist():
        at = np.flatnonzero(good & (size == k))
        out.append((at, flat[offsets[at][:, None] + np.arange(k)]))
    return out


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64)


def _listed(rows: DataFrame, vector: str) -> DataFrame:
    """x: each distinct vector of integers once, as a written table."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, vectors in _matrices(batch.column(0)):
                x = _integers(vectors)
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["x"])

    return written(rows.select(rows[vector].cast("array<double>").alias("_vector")).mapInArrow(body, "x array<long>").distinct(), "whitening-list")


def fit(rows: DataFrame, components: int = 4, vector: str = "embedding") -> Whitening | None:
    """The whitening of all distinct vectors of rows, or None where there is none."""
    listed = _listed(rows, vector)
    most = _moments(listed, lambda c: [v for _, v in _matrices(c, math.inf)]).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return None
    m = _read(most[0].asDict())
    values, vectors = eigen(m.covariance())
    total, size = float(values.sum()), len(values)
    values = np.where(values > size * np.finfo(np.float64).eps * max(abs(values), default=0.0), values, 0.0)
    k = min(components, size)
    model = Whitening(m.n, m.sums, vectors[:k], values[:k], values[:k] / total if total > 0 else np.full(k, np.nan))
    model.identity_error = _identity_error(listed, model)
    return model


def _identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened list, minus the identity."""
    held, size = np.flatnonzero(model.eigenvalues > 0), len(model.sums)
    if not len(held):
        return None
    found = _moments(listed, lambda c: [model.projected(v)[:, held] for _, v in _matrices(c, math.inf) if v.shape[1] == size]).collect()
    return float(np.abs(_read(found[0].asDict()).covariance() - np.eye(len(held))).max())


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation (exact sum of squares of n x - S), whitened (an array: a value per component) of each row that has a result."""
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few components

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches if model is not None else ():
            for at, vectors in _matrices(batch.column(1)):
                if vectors.shape[1] != len(model.sums):
                    continue
                x = _integers(vectors)
                flat = model.projected(x).ravel()
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.components)), pa.array(flat, mask=np.isnan(flat)))
                off = model.deviations(x)
                exact = pa.array(off).cast(pa.decimal128(38, 0)) if isinstance(off, np.ndarray) else pa.array([Decimal(v) for v in off], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), exact, values], names=[key, "deviation", "whitened"])

    narrow = rows.select(rows[key].alias("_key"), rows[vector].cast("array<double>").alias("_vector"))
    return narrow.mapInArrow(body, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def by_component(whitened: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """A row per key and component: key, component (from 1), n, deviation (null where it does not fit a long), whitened, explained, identity_error."""
    told = [] if model is None else [None if math.isnan(e) else float(e) for e in model.explained]
    explained = F.array(*[F.lit(e).cast("double") for e in told]).cast("array<double>")
    return whitened.select(
        F.col(f"`{key}`"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"),
    ).select(
        F.col(f"`{key}`"), (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.try_element_at(explained, F.col("_at") + 1).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
