"""Agreement of the samples of one document: span alignment, F1, gates and medoid.

A document has a handful of samples, so each document's claims are gathered into one row, and many documents go to an Arrow batch."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JACCARD, F1 = 0.5, 0.8
GATED_KINDS = ("qualification", "employment_constraint", "compensation_statement")
DOCUMENTS_AT_ONCE = 500
_SCHEMA = "passed boolean, medoid_slot int, mean_f1 double, negation boolean, numeric_conflict boolean, n_samples int"
_JUDGED = pa.schema([("passed", pa.bool_()), ("medoid_slot", pa.int32()), ("mean_f1", pa.float64()), ("negation", pa.bool_()), ("numeric_conflict", pa.bool_()), ("n_samples", pa.int32())])


def jaccard(a: tuple[int, int], b: tuple[int, int]) -> float:
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    either = (a[1] - a[0]) + (b[1] - b[0]) - both
    return both / either if both else 0.0


def overlapping(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Pairs of spans that overlap, by a sweep over both in order of their starts; on each side only spans that still reach on are held."""
    spans, live = (a, b), ([], [])
    events = sorted((x[0], side, k) for side in (0, 1) for k, x in enumerate(spans[side]) if x[0] < x[1])
    for start, side, k in events:
        for s in (0, 1):
            while live[s] and live[s][0][0] <= start:
                heapq.heappop(live[s])
        for _, other in live[1 - side]:
            yield (k, other) if side == 0 else (other, k)
        heapq.heappush(live[side], (spans[side][k][1], k))


def aligned(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One-to-one pairs of spans that overlap enough, best first; ties by place."""
    ranked = sorted((-s, i, j) for i, j in overlapping(a, b) if (s := jaccard(a[i], b[j])) >= JACCARD)
    left, right, out = set(), set(), []
    for _, i, j in ranked:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


def _last_if_none(place: int | None) -> float:
    return math.inf if place is None or place != place else place


def _spans(claims: list[dict]) -> list[tuple[float, float]]:
    """A claim without a start or an end has an empty span, which meets nothing."""
    return [(a, b) if math.inf not in (a, b) else (0, 0) for a, b in ((_last_if_none(c["start"]), _last_if_none(c["end"])) for c in claims)]


def f1(hits: int, a: int, b: int) -> float:
    return 1.0 if a + b == 0 else 2 * hits / (a + b)


def misread(a: set[float], b: set[float]) -> bool:
    """Different numbers conflict unless one set leaves out some of the other's."""
    return bool(a and b) and not (a <= b or b <= a)


def judge(claims: pd.DataFrame | list[dict]) -> dict:
    """claims of one document: slot, start, end, kind, polarity, numbers."""
    rows = claims.to_dict("records") if isinstance(claims, pd.DataFrame) else claims
    samples: dict[int, list[dict]] = {}
    for c in sorted((c for c in rows if c["slot"] is not None), key=lambda c: (c["slot"], _last_if_none(c["start"]), _last_if_none(c["end"]))):
        samples.setdefault(int(c["slot"]), []).append(c)
    scores: dict[int, list[float]] = {s: [] for s in samples}
    negation = conflict = False
    for x, y in itertools.combinations(sorted(samples), 2):
        a, b = samples[x], samples[y]
        pairs = aligned(_spans(a), _spans(b))
        score = f1(len(pairs), len(a), len(b))
        scores[x].append(score)
        scores[y].append(score)
        for i, j in pairs:
            p, q = a[i], b[j]
            negation |= (p["polarity"] == "negative") != (q["polarity"] == "negative") and p["kind"] in GATED_KINDS
            conflict |= misread(set(p["numbers"]), set(q["numbers"]))
    means = {s: sum(v) / len(v) if v else 1.0 for s, v in scores.items()}
    medoid = min(means, key=lambda s: (-means[s], s))
    pairwise = [v for vs in scores.values() for v in vs]
    return {"passed": not negation and not conflict, "medoid_slot": medoid, "mean_f1": sum(pairwise) / len(pairwise) if pairwise else 1.0, "negation": negation, "numeric_conflict": conflict, "n_samples": len(samples)}


def agree(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    kind = claims.schema[key].dataType.simpleString()
    parts = ["slot", "start", "end", "kind", "polarity", "numbers"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                judged = pa.Table.from_pylist([judge(rows) for rows in batch.column(1).to_pylist()], _JUDGED)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(c.combine_chunks() for c in judged.columns)], names=[key, *_JUDGED.names])

    of = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("claims"))
    return of.mapInArrow(body, f"`{key}` {kind}, {_SCHEMA}")
