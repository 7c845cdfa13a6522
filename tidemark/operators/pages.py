"""Read-side operators: keyset pages, watermarks, cursors, latest rows and prefix lookup."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500


def clamp(limit: int, most: int = MOST_ROWS) -> int:
    return max(1, min(most, limit))


def keyset(order: list[tuple[str, bool]], after: dict) -> Column:
    """Rows strictly behind `after` in an order of (column, descending): a row-value comparison, for mixed directions too."""
    found, equal = F.lit(False), F.lit(True)
    for c, descending in order:
        past = F.col(c) < F.lit(after[c]) if descending else F.col(c) > F.lit(after[c])
        found, equal = found | (equal & past), equal & (F.col(c) == F.lit(after[c]))
    return found


@dataclass(frozen=True)
class Page:
    """rows: at most limit rows in order; `more` tells whether rows follow, `cursor` is the key of the last row shown."""

    rows: DataFrame
    order: list[tuple[str, bool]]
    limit: int
    probe: DataFrame

    def collect(self) -> tuple[list, bool, dict | None]:
        got = self.probe.collect()
        shown, more = got[: self.limit], len(got) > self.limit
        return shown, more, {c: shown[-1][c] for c, _ in self.order} if more else None


def page(df: DataFrame, order: list[tuple[str, bool]], after: dict | None = None, limit: int = 50) -> Page:
    """A bounded page; it plans as one top-k per partition and a small merge."""
    limit = clamp(limit)
    if after is not None:
        df = df.where(keyset(order, after))
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c, descending in order]
    return Page(df.orderBy(*by).limit(limit), order, limit, df.orderBy(*by).limit(limit + 1))


def after_watermark(df: DataFrame, at: str, key: str, watermark: dt.datetime, seen: list) -> DataFrame:
    """Rows later than the watermark, or at it and not seen yet; an empty list excludes none."""
    mark = F.lit(watermark).cast(df.schema[at].dataType)
    tie = F.col(at) == mark
    return df.where((F.col(at) > mark) | (tie & ~F.col(key).isin(seen) if seen else tie))


def advance(read: DataFrame, at: str, key: str) -> DataFrame:
    """One row: the last instant read and, in order, all keys at it."""
    keys = F.array_sort(F.max_by(F.col("_keys"), F.col(at)))
    return read.groupBy(at).agg(F.collect_list(key).alias("_keys")).agg(F.max(at).alias(at), keys.alias("ids"))


def merge_cursor(old: tuple | None, new: tuple) -> tuple:
    """Keys at one instant add up; a later instant replaces them; the cursor never moves back."""
    if old is None or new[0] > old[0]:
        return new
    return old if new[0] < old[0] else (old[0], sorted({*old[1], *new[1]}))


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns, as one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for alternatives of names with * and ? (comma-separated)."""
    one = lambda g: "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g.strip())
    return "^(?:" + "|".join(one(g) for g in glob.split(",") if g.strip()) + ")$"


def contains_ci(columns: list[str], text: str) -> Column:
    """Case-insensitive contains over columns; % and _ in the text are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(f"%{text}%")
    return found


def resolve_prefix(df: DataFrame, column: str, prefix: str) -> tuple[str, list]:
    """("found", [value]), ("missing", []) or ("ambiguous", up to ten values)."""
    if not re.fullmatch(r"[0-9a-f]{4,64}", prefix):
        raise ValueError("a prefix has 4 to 64 hex digits")
    got = [r[0] for r in df.where(F.col(column).startswith(prefix)).select(column).distinct().orderBy(column).limit(10).collect()]
    return ("missing", []) if not got else ("found", got) if len(got) == 1 else ("ambiguous", got)


def relative_window(text: str, now: dt.datetime) -> dt.datetime:
    """N minutes, hours or days before now: 30m, 6h, 7d."""
    m = re.fullmatch(r"(\d+)([mhd])", text)
    if not m:
        raise ValueError("expected a number and m, h or d")
    return now - dt.timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})


def fields(df: DataFrame, names: str) -> DataFrame:
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if unknown := [n for n in wanted if n not in df.columns]:
        raise ValueError(f"unknown fields {unknown}; there are {df.columns}")
    return df.select(*wanted)
