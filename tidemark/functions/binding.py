"""Binding of quotes to a document: from a block and a quoted text to a span, by tiers that go from exact to lenient.

A tier that finds several places does not choose: the next tier is asked, and the last, if allowed, takes the first place."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .texts import TYPOGRAPHIC

_FOLD = str.maketrans(TYPOGRAPHIC)
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("tier", StringType())])


def places(text: str, quote: str, start: int = 0, end: int | None = None) -> list[int]:
    """Starts of all occurrences in a part of the text, overlapping ones too."""
    out, at = [], text.find(quote, start, end) if quote else -1
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1, end)
    return out


def without_emphasis(text: str) -> tuple[str, list[int]]:
    """Case-folded text without * and _, and where each of its characters came from."""
    kept, origin = [], []
    for i, c in enumerate(text.translate(_FOLD)):
        if c not in "*_":
            folded = c.casefold()
            kept.append(folded)
            origin += [i] * len(folded)
    return "".join(kept), origin


@lru_cache(maxsize=4)  # a document's quotes come one after another
def _plain(document: str) -> str:
    return document.translate(_FOLD)


@lru_cache(maxsize=4)
def _bare(document: str) -> tuple[str, list[int]]:
    return without_emphasis(document)


def bind(document: str, block: tuple[int, int] | None, quote: str, lenient: bool = False) -> tuple[int, int, str] | None:
    folded = quote.translate(_FOLD)
    wanted, _ = without_emphasis(quote)

    def bare_places(a: int, b: int) -> list[tuple[int, int]]:
        bare, origin = _bare(document)
        return [(origin[k], origin[k + len(wanted) - 1] + 1) for k in places(bare, wanted) if a <= origin[k] and origin[k + len(wanted) - 1] < b]

    whole = (0, len(document))
    own = block or whole
    tiers = [
        ("block", lambda: [(k, k + len(quote)) for k in places(document, quote, *own)][:1] if block else []),
        ("document", lambda: [(k, k + len(quote)) for k in places(document, quote)]),
        ("block_typographic", lambda: [(k, k + len(quote)) for k in places(_plain(document), folded, *own)][:1] if block else []),
        ("document_typographic", lambda: [(k, k + len(quote)) for k in places(_plain(document), folded)]),
        ("block_emphasis", lambda: bare_places(*own)[:1] if block else []),
        ("document_emphasis", lambda: bare_places(*whole)),
    ]
    first = None
    for name, find in tiers:
        found = find()
        if len(found) == 1:
            return *found[0], name
        if found and first is None:
            first = (*found[0], "first_" + name)
    return first if lenient else None


def bound(document: Column, start: Column, end: Column, quote: Column, lenient: bool = False) -> Column:
    def run(docs: pd.Series, starts: pd.Series, ends: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        rows = [None if d is None or not q else bind(d, None if pd.isna(a) or pd.isna(b) else (int(a), int(b)), q, lenient) for d, a, b, q in zip(docs, starts, ends, quotes)]
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["start", "end", "tier"]).astype({"start": "Int32", "end": "Int32"})

    return F.pandas_udf(run, SPAN)(document, start, end, quote)


def first_difference(document: str, quote: str) -> tuple[int, int]:
    """The longest prefix of the quote that the document holds (by bisection), and where it stands."""
    low, high = 0, len(quote)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if quote[:middle] in document else (low, middle - 1)
    return low, document.find(quote[:low])
