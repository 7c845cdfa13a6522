"""References of a record (block, quoted text, occurrence) to spans of the document.

A quote that its block holds is taken as it stands; else tiers follow, each of which must find exactly one place: the document and then the
block under the typographic fold; the document under typographic and case fold; the block and then the document without emphasis marks.
An offset that was found in a folded text is used as it is, so behind a letter that folding makes longer a span begins as much later. The lenient tier takes the first folded place.

Spark brings the references and the blocks of a document together in one row, as the text they come from was one. There each form of the blocks
is made once and laid end to end, and a tier looks for two places of a quote at most, so no rows are made for quotes and blocks that might meet."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binding import places, without_emphasis
from .texts import TYPOGRAPHIC

DOCUMENTS_AT_ONCE = 200
_BETWEEN = "\0"
_FOUND = {"block_id": "string", "start": "int", "end": "int", "occurrence": "int", "tier": "string", "error": "string", "text": "string"}


def _typographic(text: str) -> str:
    if not text.isascii():  # a replacement each is many times faster than a table for all
        for sign, plain in TYPOGRAPHIC.items():
            text = text.replace(sign, plain)
    return text


def _folded(text: str) -> str:
    return _typographic(text).casefold()


def _bare(text: str) -> str:
    return _folded(text.replace("*", "").replace("_", ""))


class _Form:
    """One form of all blocks of a document."""

    def __init__(self, texts: list[str], change: Callable[[str], str]):
        self.texts, self.change = [change(t) for t in texts], change
        self.starts = list(accumulate((len(t) + 1 for t in self.texts), initial=0))
        self.whole = _BETWEEN.join(self.texts)

    def hits(self, quote: str, own: int | None = None) -> list[tuple[int, int]]:
        """The first two places at most, as numbers of blocks and offsets in them; own: in this block only."""
        quote = self.change(quote)
        if not quote:
            return []
        if own is not None:
            return [(own, k) for k in _two(self.texts[own], quote)]
        if _BETWEEN in quote:  # it would meet the joints
            return [(b, k) for b, t in enumerate(self.texts) for k in _two(t, quote)][:2]
        at = [(bisect_right(self.starts, k) - 1, k) for k in _two(self.whole, quote)]
        return [(b, k - self.starts[b]) for b, k in at]


def _two(text: str, quote: str) -> list[int]:
    first = text.find(quote)
    second = text.find(quote, first + 1) if first >= 0 else -1
    return [k for k in (first, second) if k >= 0]


class _Document:
    def __init__(self, blocks: list[dict]):
        self.blocks = sorted(blocks, key=lambda b: (b["start"], b["block_id"]))
        self.number = {b["block_id"]: i for i, b in enumerate(self.blocks)}
        self.texts = [b["text"] for b in self.blocks]
        self.origins: dict[int, list[int]] = {}

    @cached_property
    def typographic(self) -> _Form:
        return _Form(self.texts, _typographic)

    @cached_property
    def folded(self) -> _Form:
        return _Form(self.texts, _folded)

    @cached_property
    def bare(self) -> _Form:
        return _Form(self.texts, _bare)

    def tiers(self, quote: str, own: int, lenient: bool) -> tuple[str, int, int, int] | None:
        """Tier, block and span in it."""
        size = len(quote)
        for tier, form, only in (("typographic", "typographic", None), ("own_typographic", "typographic", own), ("folded", "folded", None)):
            hits = getattr(self, form).hits(quote, only)
            if len(hits) == 1:
                return tier, hits[0][0], hits[0][1], hits[0][1] + size
        first = hits[0] if hits else None
        for tier, only in (("own_bare", own), ("bare", None)):
            hits = self.bare.hits(quote, only)
            if len(hits) == 1:
                block, k = hits[0]
                origin = self.origins.get(block) or self.origins.setdefault(block, without_emphasis(self.texts[block])[1])
                return tier, block, origin[k], origin[k + len(_bare(quote)) - 1] + 1
        return ("first_folded", first[0], first[1], first[1] + size) if lenient and first else None

    def resolve(self, cited: str | None, quote: str | None, k: int | None, lenient: bool) -> tuple:
        """block_id, start, end, occurrence, tier, error, text, and the block's `at`."""
        own = self.number.get(cited)
        wrong = lambda error: (cited, None, None, None, None, error, None, None)
        if own is None:
            return wrong("unknown_block")
        if (quote is None) != (k is None):
            return wrong("text_without_occurrence")
        if quote is None:
            return self._span(own, 0, len(self.texts[own]), 0, "own")
        hits = places(self.texts[own], quote)
        if hits:
            taken = k if 0 <= k < len(hits) else 0 if len(hits) == 1 else None
            return wrong("occurrence") if taken is None else self._span(own, hits[taken], hits[taken] + len(quote), taken, "own")
        if k != 0:
            return wrong("not_found")
        found = self.tiers(quote, own, lenient)
        return self._span(*found[1:], 0, found[0]) if found else wrong("not_found")

    def _span(self, block: int, a: int, b: int, occurrence: int, tier: str) -> tuple:
        at = self.blocks[block]["start"]
        return self.blocks[block]["block_id"], at + a, at + b, occurrence, tier, None, self.texts[block][a:b], self.blocks[block]["at"]


def resolved(references: DataFrame, blocks: DataFrame, lenient: bool | str = False, kept: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """references: doc_id, ref_id, block_id, quote, occurrence (both null: the whole block). Result: doc_id, ref_id, block_id, start, end, occurrence, tier, error, text (the cited one).

    lenient: whether the last tier is open, for all references or, as the name of a boolean column, for some. kept: more columns of the references, and told: of
    the blocks that they bind to, which the result has too; so neither is joined again. They pass through as they are, not as Python objects."""
    open_ = F.col(lenient) if isinstance(lenient, str) else F.lit(lenient)
    asked = references.groupBy("doc_id").agg(F.collect_list(F.struct("ref_id", "block_id", "quote", "occurrence", open_.alias("lenient"), *kept)).alias("refs"))
    held = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("block_id", "text", "start", *told)).alias("blocks"))
    kinds = [(n, of.schema[n].dataType.simpleString()) for of, names in ((references, ("doc_id", "ref_id", *kept)), (blocks, told)) for n in names]
    names = [*_FOUND, *(n for n, _ in kinds)]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                part = whole.slice(at, DOCUMENTS_AT_ONCE)
                owner, refs, held = pc.list_parent_indices(part["refs"]), pc.list_flatten(part["refs"]), pc.list_flatten(part["blocks"])
                texts = zip(*(pc.struct_field(held, [n]).to_pylist() for n in ("block_id", "text", "start")))
                each = ({"block_id": b, "text": t, "start": s, "at": k} for k, (b, t, s) in enumerate(texts))
                documents = [[next(each) for _ in range(n or 0)] for n in pc.list_value_length(part["blocks"]).to_pylist()]
                rows, last, document = [], None, None
                for d, *ref, easy in zip(owner.to_pylist(), *(pc.struct_field(refs, [n]).to_pylist() for n in ("block_id", "quote", "occurrence", "lenient"))):
                    if d != last:
                        last, document = d, _Document(documents[d])
                    rows.append(document.resolve(*ref, bool(easy)))
                if rows:
                    *found, block = zip(*rows)
                    bound = [pa.array(c, pa.int32() if t == "int" else pa.string()) for c, t in zip(found, _FOUND.values())]
                    own = [part["doc_id"].take(owner), *(pc.struct_field(refs, [n]) for n in ("ref_id", *kept))]
                    taken = pa.array(block, pa.int64())
                    yield pa.RecordBatch.from_arrays([*bound, *own, *(pc.struct_field(held, [n]).take(taken) for n in told)], names=names)

    # merged, not broadcast: what a broadcast would hold is text
    each = asked.join(held.hint("merge"), "doc_id", "left").select("doc_id", "refs", "blocks")
    return each.mapInArrow(body, ", ".join(f"`{n}` {t}" for n, t in [*_FOUND.items(), *kinds])).select("doc_id", "ref_id", *_FOUND, *kept, *told)
