"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens by the tokenizer file's pattern. Each distinct pre-token starts as its bytes in a doubly linked
list; a heap repeatedly gives the adjacent pair of lowest rank (leftmost first), the pair is merged and its two new
neighbour pairs enter the heap. The count is the number of initial symbols minus the number of merges: no ids are made.

Defined results: null and empty texts count 0 bytes and 0 tokens; special-token strings inside a text count as one
token each, as the library does by default. Rows are judged one by one, so repeated rows repeat.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .word_ids import BYTE_LETTERS

#: The library's white space and its byte-level split pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_RUN = regex.compile(rf"[{SPACE}][{SPACE}]")


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges."""
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[i], symbols[j] = a + b, ""
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class _Counts(dict):
    """pre-token or chunk -> tokens, bounded; two generations."""

    def __init__(self, count, most: int):
        super().__init__()
        self.count, self.most, self.old = count, most, {}

    def __missing__(self, key: str) -> int:
        n = self.old.get(key)
        if n is None:
            n = self.count(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = n
        return n


class TokenCounter:
    def __init__(self, path: str, most_kept: int = 300_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in told["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        split = told.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError("the file does not cut texts by the byte-level pattern alone")
        special = [t["content"] for t in told["added_tokens"]]
        self.begins = {t[0] for t in special}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.pieces = _Counts(self._piece, most_kept)
        self.chunks = _Counts(self._plain, most_kept)

    def _piece(self, piece: str) -> int:
        return merged_count([BYTE_LETTERS[b] for b in piece.encode()], self.ranks)

    def _plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _span(self, text: str) -> int:
        """No special strings. A blank starts the pre-token after it, unless white space meets white space."""
        if not text:
            return 0
        if _RUN.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        if rest and rest[-1] == "":  # a blank at the end stands alone
            return self._plain(text)
        return self.chunks[first] + sum(map(self.chunks.__getitem__, [" " + c for c in rest]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(c in text for c in self.begins) or not self.special.search(text):
            return self._span(text)
        return sum(map(self._span, self.special.split(text))) + len(self.special.findall(text))


_LOADED: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _LOADED:
        _LOADED[path] = TokenCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs. No shuffle; memory is a batch and the bounded caches."""
    kind = docs.schema[key].dataType

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = batch.column(1), counter(tokenizer_path)
        n = np.fromiter((own.count(t.as_py()) for t in texts), np.int64, len(texts))
        n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(key), _text(docs, text))
    return narrow.mapInArrow(arrow_map(body, "_text"), f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def _text(docs: DataFrame, text: str) -> Column:
    return docs[text].cast("string").alias("_text")
