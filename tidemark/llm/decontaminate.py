"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

The index holds, per term, postings in item order, cut into blocks of BLOCK items with the largest impact of each block.
Impacts are BM25 contributions divided by the item's score against itself, so one threshold holds for all items. Every
training document is cut into passages that overlap by the longest item of an index, so each copy of an item lies whole in
one passage; every passage is a query. Items are indexed by classes of length, so that a long item does not widen the
passages that short ones are sought in.

The search is exhaustive over all items at or over the threshold (no top-k), for a batch of passages at once and in three steps,
each of which skips what cannot reach the threshold. Pivots: the terms of an item are ranked by impact, and the weak ones, that
hold at most half of the threshold together, never make a candidate; only the postings of pivot terms are read for
every passage, and a passage goes on only if they, with all weak terms granted, reach the threshold for some item. Block bounds:
the block maxima of all terms of such a passage are added up, and blocks under the threshold are skipped. Scores: the postings of the
blocks that are left are added up. A hit stands if the passage holds enough of the item's question and of its answer, as
shingles of five words. An item that is one text has no real answer, so there a hit also stands if the passage holds enough of
the whole item's shingles; its impacts are raised so that no passage that does so stays under the threshold.

The index is broadcast, so its size is bounded: more than MOST_ITEM_BYTES of items are searched in shards, one pass each,
with term statistics over all items.

Defined results: null and empty documents and items match nothing; items of few words are matched as one shingle;
duplicate items each match; an item whose answer is null or empty is judged by its question alone. Rows are judged one by one,
so repeated rows and null keys are too. Where both tables' keys have one name, the item's is named item_<name> in the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_chunks, parted, small_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 64
PASSAGE = 128
MOST_ITEM_BYTES = 8_000_000
BATCH_BYTES = 3_000_000
#: Sums over (passage, item) are kept in a plain array up to this size, in sorted lists beyond.
MOST_SUMS = 4_000_000


def term(chunk: str) -> str:
    """Letters and digits of a blank-separated chunk, in lower case; empty for bare punctuation."""
    lowered = chunk.lower()
    return lowered if lowered.isalnum() else "".join(filter(str.isalnum, lowered))


def terms(text: str | None) -> list[str]:
    return [t for t in map(term, (text or "").split()) if t]


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer of a test item that is one text: its last sentence is the answer, or its last third if it is one sentence."""
    chunks = (text or "").split()
    ends = [i + 1 for i, c in enumerate(chunks[:-1]) if c[-1] in ".!?"]
    at = ends[-1] if ends else len(chunks) - len(chunks) // 3
    return terms(" ".join(chunks[:at])), terms(" ".join(chunks[at:]))


def most_lost(weights: list[float], missing: int) -> float:
    """The most weight that absent words can have where at most so many of the item's runs of SHINGLE words are absent."""
    size = min(SHINGLE, len(weights))
    best = np.full((size + 1, missing + 1), -np.inf)  # by words since the last absent one (size: none near) and runs lost
    best[size] = 0.0
    for i, w in enumerate(weights):
        after = np.empty_like(best)
        after[0] = best.max(axis=0) + w
        after[1:size] = best[: size - 1]
        after[size] = np.maximum(best[size - 1], best[size])
        if i >= size - 1:  # the run that ends here is lost with any word of it
            after[:size, 1:] = after[:size, :-1]
            after[:size, 0] = -np.inf
        best = after
    return float(best.max())


def shingles(words: list) -> set[tuple]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class Index:
    """items: (item id, question terms, answer terms), and True behind them for an item that is one text. frequency, n_items and mean_length are over all items of all shards."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], n_items: int, mean_length: float, numbers: dict[str, int] | None = None):
        self.item_ids = [i[0] for i in items]
        self.numbers = {} if numbers is None else numbers  # indexes of one shard share them
        self.parts, self.wholes, postings = [], [], []
        self.raised = np.ones(len(items))
        self.longest = 1
        for k, (_, question, answer, *one_text) in enumerate(items):
            words = question + answer
            self.longest = max(self.longest, len(words))
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            self.parts.append((shingles(ids[: len(question)]), shingles(ids[len(question) :])))
            norm = K1 * (1 - B + B * len(words) / mean_length)
            own = {t: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for (w, tf), t in ((x, self.numbers[x[0]]) for x in Counter(words).items())}
            total = sum(own.values())
            self.wholes.append(shingles(ids) if any(one_text) else None)
            if self.wholes[k]:
                missing = int((1 - OVERLAP) * len(self.wholes[k]) + 1e-9)
                missing += max(0, len(ids) - SHINGLE + 1 - len(self.wholes[k])) if missing else 0  # a run that occurs again is lost at all its places
                times = Counter(ids)
                weights = [own[t] / times[t] / total for t in ids]
                if sum(sorted(weights)[len(ids) - missing :]) > 1 - THRESHOLD:
                    self.raised[k] = max(1.0, THRESHOLD / max(1e-6, 1 - most_lost(weights, missing)))
                    total /= self.raised[k]
            postings += [(t, k, v / total) for t, v in own.items()]
        postings.sort()
        self.term = np.array([p[0] for p in postings], np.int64)
        self.item = np.array([p[1] for p in postings], np.int64)
        self.impact = np.array([p[2] for p in postings])
        self.n_blocks = len(items) // BLOCK + 1
        # one entry for each term and block: its postings' range and largest impact
        key = self.term * self.n_blocks + self.item // BLOCK
        self.key, self.at = np.unique(key, return_index=True)
        self.end = np.append(self.at[1:], len(key))
        self.block_max = np.maximum.reduceat(self.impact, self.at) if len(key) else np.zeros(0)
        self.first = np.searchsorted(self.key // self.n_blocks, np.arange(len(self.numbers) + 1))
        # an item's weak terms hold at most half of the threshold; the others are its pivots
        order = np.lexsort((self.impact, self.item))
        held = np.cumsum(self.impact[order])
        begin = np.searchsorted(self.item[order], np.arange(len(items)))
        before = np.append(0.0, held)[begin]
        is_weak = np.empty(len(order), bool)
        is_weak[order] = held - before[self.item[order]] <= THRESHOLD / 2
        self.weak = np.bincount(self.item[is_weak], self.impact[is_weak], len(items))
        self.pivot_item, self.pivot_impact = self.item[~is_weak], self.impact[~is_weak]
        self.pivot_first = np.searchsorted(self.term[~is_weak], np.arange(len(self.numbers) + 1))
        self.passage = max(PASSAGE, 2 * self.longest)
        self.stride = self.passage - self.longest + 1

    def search(self, query: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of a query number and a term of it: (query, item, score) of all items at or over the threshold."""
        n_terms = max(1, len(self.first) - 1)
        own = words < n_terms  # terms that only later indexes of the shard have are in none of these items
        going = self.reached(query[own], words[own])
        own &= going[query] if len(going) else False
        query, words = query[own], words[own]
        pairs = np.unique(query * n_terms + words)
        query, words = pairs // n_terms, pairs % n_terms
        own, entry = _ranges(self.first[words], self.first[words + 1])
        at = query[own] * self.n_blocks + self.key[entry] % self.n_blocks
        bounds = np.bincount(at, self.block_max[entry])
        live = bounds[at] >= THRESHOLD - 1e-9
        own, entry = own[live], entry[live]
        source, posting = _ranges(self.at[entry], self.end[entry])
        n = len(self.item_ids)
        at = query[own][source] * n + self.item[posting]
        found, where = np.unique(at, return_inverse=True)
        scores = np.bincount(where, self.impact[posting], len(found))
        hit = scores >= THRESHOLD - 1e-9
        return found[hit] // n, found[hit] % n, scores[hit]  # raised scores, where the item's are

    def reached(self, query: np.ndarray, words: np.ndarray) -> np.ndarray:
        """By query number: whether its pivot terms, with all weak ones granted, reach the threshold for some item. A term that occurs
        again counts again, so this is a bound."""
        going = np.zeros(int(query.max()) + 1 if len(query) else 0, bool)
        own, posting = _ranges(self.pivot_first[words], self.pivot_first[words + 1])
        n = len(self.item_ids)
        at = query[own] * n + self.pivot_item[posting]
        if len(going) * n <= MOST_SUMS:
            found, sums = np.arange(len(going) * n), np.bincount(at, self.pivot_impact[posting], len(going) * n)
        else:
            found, where = np.unique(at, return_inverse=True)
            sums = np.bincount(where, self.pivot_impact[posting], len(found))
        going[found[sums + self.weak[found % n] >= THRESHOLD - 1e-9] // n] = True
        return going


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each is of."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class _Terms(dict):
    """chunk -> its term's number, -1 for a term that no item has, -2 for bare punctuation."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, chunk: str) -> int:
        t = term(chunk)
        n = self.numbers.get(t, -1) if t else -2
        if len(self) >= 250_000:
            self.clear()
        self[chunk] = n
        return n


def numbered(known: _Terms, texts: pa.Array) -> list[np.ndarray]:
    """The term numbers of each text; -1 for words that no item has."""
    chunks, which, offsets = coded_chunks(texts)
    flat = np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks))[which]
    return parted(flat, offsets, flat != -2)


def _leaks(index: Index, ids: list[np.ndarray]) -> Iterator[tuple]:
    """Of documents as term numbers: (document number, item, score, question overlap, answer overlap, first word of the passage), the best passage of each pair."""
    sizes = np.array([len(x) for x in ids])
    n_passages = np.maximum(1, -(-(sizes - index.passage) // index.stride) + 1)
    first = np.cumsum(n_passages) - n_passages
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = flat >= 0
    doc, place, flat = doc[held], place[held], flat[held].astype(np.int64)
    last = np.minimum(place // index.stride, n_passages[doc] - 1)  # a word lies in this passage and in earlier ones that reach it
    queries, words, back = [], [], 0
    while True:
        k = last - back
        fits = (k >= 0) & (place < k * index.stride + index.passage)
        if not fits.any():
            break
        queries.append((first[doc] + k)[fits])
        words.append(flat[fits])
        back += 1
    if not queries:
        return
    query, item, score = index.search(np.concatenate(queries), np.concatenate(words))
    owner = np.searchsorted(first, query, "right") - 1
    best: dict[tuple[int, int], tuple] = {}
    for q, i, s, d in zip(query.tolist(), item.tolist(), score.tolist(), owner.tolist()):
        start = (q - int(first[d])) * index.stride
        s, whole = s / float(index.raised[i]), index.wholes[i]
        held = shingles_of(ids[d][start : start + index.passage].tolist(), (*index.parts[i], whole))
        asked, answered = (len(p & held) / len(p) if p else None for p in index.parts[i])
        both = s >= THRESHOLD - 1e-9 and all(x is None or x >= OVERLAP for x in (asked, answered)) and not (asked is None and answered is None)
        if both or (whole and len(whole & held) >= OVERLAP * len(whole) - 1e-9):
            if (d, i) not in best or best[d, i][2] < s:
                best[d, i] = (d, i, s, asked, answered, start)
    yield from best.values()


def shingles_of(words: list[int], parts: tuple[set | None, ...]) -> set[tuple]:
    """The passage's shingles, of the sizes that the item's parts have."""
    sizes = {len(next(iter(p))) for p in parts if p}
    return {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


class Shard:
    """Items in indexes by classes of length: up to PASSAGE / 2 words, and then for each doubling."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], n_items: int, mean_length: float):
        classes: dict[int, list[tuple]] = {}
        for i in items:
            classes.setdefault(max(PASSAGE // 2, 1 << (len(i[1]) + len(i[2]) - 1).bit_length()), []).append(i)
        self.numbers: dict[str, int] = {}
        self.indexes = [Index(classes[c], frequency, n_items, mean_length, self.numbers) for c in sorted(classes)]

    def leaks(self, ids: list[np.ndarray]) -> Iterator[tuple]:
        """(document number, item id, score, question overlap, answer overlap, first word of the passage)."""
        for index in self.indexes:
            for d, i, *rest in _leaks(index, ids):
                yield (d, index.item_ids[i], *rest)


def shards(items: DataFrame, key: str, question: str | None, answer: str | None, text: str | None) -> Iterator[Shard]:
    """Indexes over bounded parts of the items, with statistics over all of them."""
    rows = items.select(F.col(key), *[(F.lit(None) if c is None else F.col(c)).cast("string").alias(a) for c, a in ((question, "_q"), (answer, "_a"), (text, "_t"))])
    size = F.coalesce(F.length("_q"), F.lit(0)) + F.coalesce(F.length("_a"), F.lit(0)) + F.coalesce(F.length("_t"), F.lit(0))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // MOST_ITEM_BYTES))

    def cut(r) -> tuple:
        one_text = r["_t"] is not None
        q, a = split_item(r["_t"]) if one_text else (terms(r["_q"]), terms(r["_a"]))
        return r[key], q, a, one_text

    def parts(own: DataFrame) -> list[tuple]:
        return [c for c in map(cut, own.collect()) if c[1] or c[2]]

    if n == 1:
        found = parts(rows)
        if found:
            frequency = Counter(w for _, q, a, _ in found for w in {*q, *a})
            yield Shard(found, frequency, len(found), sum(len(q) + len(a) for _, q, a, _ in found) / len(found))
        return

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                _, q, a, _ = cut(r)
                if q or a:
                    out += [(w, 0) for w in {*q, *a}] + [("", len(q) + len(a))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64())], names=["w", "n"])

    counted = rows.mapInArrow(words, "w string, n long").groupBy("w").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    whole = counted.where("w = ''").first()
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("_q", "_a", "_t"), F.lit(n)) == k)
        found = parts(own)
        if found:
            vocabulary = own.mapInArrow(words, "w string, n long").select("w").distinct()
            yield Shard(found, {r["w"]: r["df"] for r in counted.join(vocabulary, "w", "left_semi").collect()}, whole["df"], whole["n"] / whole["df"])


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", question: str | None = None, answer: str | None = None, item_text: str | None = "text") -> DataFrame:
    """One row for each document and item that it holds: key, item_key, score, question_overlap, answer_overlap, passage_start (in words)."""
    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    own_name = item_key if item_key != key else f"item_{item_key}"
    schema = f"_key {kind}, _item {item_kind}, score double, question_overlap double, answer_overlap double, passage_start long"
    found = [_search_all(narrow, shard, schema) for shard in shards(items, item_key, question, answer, item_text)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], schema)
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnsRenamed({"_key": key, "_item": own_name})


def _held(shard: Shard, known: list[_Terms], batch: pa.RecordBatch, text: str) -> list[tuple]:
    if not known:
        known.append(_Terms(shard.numbers))
    return list(shard.leaks(numbered(known[0], batch.column(text))))


def _search_all(narrow: DataFrame, shard: Shard, schema: str) -> DataFrame:
    shared, known = narrow.sparkSession.sparkContext.broadcast(shard), []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_text", BATCH_BYTES):
                rows = _held(shared.value, known, batch, "_text")
                if rows:
                    keys = batch.column(0).take(pa.array([r[0] for r in rows]))
                    columns = [pa.array([r[j] for r in rows], t) for j, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows]), *columns], names=["_key", "_item", "score", "question_overlap", "answer_overlap", "passage_start"])

    return narrow.mapInArrow(body, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", question: str | None = None, answer: str | None = None, item_text: str | None = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item: each row is judged by its text, so null and repeated keys are too; no shuffle."""

    def without(rows: DataFrame, shard: Shard) -> DataFrame:
        shared, known = rows.sparkSession.sparkContext.broadcast(shard), []

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in small_batches(whole, text, BATCH_BYTES):
                    gone = np.zeros(batch.num_rows, bool)
                    gone[[r[0] for r in _held(shared.value, known, batch, text)]] = True
                    yield batch.filter(pa.array(~gone))

        return rows.mapInArrow(body, rows.schema)

    for shard in shards(items, item_key, question, answer, item_text):
        docs = without(docs, shard)
    return docs
