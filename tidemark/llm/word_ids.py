"""Token ids of a word-level BPE file of the tokenizers library, as unsigned 32-bit numbers.

The library's normaliser and pre-tokeniser never join characters across a blank or a line feed, so a text's ids are the
ids of its blank-separated chunks, one after another. The distinct chunks of a batch are found by Arrow and looked up, all at
once, in a bounded table of chunks that the Python worker has met; new chunks are cut into words the same way, and new words
go to the library's own model. The ids of the batch are then gathered by numpy. Chunks with characters outside Latin script
go through the library's whole pipeline.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The split pattern of the tokenizer file (checked against the file when it is loaded).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u024f]*")
_LINES = regex.compile(PIECES + r"|\n")
#: Strings up to so many bytes are kept.
_MOST_BYTES = 64


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every range, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class _Kept:
    """A table string -> ids of at most `most` rows; when it is full the half that was met last stays."""

    def __init__(self, most: int):
        self.most, self.clock = most, 0
        self.keys = pa.array([], pa.large_string())
        self.flat, self.start, self.size, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, keys: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys (distinct) -> (flat ids, start of each key's ids, their number). learn(new keys) gives (flat, sizes) of those not held."""
        self.clock += 1
        at = pc.index_in(keys, value_set=self.keys)
        fresh = at.is_null()
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        is_new = fresh.to_numpy(zero_copy_only=False)
        self.met[where[~is_new]] = self.clock
        start, size, flat = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.flat
        start[~is_new], size[~is_new] = self.start[where[~is_new]], self.size[where[~is_new]]
        if is_new.any():
            new = keys.filter(fresh)
            more, sizes = learn(new)
            begin = len(flat) + np.cumsum(sizes) - sizes
            flat = np.concatenate([flat, more])
            start[is_new], size[is_new] = begin, sizes
            self._keep(new, flat, begin, sizes)
        return flat, start, size

    def _keep(self, new: pa.Array, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(new), _MOST_BYTES)
        kept = short.to_numpy(zero_copy_only=False)
        keys = pa.concat_arrays([self.keys, new.filter(short)])
        start, size = np.append(self.start, begin[kept]), np.append(self.size, sizes[kept])
        met = np.append(self.met, np.full(int(kept.sum()), self.clock))
        if len(keys) > self.most:
            last = np.sort(np.argpartition(met, len(met) - self.most // 2)[len(met) - self.most // 2 :])
            keys, start, size, met = keys.take(pa.array(last)), start[last], size[last], met[last]
            flat = gathered(flat, start, size)
            start = np.cumsum(size) - size
        self.keys, self.flat, self.start, self.size, self.met = keys, flat, start, size, met


class WordIds:
    """Encodes batches of texts; most_kept chunks and as many words are kept at most, besides those of one batch."""

    def __init__(self, path: str, most_kept: int = 400_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        known = "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in self.library.pre_tokenizer.__getstate__().decode()
        self.plain = _PLAIN.fullmatch if known else lambda _: None
        self.words, self.chunks = _Kept(most_kept), _Kept(most_kept)

    def _is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and not any(s in text for s in self.special)

    def _new_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, of all plain ones by one pass of the pattern over their lines."""
        texts = chunks.to_pylist()
        joined = "".join(texts)
        if self.plain(joined) is not None and not any(s[0] in joined for s in self.special):
            return self._plain_ids(texts)
        plain = np.fromiter(map(self._is_plain, texts), bool, len(texts))
        flat, sizes = self._plain_ids([t for t, p in zip(texts, plain.tolist()) if p])
        own = [self.library.encode(t, add_special_tokens=False).ids for t, p in zip(texts, plain.tolist()) if not p]
        size = np.zeros(len(texts), np.int64)
        size[plain], size[~plain] = sizes, [len(x) for x in own]
        start = np.zeros(len(texts), np.int64)
        start[plain] = np.cumsum(sizes) - sizes
        start[~plain] = len(flat) + np.cumsum(size[~plain]) - size[~plain]
        flat = np.concatenate([flat, *[np.asarray(x, np.uint32) for x in own]])
        return gathered(flat, start, size), size

    def _plain_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.array(_LINES.findall(unicodedata.normalize("NFC", "\n".join(chunks)).lower()), pa.large_string()).dictionary_encode()
        which = pieces.indices.to_numpy()
        flat, start, size = self.words.ids(pieces.dictionary, self._new_words)
        start, size = start[which], size[which]
        ends = np.append(np.flatnonzero(which == pc.index(pieces.dictionary, "\n").as_py()) if len(chunks) > 1 else [], len(which)).astype(np.int64)
        before = np.append(0, np.cumsum(size))
        return gathered(flat, start, size), np.diff(np.append(0, before[ends]))

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By the library's model; the line feed between chunks is no word."""
        flat, sizes, tokenize = array("I"), [], self.tokenize
        found = [w if w != "\n" else "" for w in words.to_pylist()]
        for w in "\n".join(found).encode().decode("latin-1").translate(_WORD_LETTERS).split("\n"):
            ids = [t.id for t in tokenize(w)]
            flat.extend(ids)
            sizes.append(len(ids))
        return np.asarray(flat, np.uint32), np.array(sizes, np.int64)

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow array (null: none), as views of one array."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        flat, start, size = self.chunks.ids(coded.dictionary, self._new_chunks)
        which = coded.indices.to_numpy()
        n = size[which]
        ids = gathered(flat, start[which], n)
        bounds = np.append(0, np.cumsum(n))[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
_WORD_LETTERS = BYTE_LETTERS | {10: "\n"}  # the line feed, which parts words, stays


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder per Python worker, kept between its tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
