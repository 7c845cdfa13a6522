"""Token ids of a byte-level BPE file of the tokenizers library, as unsigned 32-bit numbers.

A blank between two characters that are not white space always begins a pre-token, so a text whose blanks all stand so (or at its ends) is
cut before each blank, and its ids are those of the chunks, one after another. The distinct chunks of a batch are looked up, all at once, in
a bounded table of chunks that the Python worker has met; new ones are cut into pre-tokens by one pass of the pattern, which are looked up in a
second table, and new pre-tokens go to the library's model. Chunks with white space inside or special strings, and other texts, go to the
library whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .token_count import PATTERN, SPACE
from .word_ids import BYTE_LETTERS, _Kept, gathered

#: Cuts chunks apart; a text that holds it goes to the library whole.
_MARK = "\x00"
_WHITE = "[" + SPACE.encode().decode("unicode_escape") + "]"
_WHOLE = f"{_WHITE} | {_WHITE}|{_MARK}"
_PLAIN_CHUNK = f"^ ?[^{_WHITE[1:-1]}]+$"
_PIECES = regex.compile(PATTERN)


class ByteIds:
    """Encodes batches of texts; most_kept chunks are kept at most, besides those of one batch."""

    def __init__(self, path: str, most_kept: int = 400_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        told = self.library.pre_tokenizer.__getstate__().decode()
        self.cuts = '"ByteLevel"' in told and '"use_regex":true' in told and '"add_prefix_space":false' in told and self.library.normalizer is None
        special = self.library.get_added_tokens_decoder().values()
        self.cuts &= not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in special)
        self.special = "|".join(regex.escape(t.content) for t in special)
        self.tokenize = self.library.model.tokenize
        self.chunks, self.pieces = _Kept(most_kept), _Kept(most_kept)

    def _by_library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.library.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum())), size

    def _new_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(chunks, _PLAIN_CHUNK)
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(chunks, self.special))
        held = plain.to_numpy(zero_copy_only=False)
        size = np.zeros(len(chunks), np.int64)
        flat, size[held] = self._plain_ids(chunks.filter(plain).to_pylist())
        more, size[~held] = self._by_library(chunks.filter(pc.invert(plain)))
        start = np.zeros(len(chunks), np.int64)
        start[held] = np.cumsum(size[held]) - size[held]
        start[~held] = len(flat) + np.cumsum(size[~held]) - size[~held]
        return gathered(np.concatenate([flat, more]), start, size), size

    def _plain_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks without white space but a blank before them: a line feed between two is a pre-token of its own."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = pa.array(_PIECES.findall("\n".join(chunks)), pa.large_string()).dictionary_encode()
        which = found.indices.to_numpy()
        flat, start, size = self.pieces.ids(found.dictionary, self._new_pieces)
        start, size = start[which], size[which]
        parts = np.flatnonzero(which == pc.index(found.dictionary, "\n").as_py()) if len(chunks) > 1 else np.zeros(0, np.int64)
        size[parts] = 0
        before = np.append(0, np.cumsum(size))
        return gathered(flat, start, size), np.diff(np.concatenate([[0], before[parts], before[-1:]]))

    def _new_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes, tokenize = array("I"), [], self.tokenize
        for piece in pieces.to_pylist():
            ids = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))] if piece != "\n" else ()
            flat.extend(ids)
            sizes.append(len(ids))
        return np.asarray(flat, np.uint32), np.array(sizes, np.int64)

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow array (null: none)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for at, ids in ((np.flatnonzero(~whole), self._by_chunks), (np.flatnonzero(whole), self._each)):
            if len(at):
                for i, found in zip(at.tolist(), ids(texts.take(pa.array(at)))):
                    out[i] = found
        return out

    def _each(self, texts: pa.Array) -> list[np.ndarray]:
        return [self._by_library(texts.slice(i, 1))[0] for i in range(len(texts))]

    def _by_chunks(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, " ", _MARK + " "), _MARK)
        coded = lists.values.dictionary_encode()
        flat, start, size = self.chunks.ids(coded.dictionary, self._new_chunks)
        which = coded.indices.to_numpy()
        n = size[which]
        ids = gathered(flat, start[which], n)
        bounds = np.append(0, np.cumsum(n))[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_LOADED: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """One encoder per Python worker, kept between its tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteIds(path)
    return _LOADED[path]
