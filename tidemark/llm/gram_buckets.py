"""Hash buckets of word n-grams, as numpy arrays over an Arrow batch of texts.

A feature is a run of one to `longest` consecutive words joined by one space; its bucket is the CRC-32 of its bytes modulo a count.
No feature's bytes are put together: the CRC of two strings one after the other follows from both CRCs and the second one's length
(moving a CRC past n bytes is linear over its bits, so a table lookup per byte of the CRC does it), and the CRC of a word is taken
once for each distinct word of the batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

_SPACE = 0x20
#: Lengths below this have a table of their own; what lies above is moved by powers of two.
_SHORT = 64


def _byte_table() -> np.ndarray:
    """What a byte becomes: A-Z lower case, any other ASCII byte but digits and letters a space, all others themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    ascii_ = np.arange(128)
    word = ((ascii_ >= ord("0")) & (ascii_ <= ord("9"))) | ((ascii_ >= ord("A")) & (ascii_ <= ord("Z"))) | ((ascii_ >= ord("a")) & (ascii_ <= ord("z")))
    table[:128][~word] = _SPACE
    return table


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """(a table for each length below _SHORT, a table for each power of two): 4 x 256 moved values each."""
    one = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[b] = c
    plain = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = [plain]
    for _ in range(_SHORT - 1):
        short.append((short[-1] >> np.uint32(8)) ^ one[short[-1] & np.uint32(255)])
    powers = [(plain >> np.uint32(8)) ^ one[plain & np.uint32(255)]]
    for _ in range(40):
        powers.append(_looked_up(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_BYTES = _byte_table()
_SHORTS, _POWERS = _shift_tables()
_FLAT = _SHORTS.reshape(-1)


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC as it enters the CRC of a string that is n bytes longer: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""
    base = (n % _SHORT).astype(np.int64) * 1024
    out = _FLAT[base + (crc & 255)] ^ _FLAT[base + 256 + (crc >> 8 & 255)] ^ _FLAT[base + 512 + (crc >> 16 & 255)] ^ _FLAT[base + 768 + (crc >> 24)]
    rest, k = n // _SHORT, _SHORT.bit_length() - 1
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _looked_up(_POWERS[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of an Arrow array of texts (null: none), dictionary-encoded as bytes, and where each text's begin (and the end)."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(offsets[0])
    raw = _BYTES[np.frombuffer(data, np.uint8)[first : int(offsets[-1])]] if data is not None else np.zeros(0, np.uint8)
    inside = raw != _SPACE
    opens = inside.copy()
    cuts = (offsets - first)[:-1]
    opens[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(raw)]
    opens[cuts] = inside[cuts]  # words end with their text
    starts = np.flatnonzero(opens)
    before = np.append(0, np.cumsum(inside))  # bytes of words before each place
    word_ends = np.append(before[starts], before[-1]).astype(np.int64)
    kept = raw[inside]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_ends.tobytes()), pa.py_buffer(kept.tobytes())])
    return found.dictionary_encode(), np.searchsorted(starts, offsets - first)


def gram_buckets(texts: pa.Array, buckets: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the buckets of all features, text by text; where each text's begin and the end; words of each text)."""
    coded, bounds = words(texts)
    distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(distinct))
    n = len(which)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words from here to the text's end
    grid = np.zeros((n, longest), np.uint16)
    held = np.zeros((n, longest), bool)
    own, own_spaced, own_size = crc[which], spaced[which], size[which]
    so_far = np.zeros(0, np.uint32)  # CRC of the first k words, each with a space behind it
    for k in range(longest):
        m = max(0, n - k)
        feature = own if k == 0 else moved(so_far[:m], own_size[k:]) ^ own[k:]
        grid[:m, k], held[:m, k] = feature[:m] % buckets, left[:m] > k
        if k + 1 < longest:
            so_far = own_spaced if k == 0 else moved(so_far[:m], own_size[k:] + 1) ^ own_spaced[k:]
    per_text = np.append(0, np.cumsum(held.sum(axis=1)))[bounds]
    return grid[held], per_text, np.diff(bounds)
