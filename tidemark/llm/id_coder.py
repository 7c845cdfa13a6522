"""An adaptive context-mixing range coder for token ids.

Three orders predict every id: the id last seen after the same two ids (order 2), the id last seen after the same one (order 1),
and the adaptive frequencies of the ids that neither foretold (order 0). The two predicted ids carry a confidence that grows when
they come true and falls when they do not. For each pair of confidences, and whether both orders agree, the block learns
how often order 2, order 1 or neither was right: these are the weights by which the three predictions are mixed into one
distribution, and arithmetic coding spends it.

A block is coded on its own: it starts with the ids that occur in it (so any unsigned 32-bit id may), models start empty,
and checksums cover the coded bytes and the ids. Within a block consecutive stretches ("lanes") of the ids are coded side
by side as numpy vectors: they share the models, which are updated after each step, so a decoder that takes the same
steps holds the same models.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMIDS2\0\0"
_HEADER = struct.Struct("<8sIIIIIII")  # magic, ids, lanes, symbols, bytes of the alphabet, bytes of the lanes, checksums of the ids and of the coded bytes
LANES, LEAST_STEPS = 8192, 256
_MIX = 12  # bits of the mixing weights
_SLOTS = 1 << 18  # contexts of order 2, hashed
_TOP, _LEAST, _MASK = np.uint64(1 << 56), np.uint64(1 << 40), np.uint64((1 << 40) - 1)
_U16, _U40 = np.uint64(16), np.uint64(40)


class BlockError(ValueError):
    """A block that is damaged or not of this format."""


class _Models:
    """The state of all predictors; predict() and update() are the same steps for coder and decoder.

    A symbol's outcome is 0, 1 or 2: coded by order 0, 1 or 2. Its interval starts at base[outcome, context] + mult * cum[symbol]
    and is mult * wide[symbol] long; a symbol that order 1 or 2 foretold stands in cum and wide as the entry behind the last.
    """

    def __init__(self, lanes: int, symbols: int, decodes: bool):
        self.symbols, self.decodes = symbols, decodes
        self.bits = max(16, symbols.bit_length() + 3)  # of an order-0 share
        self.one, self.two = np.full(symbols, -8), np.full(_SLOTS, -8)  # symbol * 8 + confidence; -1 * 8 + 0: none yet
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts, self.recent, self.steps = np.zeros(symbols, np.int64), [], 0
        context = np.arange(128)
        self.agree, self.none2, self.none1 = (context & 1) == 1, context >> 4 == 0, (context >> 1) & 7 == 0
        self.met = np.array([[1.0], [0.3], [0.3]]) * np.ones((3, 128))  # outcomes by context
        self.rank()
        self.mix()

    def rank(self) -> None:
        """Order 0: shares of the symbols, out of 2^bits; every symbol has 1 at least."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.symbols + 1)[:-1]
            self.recent = []
        seen = np.cumsum(self.counts * 16 + 1)
        cum = np.zeros(self.symbols + 1, np.int64)
        cum[1:] = (seen.astype(np.float64) * (((1 << self.bits) - self.symbols) / float(seen[-1]))).astype(np.int64) + np.arange(1, self.symbols + 1)
        cum[-1] = 1 << self.bits
        wide = np.diff(cum)
        self.bounds, self.inverse = cum[:-1].astype(np.uint64), None
        cum[-1] = 0
        self.cum, self.wide = cum.astype(np.uint64), np.append(wide, 1 << self.bits).astype(np.uint64)
        if self.decodes and self.bits <= 18:
            self.inverse = np.repeat(np.arange(self.symbols), wide)

    def symbol_of(self, share: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, share, "right") - 1 if self.inverse is None else self.inverse[share.astype(np.int64)]

    def mix(self) -> None:
        """The weights of the orders in every context, out of 2^_MIX."""
        share = self.met / self.met.sum(axis=0) * (1 << _MIX)
        two = np.where(self.none2, 0, np.clip(share[2], 2, (1 << _MIX) - 128)).astype(np.int64)
        one = np.where(self.none1 | self.agree, 0, np.clip(share[1], 2, (1 << _MIX) - 64 - two)).astype(np.int64)
        self.mult = np.concatenate([(1 << _MIX) - two - one, one, two]).astype(np.uint64)
        self.base = np.concatenate([(two + one) << self.bits, two << self.bits, np.zeros(128, np.int64)]).astype(np.uint64)

    def predict(self) -> None:
        """The symbols that orders 2 and 1 expect in each lane (id2, id1), and the context of their weights."""
        self.slot = ((self.before * 40503 + self.last) * 2654435761 >> 13) & (_SLOTS - 1)
        self.was2, self.was1 = self.two[self.slot], self.one[self.last]
        self.id2, self.id1 = self.was2 >> 3, self.was1 >> 3
        self.level2, self.level1 = self.was2 & 7, self.was1 & 7
        self.context = (self.level2 << 4) + (self.level1 << 1) + (self.id1 == self.id2)

    def interval(self, is1: np.ndarray, is2: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the symbols' intervals; symbol: the entry in cum and wide."""
        self.outcome, self.coded = self.context + (is1 * 128 + is2 * 256), symbol
        mult = self.mult[self.outcome]
        return self.base[self.outcome] + mult * self.cum[symbol], mult * self.wide[symbol]

    def update(self, now: np.ndarray, is2: np.ndarray) -> None:
        fresh = (now << 3) | 1
        for table, at, was, level, right in ((self.two, self.slot, self.was2, self.level2, is2), (self.one, self.last, self.was1, self.level1, self.id1 == now)):
            kind = level + right * 8
            new = was + _CHANGE[kind]
            replaced = np.flatnonzero(kind < 2)
            new[replaced] = fresh[replaced]
            table[at] = new
        self.recent.append(self.coded)
        self.before, self.last = self.last, now
        self.steps += 1
        if self.steps & 3 == 0 or self.steps < 16:  # weights change every fourth step, tables at every step
            self.met = self.met * 0.995 + np.bincount(self.outcome, minlength=384).reshape(3, 128)
            self.mix()
        if self.steps & 7 == 0 or self.steps in (1, 2, 4):
            self.rank()


#: What a confidence changes by: wrong at levels 0 to 7 (halved; 0 and 1 are replaced), right at levels 0 to 7.
_CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0])


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's place among them."""
    if len(ids) and int(ids.max()) < 1 << 22:
        seen = np.zeros(int(ids.max()) + 1, bool)
        seen[ids] = True
        return np.flatnonzero(seen).astype("<u4"), (np.cumsum(seen) - 1)[ids]
    symbols, places = np.unique(ids, return_inverse=True)
    return symbols.astype("<u4"), places


def encode(ids: np.ndarray) -> bytes:
    """A block of the ids (unsigned 32-bit)."""
    n = len(ids)
    symbols, places = _alphabet(ids)
    lanes, steps = _lanes(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = places
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    width = 3 * steps + 8
    out, base, at = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width, np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 56) - 1, np.uint64)
    models = _Models(lanes, max(1, len(symbols)), False)
    shift = np.uint64(_MIX + models.bits)
    for step in range(steps if n else 0):
        now = grid[step]
        models.predict()
        is2 = models.id2 == now
        is1 = (models.id1 == now) & ~is2
        start, wide = models.interval(is1, is2, np.where(is1 | is2, models.symbols, now))
        unit = span >> shift
        low += unit * start
        span = unit * wide
        over = np.flatnonzero(low >= _TOP)
        if len(over):  # a carry into words that are out
            low[over] -= _TOP
            back = base[over] + at[over] - 1
            while len(back):
                out[back] += np.uint16(1)
                back = back[out[back] == 0] - 1
        short = np.flatnonzero(span < _LEAST)
        while len(short):
            own = low[short]
            out[base[short] + at[short]] = own >> _U40
            at[short] += 1
            low[short] = (own & _MASK) << _U16
            grown = span[short] << _U16
            span[short] = grown
            short = short[grown < _LEAST]
        models.update(now, is2)
    for bits in (40, 24, 8):
        out[base + at] = (low >> np.uint64(bits)) & np.uint64(0xFFFF)
        at += 1
    out[base + at] = (low & np.uint64(0xFF)) << np.uint64(8)
    at += 1
    kept = out.reshape(lanes, width)[np.arange(width) < at[:, None]].astype("<u2").tobytes()
    known = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes())
    body = known + at.astype("<u4").tobytes() + kept
    return _HEADER.pack(MAGIC, n, lanes, len(symbols), len(known), len(body) - len(known), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    if len(block) < _HEADER.size:
        raise BlockError("too short")
    magic, n, lanes, n_symbols, n_known, size, id_sum, body_sum = _HEADER.unpack_from(block)
    body = block[_HEADER.size : _HEADER.size + n_known + size]
    if magic != MAGIC or len(body) != n_known + size or zlib.crc32(body) != body_sum:
        raise BlockError("wrong magic, length or checksum")
    symbols = np.cumsum(np.frombuffer(zlib.decompress(body[:n_known]), "<u4"), dtype=np.uint32)
    steps = -(-n // lanes)
    at = np.frombuffer(body, "<u4", lanes, n_known).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u2", offset=n_known + 4 * lanes), np.zeros(4, np.uint16)).astype(np.uint64)
    next_word = np.cumsum(at) - at
    code = (words[next_word] << _U40) | (words[next_word + 1] << np.uint64(24)) | (words[next_word + 2] << np.uint64(8)) | (words[next_word + 3] >> np.uint64(8))
    # the window ends inside a word: of the fourth word a byte is still to come
    half, next_word = words[next_word + 3] & np.uint64(0xFF), next_word + 4
    span = np.full(lanes, (1 << 56) - 1, np.uint64)
    models = _Models(lanes, max(1, n_symbols), True)
    shift, most = np.uint64(_MIX + models.bits), np.uint64((1 << models.bits) - 1)
    grid = np.empty((steps, lanes), np.int64)
    for step in range(steps if n else 0):
        models.predict()
        unit = span >> shift
        value = code // unit
        second = models.base[models.context]  # order 0 begins here
        foretold = value < second
        is2 = value < models.base[models.context + 128]
        is1 = foretold & ~is2
        own = models.symbol_of(np.minimum((np.maximum(value, second) - second) // models.mult[models.context], most))
        start, wide = models.interval(is1, is2, np.where(foretold, models.symbols, own))
        now = np.where(foretold, np.where(is1, models.id1, models.id2), own)
        code -= unit * start
        span = unit * wide
        short = np.flatnonzero(span < _LEAST)
        while len(short):
            word = words[np.minimum(next_word[short], len(words) - 1)]
            code[short] = (code[short] << _U16) | (half[short] << np.uint64(8)) | (word >> np.uint64(8))
            half[short] = word & np.uint64(0xFF)
            next_word[short] += 1
            grown = span[short] << _U16
            span[short] = grown
            short = short[grown < _LEAST]
        grid[step] = now
        models.update(now, is2)
    ids = symbols[np.ascontiguousarray(grid.T).reshape(-1)[:n]].astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != id_sum:
        raise BlockError("the decoded ids do not have the block's checksum")
    return ids
