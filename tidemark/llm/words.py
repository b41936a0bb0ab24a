"""Words of whole Arrow text columns as numpy arrays.

Texts stay UTF-8 bytes: every separator class used here is ASCII, so splitting
bytes is splitting code points. A word's 64-bit fingerprint comes from one
running sum over the block (random byte codes times powers of an odd base), so
a block of many texts is cut and hashed in a handful of vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Odd multipliers that combine the words of an n-gram (row 0) and a second,
#: independent set (row 1) for 128-bit keys.
GRAM = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_all = np.arange(256)
_SPACE = (_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D))
#: Words are maximal runs without ASCII white space, letters as they are.
PLAIN = (~_SPACE, np.arange(256, dtype=np.uint8))
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
#: The same with A-Z lower-cased.
LOWER = (~_SPACE, _lower)
#: Words are runs of digits, a-z (after lower-casing) and non-ASCII characters.
ALNUM = (((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x41) & (_all <= 0x5A)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80), _lower)

_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(BLOCK_BYTES + 1, n + 1)
        with np.errstate(over="ignore"):
            for base in (_BASE, _UNBASE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fresh array)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


class Block:
    """Consecutive texts of one batch and their words.

    ``start``/``end``: byte range of each word in ``data``; ``first``: index of
    each text's first word, one more entry than texts; ``hash``: fingerprints.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: tuple, at: int):
        self.data, self.offsets, self.at, self.n = data, offsets, at, len(offsets) - 1
        member, fold = kind
        inside = member[data]
        opens, closes = inside.copy(), np.zeros(len(data) + 1, bool)
        if len(data):
            opens[1:] &= ~inside[:-1]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            opens[edges] = inside[edges]
            closes[1:-1] = inside[:-1] & ~inside[1:]
            closes[-1] = inside[-1]
            closes[edges] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        power, unpower = power_tables(len(data))
        with np.errstate(over="ignore"):
            running = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODES[fold[data]] * power[: len(data)], out=running[1:])
            self.hash = mix((running[self.end] - running[self.start]) * unpower[self.start])

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text within the block."""
        return np.repeat(np.arange(self.n), self.count)

    def grams(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of each text's ``size``-word windows, and where each
        text's begin (one more entry than texts). A text of fewer words, but not
        none, has one window: its whole sequence."""
        c = self.count
        n = np.where(c >= size, c - size + 1, (c > 0).astype(c.dtype))
        first = np.zeros(self.n + 1, np.int64)
        np.cumsum(n, out=first[1:])
        return windows(self.hash, self.first, first, size, salt), first

    def sequence_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each text's whole word sequence."""
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.count)
        out = []
        with np.errstate(over="ignore"):
            for salt in (0, 1):
                step = mix(place.astype(np.uint64) * GRAM[salt, 9] + GRAM[salt, 11]) | np.uint64(1)
                sums = np.zeros(len(self.hash) + 1, np.uint64)
                np.cumsum(mix(self.hash * GRAM[salt, 13]) * step, out=sums[1:])
                out.append(mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.count.astype(np.uint64)))
        return out[0], out[1]


def windows(words: np.ndarray, word_first: np.ndarray, out_first: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash ``size`` consecutive words; texts never run into each other."""
    n = int(out_first[-1])
    if not n:
        return np.zeros(0, np.uint64)
    begin = np.arange(n) + np.repeat(word_first[:-1] - out_first[:-1], np.diff(out_first))
    stop = np.repeat(word_first[1:], np.diff(out_first))
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        short = bool(np.any(begin + size > stop))
        for j in range(size):
            term = padded[begin + j] * GRAM[salt, j]
            total += np.where(begin + j < stop, term, np.uint64(0)) if short else term
        return mix(total)


def blocks(column: pa.Array, kind: tuple, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut one Arrow text column into blocks of about ``limit`` bytes of whole
    texts (a longer text is a block of its own). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        own = offsets[at : to + 1]
        yield Block(data[own[0] : own[-1]], own - own[0], kind, at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
