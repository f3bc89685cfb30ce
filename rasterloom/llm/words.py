"""Vectorised word and shingle hashing: numpy over whole chunks of UTF-8 bytes.

A word is `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Its hash is a polynomial over random 64-bit byte codes,
taken as a difference of prefix sums, then mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240601))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 8)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 2**64))
        filled += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; kept between calls up to a bounded length."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 20)
    both = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size)
    if size <= 1 << 23:
        _POWERS[:] = both
    return both


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of codes[start:end], all spans not empty; codes are 64-bit codes of the symbols."""
    up, down = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of a chunk of texts: hashes, byte spans in `data`, and offsets of each text's words."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lengths + 1, out=first[1:])
        self.text_at = first
        self.offsets = np.searchsorted(self.starts, first)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(_CODES[self.data], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.raw)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text and their offsets by text, repeats included.

    A text of fewer words (one at least) has its whole sequence as its only shingle; a text without words has none.
    """
    h, counts = words.hashes, words.counts()
    kept = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(kept, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    if len(h) >= width:
        runs = h[: len(h) - width + 1] * _STEP[0]
        for j in range(1, width):
            runs += h[j : len(h) - width + 1 + j] * _STEP[j % 8]
        runs = mix(runs)
        whole = np.flatnonzero(counts >= width)
        at = np.repeat(words.offsets[whole] - offsets[whole], kept[whole])
        place = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in whole]) if len(whole) else np.zeros(0, np.int64)
        out[place] = runs[place + at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = h[words.offsets[i] : words.offsets[i + 1]]
        total = np.uint64(len(part))
        with np.errstate(over="ignore"):
            for j, x in enumerate(part):
                total = total * _STEP[7] + x * _STEP[j % 7]
        out[offsets[i]] = mix(np.array([total ^ np.uint64(0x5BD1E995)], np.uint64))[0]
    return out, offsets
