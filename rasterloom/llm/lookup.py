"""A read-only index of 64-bit hashes for numpy: top bits choose a short run of sorted keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Lookup:
    """Positions of hashes in `keys`, which are sorted, distinct and spread evenly over 64 bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.n = len(keys)
        bits = max(4, min(24, int(np.ceil(np.log2(max(self.n, 1) * 2 + 1)))))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        ends = np.append(self.first[1:], self.n)
        self.longest = int((ends - self.first).max(initial=0))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """int32 position of each hash, -1 if absent."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        hit = self.keys[at] == hashes
        hit &= at < self.n
        out = np.where(hit, at, np.int32(-1))
        rest = np.flatnonzero(~hit)
        for step in range(1, self.longest):
            if not len(rest):
                break
            place = np.minimum(at[rest] + step, self.n)
            key = self.keys[place]
            good = (key == hashes[rest]) & (place < self.n)
            out[rest[good]] = place[good]
            rest = rest[~good & (key < hashes[rest]) & (place < self.n)]
        return out


def in_turn(parts: list) -> Iterator:
    """Values of broadcasts (or plain values), of which only one is held at a time unless there is only one."""
    for part in parts:
        yield getattr(part, "value", part)
        if len(parts) > 1:
            release(part)


def release(part) -> None:
    """A broadcast's value leaves this process's memory; it is read from its file again where it is asked for."""
    part.__dict__.pop("_value", None)
