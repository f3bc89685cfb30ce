"""Byte-level BPE over whole chunks: pre-tokens found in numpy, encoded once each with the tokenizers library.

Pre-tokens are those of the byte-level pattern
  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
whose boundaries depend on the character classes of a few neighbours only, so that they are found for a whole chunk of
texts at once. BPE merges never cross pre-tokens: the ids of a text are those of its pre-tokens, end to end. Distinct
pre-tokens are encoded with the library's own model and kept by 64-bit hash in the Python worker, up to a bounded
number; then the store starts anew.

Added tokens of the file (such as `<|endoftext|>`) are found first, leftmost and longest, as the library does unless its
`encode_special_tokens` is set: each is a pre-token of its own, and what lies between two of them is cut into pre-tokens
as a text of its own. Files with a normaliser, another pre-tokeniser, or added tokens with conditions are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from rasterloom.llm.lookup import Lookup
from rasterloom.llm.words import mix, span_hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Distinct pre-tokens that a worker keeps.
HELD = 3_000_000
CHUNK_CHARS = 1 << 19

# fixed values: white space of the pattern beyond the Z* categories
_WHITE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: suffixes that follow an apostrophe as one pre-token
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASS:
        of = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[[x for x in _WHITE if not 28 <= x <= 31]] = SPACE
        _CLASS.append(table)
    return _CLASS[0]


class Pretokens:
    """Boundaries of the pre-tokens of a chunk of texts: starts, ends (in the joined text) and offsets by text.

    `added` finds the added tokens of a text, if there are any.
    """

    def __init__(self, texts: list[str], added: re.Pattern | None = None):
        # a separator after each text ends white space as the end of the text does, and is no pre-token itself
        self.joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        self.text_at = ends - sizes
        k = classes()[codes]
        stop = np.zeros(len(codes), bool)
        stop[ends] = True
        before = np.empty_like(stop)
        before[0] = True
        before[1:] = stop[:-1]
        whole = self._added(texts, added)
        for a, b in whole:
            before[a] = before[b] = True
        blank = codes == 32
        white = (k == SPACE) & ~stop
        start = np.zeros(len(codes), bool)
        start[0] = True
        start[1:] = k[1:] != k[:-1]
        start |= before
        # a space before a word, number or sign belongs to it
        word = ~white & ~stop
        start[1:] &= ~(word[1:] & blank[:-1] & ~before[1:])
        # of several white characters, the last stands alone if something other than the text's end follows
        last = np.zeros(len(codes), bool)
        last[:-1] = white[:-1] & word[1:] & ~before[1:]
        start |= last
        self._contract(codes, start, k, before)
        for a, b in whole:
            start[a + 1 : b] = False
        start[stop] = True
        at = np.flatnonzero(start)
        close = np.append(at[1:], len(codes))
        keep = ~stop[at]
        self.starts, self.ends = at[keep], close[keep]
        self.offsets = np.searchsorted(self.starts, np.append(self.text_at, len(codes)))

    def _added(self, texts: list[str], added: re.Pattern | None) -> list[tuple[int, int]]:
        """Spans of added tokens in the joined text; none crosses two texts."""
        if added is None or not added.search(self.joined):
            return []
        return [(int(at) + m.start(), int(at) + m.end()) for at, text in zip(self.text_at, texts, strict=True) for m in added.finditer(text)]

    @staticmethod
    def _contract(codes: np.ndarray, start: np.ndarray, k: np.ndarray, before: np.ndarray) -> None:
        quotes = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (k[1:] == LETTER) & ~before[1:])
        n = len(codes)
        for i in quotes:
            for suffix in _SUFFIXES:
                m = len(suffix)
                if i + m < n and all(codes[i + 1 + j] == ord(c) and not before[i + 1 + j] for j, c in enumerate(suffix)):
                    start[i + 1] = False
                    start[i + 1 + m] = True
                    break

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return span_hashes(mix(self.codes.astype(np.uint64) + np.uint64(0x7F4A7C15)), self.starts, self.ends)

    def string(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


def text_chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, texts[at:]


def added_tokens(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """The ids of a file's added tokens, and a pattern that finds them; refuses files that this module can't follow."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    before = file.get("pre_tokenizer") or {}
    if file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level tokenizer with the byte-level pattern and no normaliser")
    found = file.get("added_tokens") or []
    if any(t.get(flag) for t in found for flag in ("single_word", "lstrip", "rstrip")) or len({bool(t.get("normalized")) for t in found}) > 1:
        raise ValueError(f"{path}: added tokens with conditions on what stands beside them")
    ids = {t["content"]: int(t["id"]) for t in found if t["content"]}
    longest = sorted(ids, key=lambda t: (-len(t), t))
    return ids, re.compile("|".join(map(re.escape, longest))) if ids else None


class Encoder:
    """Ids of pre-tokens by the tokenizers library, remembered between chunks and tasks of one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.added_ids, self.added = added_tokens(path)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in set(kept) else next(spare)) for b in range(256)}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.recent_keys, self.recent_slot = self.keys, self.slot
        self.find, self.find_recent = Lookup(self.keys), Lookup(self.keys)
        self.first, self.size, self.used = np.zeros(1, np.int64), np.zeros(0, np.int64), 0
        self.pool = np.zeros(1 << 16, np.uint32)

    def one(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        if text in self.added_ids:
            return [self.added_ids[text]]
        return [t.id for t in self.model.tokenize(text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet))]

    def pretokens(self, texts: list[str]) -> Pretokens:
        return Pretokens(texts, self.added)

    def _learn(self, p: Pretokens, hashes: np.ndarray, missing: np.ndarray) -> None:
        new, where = np.unique(hashes[missing], return_index=True)
        ids = [self.one(p.string(i)) for i in missing[where]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        slots = np.arange(len(self.size), len(self.size) + len(new))
        self.first = np.concatenate((self.first[:-1], self.used + np.concatenate(([0], np.cumsum(sizes)))))
        self.used += len(flat)
        self.size = np.concatenate((self.size, sizes))

        def merged(k1, s1, k2, s2):
            k, s = np.concatenate((k1, k2)), np.concatenate((s1, s2))
            order = np.argsort(k)
            return k[order], s[order]

        self.recent_keys, self.recent_slot = merged(self.recent_keys, self.recent_slot, new, slots)
        if len(self.recent_keys) * 4 > len(self.keys):
            self.keys, self.slot = merged(self.keys, self.slot, self.recent_keys, self.recent_slot)
            self.find = Lookup(self.keys)
            self.recent_keys, self.recent_slot = self.keys[:0], self.slot[:0]
        self.find_recent = Lookup(self.recent_keys)

    def slots(self, p: Pretokens) -> np.ndarray:
        """The store's place of each pre-token of a chunk."""
        if len(self.size) > HELD:
            self._clear()
        h = p.hashes()
        out = self._places(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            self._learn(p, h, missing)
            out[missing] = self._places(h[missing])
        return out

    def _places(self, h: np.ndarray) -> np.ndarray:
        at = self.find(h)
        out = np.full(len(h), -1, np.int64)
        hit = at >= 0
        out[hit] = self.slot[at[hit]]
        rest = np.flatnonzero(~hit)
        at = self.find_recent(h[rest])
        out[rest[at >= 0]] = self.recent_slot[at[at >= 0]]
        return out

    def counts(self, p: Pretokens) -> np.ndarray:
        """The number of ids of each pre-token."""
        slots = self.slots(p)  # may add to the sizes
        return self.size[slots]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, each text closed by `end` if given, and the offsets by text."""
        p = self.pretokens(texts)
        slots = self.slots(p)
        sizes = self.size[slots]
        sums = np.concatenate(([0], np.cumsum(sizes)))
        per_text = np.diff(sums[p.offsets])
        extra = 0 if end is None else 1
        offsets = np.concatenate(([0], np.cumsum(per_text + extra)))
        out = np.full(int(offsets[-1]), 0 if end is None else end, np.uint32)
        source = np.repeat(self.first[slots] - sums[:-1], sizes) + np.arange(sums[-1])
        ids = self.pool[source]
        if extra:
            out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), per_text)] = ids
        else:
            out[:] = ids
        return out, offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
