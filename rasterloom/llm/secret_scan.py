"""Secret scans (10): patterns, and sliding-window Shannon entropy per character class over candidate strings.

Method. Candidate strings are maximal runs of `[A-Za-z0-9+/_=-]` of `window` characters or more. For each character
class (hex digits; letters, digits and + / _ - =) a window of fixed width slides over the candidate's maximal sub-runs
of that class. Counts of its characters, and the sum of c * log2(c) over them, change by one addition and one removal
a step, so that each step costs the same; entropy = log2(width) - sum / width. Windows at or above the class's
threshold are merged to a span. An allow-list suppresses what only looks random: letters of one case alone (long
words), letters of which few have the other case (names joined by capitals), digits alone (numbers have operators of their own),
ascending or repeating runs, UUIDs, and windows that hold a placeholder word; what stands beside such a window is
scanned as ever. Spans of the three base patterns are always kept and never suppressed.

Plan. A map over Arrow batches, without any shuffle: runs are found for a whole chunk of UTF-8 bytes in numpy, and
Python sees candidates only. All classes are ASCII, so that bytes match as characters do; positions are then turned
into code points. Memory is bounded by a chunk or the longest text.

Defined cases. Null texts count as empty; empty texts have no spans. One row for each input row, repeated ids
included; null ids stay. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import chunked, flat

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_text")
WINDOW = 20
#: Bits at which a window of WINDOW characters counts as random, by class.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_text": 3.6}
# fixed values: words that mark a placeholder, lower case
PLACEHOLDERS = (b"example", b"sample", b"placeholder", b"changeme", b"dummy", b"xxxx", b"your_", b"your-", b"redacted")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_UUID = re.compile(rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_PLACEHOLDER = re.compile(b"|".join(map(re.escape, PLACEHOLDERS)), re.IGNORECASE)


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_HEX_LOWER, _HEX = _members(_DIGITS + b"abcdef"), _members(_DIGITS + b"abcdefABCDEF")
_TEXT = _members(_DIGITS + _LOWER + _UPPER + b"+/_=-")
_CLASSES = {"entropy_hex": _HEX, "entropy_text": _TEXT}

SPANS = "array<struct<kind:string,start:int,end:int,bits:double>>"


def runs_of(member: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least `least` bytes in the class; data ends outside the class."""
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


@lru_cache(maxsize=8)
def _terms(width: int) -> list[float]:
    """c * log2(c) of each count of a window."""
    return [0.0] + [c * math.log2(c) for c in range(1, width + 2)]


def sliding_entropy(text: bytes, width: int) -> Iterator[tuple[int, float]]:
    """(position, bits) of each window of `width` bytes, from counts that change by one byte in and one out."""
    terms = _terms(width)
    counts, total, top = [0] * 256, 0.0, math.log2(width)
    for i, c in enumerate(text):
        total += terms[counts[c] + 1] - terms[counts[c]]
        counts[c] += 1
        if i >= width:
            gone = text[i - width]
            total += terms[counts[gone] - 1] - terms[counts[gone]]
            counts[gone] -= 1
        if i >= width - 1:
            yield i - width + 1, top - total / width


def allowed(text: bytes) -> bool:
    """Whether the allow-list suppresses a string found by entropy alone."""
    kinds = bool(re.search(rb"[0-9]", text)), bool(re.search(rb"[a-z]", text)), bool(re.search(rb"[A-Z]", text))
    if sum(kinds) < 2:  # one case, or digits alone
        return True
    if not kinds[0]:  # letters alone: in words joined by capitals, one case is rare
        upper, lower = len(re.findall(rb"[A-Z]", text)), len(re.findall(rb"[a-z]", text))
        if 10 * min(upper, lower) < 3 * (upper + lower):
            return True
    low = text.lower()
    steps = [b - a for a, b in zip(low, low[1:], strict=False)]
    return max((sum(s == k for s in steps) for k in (-1, 0, 1)), default=0) * 2 > len(steps)


def entropy_spans(text: bytes, start: int, window: int, thresholds: dict[str, float]) -> Iterator[tuple[str, int, int, float]]:
    """Spans of one candidate; start is its offset. No window reaches into a UUID or a placeholder word."""
    for known in (_UUID, _PLACEHOLDER):
        text = known.sub(lambda m: b"\0" * len(m.group()), text)
    data = np.frombuffer(text + b" ", np.uint8)
    for kind, least in thresholds.items():
        for a, b in zip(*runs_of(_CLASSES[kind], data, window), strict=True):
            open_, until, best = -1, -1, 0.0
            for at, bits in sliding_entropy(text[a:b], window):
                if bits < least:
                    continue
                if open_ >= 0 and at > until:
                    if not allowed(text[a + open_ : a + until]):
                        yield kind, start + int(a) + open_, start + int(a) + until, best
                    open_, best = -1, 0.0
                open_, until, best = (at if open_ < 0 else open_), at + window, max(best, bits)
            if open_ >= 0 and not allowed(text[a + open_ : a + until]):
                yield kind, start + int(a) + open_, start + int(a) + until, best


def chunk_spans(raw: list[bytes], window: int, thresholds: dict[str, float]) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each text of a chunk, in code points, by start and then kind."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    first = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in raw]
    for a, b in zip(*runs_of(_HEX_LOWER, data, 16), strict=True):
        i = int(np.searchsorted(first, a, "right")) - 1
        found[i].append(("hex", int(a - first[i]), int(b - first[i]), 0.0))
    for a, b in zip(*runs_of(_TEXT, data, window), strict=True):
        i = int(np.searchsorted(first, a, "right")) - 1
        text = raw[i][a - first[i] : b - first[i]]
        if re.search(rb"[0-9]", text) or not (text.islower() or text.isupper()):  # the allow-list takes letters of one case
            found[i] += entropy_spans(text, int(a - first[i]), window, thresholds)
    for i, text in enumerate(raw):
        if b"=" in text or b":" in text:
            found[i] += [("assign", m.start(), m.end(), 0.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if b"AKIA" in text:
            found[i] += [("access", m.start(), m.end(), 0.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        if found[i]:
            if not text.isascii():
                at = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                found[i] = [(k, int(at[a]), int(at[b]), bits) for k, a, b, bits in found[i]]
            found[i].sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def _scan(window: int, thresholds: dict[str, float]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            for at, raw in chunked(batch.column(1)):
                spans = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in own] for own in chunk_spans(raw, window, thresholds)]
                yield pa.record_batch([batch.column(0).slice(at, len(raw)), pa.array(spans, kind)], ["id", "spans"])

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(id, spans): for each document its spans (kind, start, end in code points with end exclusive, bits)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan(window, thresholds or THRESHOLDS), f"id long, spans {SPANS}")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
