"""Language ID (5): language-bitmask n-gram filters.

Method. Letter 4-grams (lower case, with word edges) are counted by language over all labelled training texts. A language
has a bit for each of LEVELS: an n-gram sets the first if the language holds it at all, and each further one if its rate
among the language's n-grams is at least that level's, so that an n-gram quoted once in a foreign text counts for less
than one at home. All languages' bits lie in one Bloom filter whose slots are bitmasks, bit-sliced into planes of 64 bits:
the AND of an n-gram's slots gives every language that holds it at once, and at which levels. A text's n-grams are looked
up, bits counted, and each count is corrected for the bit's own false positive rate f (share of slots with it, to the
number of hashes): (count - n * f) / (1 - f), at least 0. A language's popcount is the sum over its levels; the largest
decides, ties go to the first language by name.

Plan. Counting is a map that merges n-grams inside a task before a partially aggregated group-by; slot positions are
aggregated with bit_or. Every n-gram of every language enters. The slots grow with the n-grams without a limit, so that
the false positive rate is bounded: above SLOTS, n-grams are dealt by hash to several filters of that size, which are
broadcast one by one. Driver and tasks hold one of them at a time; a chunk of texts is looked up in all in turn, and
counts add up. Predicting is a map without a shuffle. Memory: one filter, a chunk, or the longest text; and a few numbers a
language. N-grams are told apart by 64-bit hashes of whole code points.

Defined cases. Texts that are null or hold no letter: 'und', score 0. Letters but no known n-gram: the language of
the most training n-grams, score 0. Without any training text: 'und'. Rows without language don't train. One row for
each input row, repeated ids included. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, flat
from rasterloom.llm.lookup import in_turn, release
from rasterloom.llm.words import mix

UND = "und"
HASHES = 4
#: Rates from which an n-gram sets a language's further bits; the first is set by any occurrence.
LEVELS = (0.0, 2.0**-20, 2.0**-16, 2.0**-12)
#: Languages of a plane of 64 bits.
EACH = 64 // len(LEVELS)
#: Most slots of a filter, at PER_GRAM an n-gram: fewer are used for fewer n-grams, several filters for more.
SLOTS, PER_GRAM = 1 << 22, 12
#: A task hands on its counts when it holds so many distinct n-grams.
HELD_GRAMS = 1 << 21
CHUNK_CHARS, PARTS_CHARS = 1 << 18, 1 << 22

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4-grams of all texts, and the text that each belongs to.

    The inner places hold letters and the outer ones a letter or a word edge (0); a word of one letter is one n-gram.
    """
    joined = "\0\0".join(texts).lower() + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 2)
    c = np.concatenate((np.zeros(1, np.uint32), np.where(letters()[codes], codes, np.uint32(0))))
    a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
    alone = (a == 0) & (d == 0)
    keep = np.flatnonzero((b != 0) & ((d != 0) | alone))
    a, b, d, e = (x[keep].astype(np.uint64) for x in (a, b, d, e))
    e[alone[keep]] = 0
    # 21 bits a code point: two halves of 42 bits
    return mix(((a << np.uint64(21)) | b) * np.uint64(0x9E3779B97F4A7C15) + mix((d << np.uint64(21)) | e)), np.searchsorted(ends, keep, "right")


def text_chunks(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    texts = [x or "" for x in column.to_pylist()]
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(x) + 2
    if at < len(texts):
        yield at, texts[at:]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = _merge(parts)
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    for batch in flat(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, texts in text_chunks(batch.column(1)):
            own = langs[at : at + len(texts)]
            for lang in sorted(set(own)):
                keys = np.sort(grams([t for t, x in zip(texts, own, strict=True) if x == lang])[0])
                if len(keys):
                    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    parts = held.setdefault(lang, [])
                    parts.append((keys[edge], np.diff(np.append(edge, len(keys)))))
                    if len(parts) > 16:
                        held[lang] = [_merge(parts)]
        if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_GRAMS:
            yield from give()
            held = {}
    yield from give()


def slots_of(keys: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    h = mix(keys)
    step = mix(h ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
    return [((h + step * np.uint64(j)) >> np.uint64(20)).astype(np.int64) & (slots - 1) for j in range(hashes)]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The filter of each n-gram."""
    return (mix(keys ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _place(hashes: int, slots: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            part = pa.array(part_of(keys, parts))
            for at in slots_of(keys, hashes, slots):
                yield pa.record_batch([part, pa.array(at), *batch.columns[1:]], ["part", "slot", *batch.schema.names[1:]])

    return run


def place_of(language: int, level: int) -> tuple[int, np.uint64]:
    """The plane and the bit of a language's level."""
    return language // EACH, np.uint64(language % EACH * len(LEVELS) + level)


def false_rates(planes: np.ndarray, languages: int) -> list[list[float]]:
    """For each language, those of its levels."""

    def rate(i: int, level: int) -> float:
        plane, bit = place_of(i, level)
        return float(((planes[plane] >> bit) & np.uint64(1)).mean()) ** HASHES

    return [[rate(i, level) for level in range(len(LEVELS))] for i in range(languages)]


class Model:
    """languages by name; planes: (planes, slots) bitmasks, or broadcasts of them for each filter."""

    def __init__(self, languages: list[str], planes: np.ndarray | list, most: int, false: list[list[list[float]]] | None = None):
        self.languages, self.most = languages, most
        self.parts = planes if isinstance(planes, list) else [planes]
        self.false = false or [false_rates(p, len(languages)) for p in self.parts]

    def corrected(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) bits counted, less the expected false positives."""
        keys, owner = grams(texts)
        part = part_of(keys, len(self.parts)) if len(self.parts) > 1 else None
        out = np.zeros((len(texts), len(self.languages), len(LEVELS)))
        for number, (planes, false) in enumerate(zip(in_turn(self.parts), self.false, strict=True)):
            k, own = (keys, owner) if part is None else (keys[part == number], owner[part == number])
            if not len(k):
                continue
            # n-grams of a text stand together
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            text = own[first]
            total = np.diff(np.append(first, len(own)))
            at = slots_of(k, HASHES, planes.shape[1])
            for p, plane in enumerate(planes):
                mask = plane[at[0]]
                for a in at[1:]:
                    mask &= plane[a]
                for i in range(p * EACH, min((p + 1) * EACH, len(self.languages))):
                    for level in range(len(LEVELS)):
                        f = false[i][level]
                        hits = np.add.reduceat((mask >> place_of(i, level)[1]) & np.uint64(1), first)
                        out[text, i, level] += (hits - total * f) / max(1e-9, 1 - f)
        return np.maximum(0.0, out).sum(axis=2)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS) -> Model | None:
    """The filter from all rows of docs with a language; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = cut(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    known = F.broadcast(docs.sparkSession.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(languages)], "lang string, i int, total double"))
    rate = F.col("n") / F.col("total")
    # levels are nested: those that an n-gram reaches are the lowest bits
    reached = sum(((rate >= least).cast("int") for least in LEVELS[1:]), F.lit(1))
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), reached) - 1
    own = F.call_function("shiftleft", bits, F.col("i") % EACH * len(LEVELS))
    planes = (len(languages) + EACH - 1) // EACH
    masks = [F.bit_or(F.when(F.floor(F.col("i") / EACH) == p, own).otherwise(F.lit(0).cast("long"))).alias(f"m{p}") for p in range(planes)]
    masked = cut(counts.join(known, "lang").groupBy("gram").agg(*masks))
    n = masked.count()
    parts = max(1, -(-n * PER_GRAM // slots))
    slots = int(min(slots, 1 << max(10, int(np.ceil(np.log2(max(1, n) * PER_GRAM))))))
    placed = masked.mapInArrow(_place(HASHES, slots, parts), "part long, slot long, " + ", ".join(f"m{p} long" for p in range(planes)))
    filled = placed.groupBy("part", "slot").agg(*(F.bit_or(f"m{p}").alias(f"m{p}") for p in range(planes)))
    filled = cut(filled) if parts > 1 else filled
    tables, false = [], []
    for part in range(parts):
        own = filled.where(F.col("part") == part).toArrow()
        table = np.zeros((planes, slots), np.uint64)
        for p in range(planes):
            table[p, np.asarray(own.column("slot"))] = np.asarray(own.column(f"m{p}")).view(np.uint64)
        false.append(false_rates(table, len(languages)))
        tables.append(docs.sparkSession.sparkContext.broadcast(table))
        release(tables[-1])
    return Model(languages, tables, languages.index(max(languages, key=lambda x: totals[x])), false)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = model is not None and len(model.parts) > 1
        for batch in flat(batches):
            for at, texts in text_chunks(batch.column(1), PARTS_CHARS if several else CHUNK_CHARS):
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                if model is not None:
                    counts = model.corrected(texts)
                    best, total = counts.argmax(axis=1), counts.sum(axis=1)
                    for i, t in enumerate(texts):
                        if total[i] > 0:
                            lang[i], score[i] = model.languages[best[i]], float(counts[i, best[i]] / total[i])
                        elif any(x.isalpha() for x in t):
                            lang[i] = model.languages[model.most]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(lang), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the best language's share of all languages' popcounts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double")
