"""Toxicity (2): class-conditional Kneser-Ney models, compared by length-normalised log-likelihoods of passages.

Method. Words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, outer punctuation dropped) and their stems (the first STEM bytes of
longer words, the whole of others) are counted by class over all labelled training rows, once a document, so that neither
repeated lines nor long documents weigh more; equal texts count once. The class c is the context of a word, and orders
back off from the word to its stem to counts that the classes share:
  P_c(w) = max(n_c(w) - D, 0) / n_c + L_c P_c(s) R(w | s)      s: the stem of w
  P_c(s) = max(m_c(s) - D, 0) / m_c + M_c C(s)
n_c(w), m_c(s) are numbers of documents of class c that hold the word, the stem; n_c, m_c their sums; L_c, M_c the shares of
n_c, m_c that the discount D takes away. C and R are Kneser-Ney's continuation counts, shared by both classes: in how many
classes a stem, a word occurs, as a share of all stems' and of the stem's words' numbers. So a rare expression, of at most D
documents in either class, is smoothed into its stem's likelihood, and stems that are as rare into one unknown symbol,
whose likelihood is that of all rare stems together. The log-likelihoods of both classes are summed over each passage of
PASSAGE neighbouring words (a shorter text is one passage) and divided by its number of words; a text's argument is the
largest difference, toxic less ordinary, of its passages, since a toxic document is mostly ordinary words. No likelihood
is set to nought and no threshold chooses expressions: a logistic curve of the argument, fitted on a fold of the training
rows that the counts leave out, decides. D and PASSAGE were chosen on that fold too, not on held-out documents.

Plan. Labels are joined to texts map-side if there are at most BROADCAST_LABELS (counted), else by a shuffled join: all
labelled rows are used at any size. Counts are merged inside tasks and by partially aggregated group-bys, and stay
distributed tables; words meet their stems in a shuffled join. Words of at most D documents in both classes differ from a
new word in nothing (R cancels), hence the model need hold the others only: all of them, at any size, in broadcasts of at
most PART expressions, by hash, of which driver and tasks hold one at a time. The curve is fitted on a histogram of BINS
bins over all rows of the calibration fold. Scoring is a map without a shuffle.

Defined cases. Texts without words (null, empty, white space) have argument 0. A label table with several rows for an
id counts the largest; null ids and labels don't train. If a class has no training text, every score is the share of
toxic training labels (0.0 without any). One row for each input row, repeated ids included. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import CHUNK_BYTES, chunked, cut, flat, fold
from rasterloom.llm.lookup import Lookup, in_turn, release
from rasterloom.llm.words import _CODES, Words, mix, span_hashes

DISCOUNT, PASSAGE, STEM, BINS = 2, 3, 5, 4096
BROADCAST_LABELS = 2_000_000
#: Most expressions of a broadcast, and bytes of text that are looked up in several ones at once.
PART, PARTS_CHUNK = 1 << 22, 1 << 24
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: A task hands on its counts when it holds so many distinct expressions.
HELD = 1 << 20
#: The histogram of arguments spans -LIMIT to LIMIT.
LIMIT = 16.0

_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


class Tokens(Words):
    """Words without the punctuation around them; those of punctuation alone are left out. Keys have 52 bits."""

    def __init__(self, raw: list[bytes]):
        super().__init__(raw)
        a, b = self.starts.copy(), self.ends.copy()
        while len(grow := np.flatnonzero((a < b) & _EDGE[self.data[np.minimum(a, len(self.data) - 1)]])):
            a[grow] += 1
        while len(grow := np.flatnonzero((a < b) & _EDGE[self.data[b - 1]])):
            b[grow] -= 1
        keep = a < b
        place = np.concatenate(([0], np.cumsum(keep)))
        self.starts, self.ends, self.offsets = a[keep], b[keep], place[self.offsets]
        self.owner = np.repeat(np.arange(len(raw)), self.counts())

    @cached_property
    def keys(self) -> np.ndarray:
        return self.hashes >> np.uint64(12)

    @cached_property
    def stems(self) -> np.ndarray:
        """Keys of the words' stems, which are of another kind than words."""
        if not len(self.starts):
            return self.keys
        return mix(span_hashes(_CODES[self.data], self.starts, np.minimum(self.ends, self.starts + STEM)) ^ np.uint64(0x5EED)) >> np.uint64(12)


def tally(keys: np.ndarray, owner: np.ndarray, toxic: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (52 bits), the numbers of toxic and ordinary texts that hold them, and their stems; owner below 4096."""
    packed, at = np.unique((keys << np.uint64(12)) | owner.astype(np.uint64), return_index=True)
    t = toxic[(packed & np.uint64(4095)).astype(np.int64)].astype(np.int64)
    return summed(packed >> np.uint64(12), t, 1 - t, stem[at])


def summed(k: np.ndarray, t: np.ndarray, o: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for sorted keys with counts."""
    if not len(k):
        return k, t, o, stem
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[edge], np.add.reduceat(t, edge), np.add.reduceat(o, edge), stem[edge]


COUNTED = "word boolean, k long, t long, o long, stem long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or stem, key, toxic, ordinary, stem), merged inside the task."""
    held: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0])
        return summed(*(c[order] for c in columns))

    def give() -> Iterator[pa.RecordBatch]:
        for word, parts in held.items():
            if parts:
                k, t, o, stem = merged(parts)
                yield pa.record_batch([pa.array(np.full(len(k), word)), pa.array(k.view(np.int64)), pa.array(t), pa.array(o), pa.array(stem.view(np.int64))], ["word", "k", "t", "o", "stem"])
                parts.clear()

    for batch in flat(batches):
        toxic = np.asarray(batch.column(0)).astype(bool)
        for at, raw in chunked(batch.column(1)):
            w = Tokens(raw)
            for word, keys in ((True, w.keys), (False, w.stems)):
                held[word].append(tally(keys, w.owner, toxic[at : at + len(raw)], w.stems))
                if len(held[word]) > 12:
                    held[word] = [merged(held[word])]
        if sum(len(h[0]) for parts in held.values() for h in parts) > HELD:
            yield from give()
    yield from give()


class Model:
    """Log ratios of words and stems (broadcasts of sorted hashes and ratios), of what they don't hold, and the curve."""

    def __init__(self, parts: list, rare_word: float, rare_stem: float):
        self.parts, self.rare_word, self.rare_stem = parts, rare_word, rare_stem
        self.a, self.b, self.find = 1.0, 0.0, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"find": None}

    def ratios(self, hashes: np.ndarray) -> np.ndarray:
        """NaN for what the model doesn't hold."""
        out = np.full(len(hashes), np.nan)
        for keys, values in in_turn(self.parts):
            find = self.find or Lookup(keys)
            if len(self.parts) == 1:  # once in each task
                self.find = find
            at = find(hashes)
            out[at >= 0] = values[at[at >= 0]]
        return out

    def of_words(self, w: Tokens) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word."""
        word, stem = np.split(self.ratios(np.concatenate((w.keys, w.stems)) << np.uint64(12)), 2)
        return np.where(np.isnan(word), self.rare_word + np.where(np.isnan(stem), self.rare_stem, stem), word)

    def arguments(self, raw: list[bytes]) -> np.ndarray:
        """The largest mean log-likelihood ratio of a text's passages; 0 for texts without words."""
        w = Tokens(raw)
        n = w.counts()
        out = np.zeros(len(raw))
        full = np.flatnonzero(n)
        if not len(full):
            return out
        sums = np.concatenate(([0.0], np.cumsum(self.of_words(w))))
        at = np.arange(len(w.owner))
        size = np.minimum(PASSAGE, n)[w.owner]
        # passages begin where they end inside the text
        mean = np.where(at + size <= w.offsets[w.owner + 1], (sums[np.minimum(at + size, len(at))] - sums[at]) / size, -np.inf)
        out[full] = np.maximum.reduceat(mean, w.offsets[full])
        return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            for at, raw in chunked(batch.column(1), PARTS_CHUNK if isinstance(model, Model) and len(model.parts) > 1 else CHUNK_BYTES):
                if isinstance(model, Model):
                    x = model.arguments(raw)
                    score = 1 / (1 + np.exp(-np.clip(model.a * x + model.b, -40, 40)))
                else:
                    x, score = np.zeros(len(raw)), np.full(len(raw), float(model))
                yield pa.record_batch([batch.column(0).slice(at, len(raw)), pa.array(x), pa.array(score)], ["id", "argument", "score"])

    return run


def fit_curve(at: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """Logistic regression of weighted points by Newton steps, with a weak pull of the slope towards 0."""
    scale = max(1e-6, float(np.abs(at).max(initial=0)))
    x, n = at / scale, toxic + ordinary
    w = np.zeros(2)
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        grad = features.T @ (toxic - n * p) - np.array([1e-4, 0]) * w
        hess = (features * (n * p * (1 - p))[:, None]).T @ features + np.diag([1e-4, 1e-6])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(fold, toxic, text) of the training rows."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(F.col(label_col)) > 0).alias("toxic"))
    marks = marks.withColumn("fold", fold("id", FOLDS)).where(F.col("fold") != HELD_OUT)
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(marks, "id").select("fold", F.col("toxic").cast("int").alias("toxic"), "text")


def _parts(expressions: DataFrame) -> list:
    """Broadcasts of at most about PART expressions each, at least one."""
    n = max(1, -(-expressions.count() // PART))
    out = []
    for i in range(n):
        found = expressions.where(F.pmod(F.shiftrightunsigned("hash", 20), F.lit(n)) == i).toArrow()
        keys, at = np.unique(np.asarray(found.column("hash")).view(np.uint64), return_index=True)
        out.append(expressions.sparkSession.sparkContext.broadcast((keys, np.asarray(found.column("ratio"))[at])))
        release(out[-1])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """The model from all labelled rows outside the held-out fold; a number if a class has none."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    fitting = rows.where(F.col("fold") != CALIBRATION).groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    counts = cut(fitting.mapInArrow(_count, COUNTED).groupBy("word", "k").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.max("stem").alias("stem")))
    rare = (F.col("t") <= DISCOUNT) & (F.col("o") <= DISCOUNT)
    taken = lambda n: F.sum(F.least(n, F.lit(DISCOUNT)))
    kinds = (F.col("t") > 0).cast("long") + (F.col("o") > 0).cast("long")
    sums = counts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), taken(F.col("t")).alias("dt"), taken(F.col("o")).alias("do"), F.sum(F.when(rare, F.col("t"))).alias("rt"), F.sum(F.when(rare, F.col("o"))).alias("ro"), F.sum(kinds).alias("kinds"))
    of = {r["word"]: r for r in sums.collect()}
    if not of or not of[True]["t"] or not of[True]["o"]:
        return 1.0 if of and of[True]["t"] else 0.0
    word, stem = of[True], of[False]
    # unknown stems: the likelihoods of all rare ones together
    unknown = float(np.log(((stem["rt"] or 0) + 1) / stem["t"]) - np.log(((stem["ro"] or 0) + 1) / stem["o"]))

    def likelihood(n: str, side: str, of: dict, lower) -> Column:
        return F.greatest(F.col(n) - DISCOUNT, F.lit(0)) / F.lit(float(of[n])) + F.lit(of[side] / of[n]) * lower

    shared = kinds / F.lit(float(stem["kinds"] + 1))
    stems = counts.where(~F.col("word")).select(F.col("k").alias("stem"), rare.alias("rare"), likelihood("t", "dt", stem, shared).alias("st"), likelihood("o", "do", stem, shared).alias("so"))
    stems = stems.select("stem", "rare", F.when(F.col("rare"), F.col("so") * float(np.exp(unknown))).otherwise(F.col("st")).alias("st"), "so")
    continued = counts.where("word").groupBy("stem").agg((F.sum(kinds) + 1).alias("continued"))
    words = counts.where(F.col("word") & ~rare).join(continued, "stem").join(stems, "stem")
    of_class = [likelihood(n, side, word, F.col(low) * kinds / F.col("continued")) for n, side, low in (("t", "dt", "st"), ("o", "do", "so"))]
    found = words.select(F.shiftleft("k", 12).alias("hash"), (F.log(of_class[0]) - F.log(of_class[1])).alias("ratio"))
    found = found.union(stems.where(~F.col("rare")).select(F.shiftleft("stem", 12), F.log("st") - F.log("so")))
    model = Model(_parts(cut(found)), float(np.log(word["dt"] / word["t"]) - np.log(word["do"] / word["o"])), unknown)

    calibration = rows.where(F.col("fold") == CALIBRATION)
    scored = calibration.select(F.col("toxic").cast("long").alias("id"), "text").mapInArrow(_score(model), "id long, argument double, score double")
    clipped = F.least(F.greatest(F.col("argument"), F.lit(-LIMIT)), F.lit(LIMIT))
    bins = scored.groupBy("id", F.floor((clipped + LIMIT) * (BINS / (2 * LIMIT))).alias("bin")).agg(F.count("*").alias("n"), F.sum(clipped).alias("s")).toArrow().to_pylist()
    n = np.array([b["n"] for b in bins], float)
    toxic = np.array([b["id"] for b in bins], float) > 0
    if toxic.any() and not toxic.all():
        model.a, model.b = fit_curve(np.array([b["s"] / b["n"] for b in bins]), n * toxic, n * ~toxic)
    return model


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, argument, score) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "id long, argument double, score double")
