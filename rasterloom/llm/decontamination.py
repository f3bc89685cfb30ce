"""Benchmark decontamination (4): latent semantic retrieval of TF-IDF passages, then sequence and answer checks.

Method. Texts are cut into passages of PASSAGE words. Words are hashed to 2**FEATURE_BITS features; idf = log(N / n) by
passages and words over all documents. A randomised SVD of the TF-IDF passage matrix A gives the latent space: with a fixed
Gaussian test matrix G, every task adds up its part of C = A'(A G), and the small Nystrom factor of G'C turns the sum
into right singular vectors and values of A. Words are then points idf(w) V(w) (whitened by the singular values); a
window of words is the sum of its points, and windows that slide over each text are compared with the benchmark's
items by cosine. A window at or above `cosine` is a candidate, if its
words make up SHARED of the item's idf at all. So is one whose first STRIDE words hold a word of the item's key: its rarest
words, so many that no text without any of them can be confirmed. No copy that the checks confirm in the surroundings of
its own words is lost to the cosine. A candidate is confirmed on the words themselves: the longest
common subsequence of the item and the window with its surroundings must hold `direct` of the item's words, or `loose`
of them if it also holds `answer` of the words of the item's last sentence (a paraphrase that keeps the answer). Candidates
whose surroundings hold too few of the item's words, each as often as the item at most, can't pass and aren't compared. Items
of fewer than LEAST words would pass anywhere by such shares: they are found where all their words stand in a row.

Plan. Two sums over all documents (features' counts; the sketch C), each a map that adds up in numpy, then two group-bys of
fixed-size slices, by few tasks each and then by slice: a task hands on 2**FEATURE_BITS * RANK numbers at most, and tasks
cover several partitions so that this stays small against their input. The latent space has a fixed size and is
broadcast. The search is one map over the documents; items are broadcast in blocks of ITEMS, of which driver and tasks hold
one at a time, so that a benchmark of any size is searched whole. Nothing is sampled.

Defined cases. Null or empty texts match nothing. Items that are null or have no word are not searched. A
text shorter than a window is one window. Repeated ids are reported once an item, by their best window; rows without id
are reported under a null id. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import chunked, flat
from rasterloom.llm.lookup import Lookup, in_turn, release
from rasterloom.llm.toxicity import Tokens
from rasterloom.llm.words import mix

FEATURE_BITS, RANK, PASSAGE, LEAST = 14, 64, 32, 5
WINDOW, STRIDE, ITEMS = 32, 16, 1024
COSINE, DIRECT, LOOSE, ANSWER = 0.45, 0.75, 0.6, 0.8
#: A window whose words make up less than this part of an item's idf (of what a window can hold of it) can't confirm it.
SHARED = 0.25
SLICES = 64
#: Tasks whose sums are added up together first.
TOGETHER = 64
CHUNK, PARTS_CHUNK = 1 << 18, 1 << 22
#: Words of items by items that are held as a table; beyond that they are looked up by hash.
TABLE = 1 << 26
#: Words of surroundings that are compared with their items at once.
AT_ONCE = 1 << 21


def _features(w: Tokens) -> np.ndarray:
    return (w.hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _blocks(w: Tokens, values: np.ndarray, size: int, pad) -> tuple[np.ndarray, np.ndarray]:
    """Words' values in rows of `size`, no row across texts and the last of a text padded; and each row's text."""
    counts = w.counts()
    n = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), n)
    ahead = np.concatenate(([0], np.cumsum(n)[:-1])) * size - w.offsets[:-1]
    out = np.full(int(n.sum()) * size, pad, values.dtype)
    out[np.arange(len(values)) + np.repeat(ahead, counts)] = values
    return out.reshape(-1, size), text


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(total, SLICES)
    deal = np.full(SLICES, TaskContext.get().partitionId() // TOGETHER if TaskContext.get() else 0, np.int32)
    return pa.record_batch([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(deal), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "deal", "part"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by feature, and passages."""
    total, passages = np.zeros(1 << FEATURE_BITS), 0
    for batch in flat(batches):
        for _, raw in chunked(batch.column(0), CHUNK):
            w = Tokens(raw)
            passages += int((-(-w.counts() // PASSAGE)).sum())
            total += np.bincount(_features(w), minlength=len(total))
    if passages:
        yield _slices(np.append(total, passages))


def test_matrix() -> np.ndarray:
    return np.random.default_rng(4).standard_normal((1 << FEATURE_BITS, RANK)).astype(np.float32)


_TEST: list[np.ndarray] = []


def _sketch(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _TEST:
            _TEST.append(test_matrix())
        idf = shared.value
        none = len(idf)  # the feature of padding
        scaled = np.concatenate((_TEST[0] * idf[:, None], np.zeros((1, RANK), np.float32)))
        squares = np.append(idf**2, 0)
        total = np.zeros((RANK, none + 1))
        seen = False
        for batch in flat(batches):
            for _, raw in chunked(batch.column(0), 4 * CHUNK):
                w = Tokens(raw)
                f, _ = _blocks(w, _features(w), PASSAGE, none)
                if not len(f):
                    continue
                seen = True
                y = np.concatenate([scaled[f[i : i + 512]].sum(axis=1) for i in range(0, len(f), 512)])
                y = (y / np.maximum(squares[f].sum(axis=1), 1e-6)[:, None]).T
                flat_f = f.ravel()
                for j in range(RANK):
                    total[j] += np.bincount(flat_f, np.repeat(y[j], PASSAGE), none + 1)
        if seen:
            yield _slices((total[:, :none].T * idf[:, None]).astype(np.float32).ravel())

    return run


def _added(kind: str):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), kind).astype(np.float64) for x in table.column("part")]
        return pa.table({"slice": table.column("slice")[:1], "deal": table.column("deal")[:1], "part": pa.array([np.sum(parts, axis=0).astype(kind).tobytes()], pa.binary())})

    return run


def _total(rows: DataFrame, of, kind: str) -> np.ndarray | None:
    """The sum of the arrays that the tasks of a map give; None if there is none."""
    shape = "slice int, deal int, part binary"
    some = rows.mapInArrow(of, shape).groupBy("slice", "deal").applyInArrow(_added(kind), shape)
    parts = some.groupBy("slice").applyInArrow(_added(kind), shape).orderBy("slice").toArrow()
    if not parts.num_rows:
        return None
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in parts.column("part").combine_chunks()])


def gathered(texts: DataFrame) -> DataFrame:
    """The same rows in fewer partitions, without a shuffle: a task's fixed-size sum should be small against its input."""
    n = texts.rdd.getNumPartitions()
    return texts.coalesce(max(1, min(n, max(2 * texts.sparkSession.sparkContext.defaultParallelism, n // 16))))


def latent_space(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """(features, RANK) float32, the point of each feature, idf included, whitened; and the idf. None without any passage."""
    texts = gathered(docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")))
    counts = _total(texts, _count, "<f8")
    if counts is None:
        return None
    passages, counts = counts[-1], counts[:-1]
    idf = np.log((passages + 1) / (counts + 1)).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    c = _total(texts, _sketch(shared), "<f4").astype(np.float64).reshape(-1, RANK)
    core = test_matrix().astype(np.float64).T @ c
    core = (core + core.T) / 2
    shift = 1e-6 * np.abs(np.diag(core)).max() + 1e-12
    values, vectors = np.linalg.eigh(core + shift * np.eye(RANK))
    values = np.maximum(values, shift)
    left, single, _ = np.linalg.svd(c @ (vectors / np.sqrt(values)), full_matrices=False)
    spread = np.sqrt(np.maximum(single, single.max() * 1e-4))  # singular values of A
    return (idf[:, None] * left * (spread.mean() / spread)).astype(np.float32), idf


class Items:
    """Benchmark items: ids, word hashes, latent points, the places of the answer's words, and their words' vocabulary."""

    def __init__(self, ids: list[int], raw: list[bytes], space: np.ndarray, idf: np.ndarray, limits: tuple[float, float, float]):
        w = Tokens(raw)
        f = _features(w)
        points = space[f]
        self.ids, self.words, self.answers, sums = [], [], [], []
        for i, text in enumerate(raw):
            own = w.hashes[w.offsets[i] : w.offsets[i + 1]]
            if len(own):
                self.ids.append(ids[i])
                self.words.append(own.tolist())
                self.answers.append(_answer_words(text, len(own)))
                sums.append(points[w.offsets[i] : w.offsets[i + 1]].sum(axis=0))
        z = np.array(sums, np.float32).reshape(len(sums), RANK)
        self.points = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        self.vocabulary = np.unique(np.concatenate([np.array(x, np.uint64) for x in self.words])) if self.words else np.zeros(0, np.uint64)
        self.weights = idf[(self.vocabulary >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.short = self.lengths < LEAST
        self.least, keys, self.pairs = np.zeros(len(self.words)), [], []
        for j, x in enumerate(self.words):
            place = np.searchsorted(self.vocabulary, np.array(x, np.uint64))
            own, n = np.unique(place, return_counts=True)
            self.pairs.append(np.stack([own, np.full(len(own), j), n]))
            self.least[j] = SHARED * self.weights[own].sum() * min(1.0, WINDOW / len(x))
            if not self.short[j]:
                keys += [(k, j) for k in key_words(place, self.weights, self.answers[j], *limits)]
        of = np.array(sorted(keys), np.int64).reshape(-1, 2)
        self.key_at, self.key_items = np.searchsorted(of[:, 0], np.arange(len(self.vocabulary) + 1)), of[:, 1]
        self.pairs = np.concatenate(self.pairs, axis=1) if self.pairs else np.zeros((3, 0), np.int64)
        runs = [(run_hashes(np.array(self.words[j], np.uint64), int(self.lengths[j]))[0], j) for j in np.flatnonzero(self.short)]
        self.runs = {n: sorted((h, j) for h, j in runs if self.lengths[j] == n) for n in sorted(set(self.lengths[self.short].tolist()))}
        self.find = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "find_pair", "often")} | {"find": None}

    def ready(self) -> None:
        """Look-ups, built once in each worker that holds the items."""
        if self.find is not None:
            return
        self.find, self.table = Lookup(self.vocabulary), None
        word, item, n = self.pairs
        if len(self.vocabulary) * len(self.words) <= TABLE:
            self.table = np.zeros(len(self.vocabulary) * len(self.words), np.uint8)
            self.table[word * len(self.words) + item] = np.minimum(n, 255)
        else:
            hashes = mix((word.astype(np.uint64) << np.uint64(32)) + item.astype(np.uint64))
            order = np.argsort(hashes)
            self.find_pair, self.often = Lookup(hashes[order]), np.minimum(n, 255)[order]

    def times(self, word: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How often items hold words (places in the vocabulary); 255 for 255 and more."""
        if self.table is not None:
            return self.table[word.astype(np.int64) * len(self.words) + item]
        at = self.find_pair(mix((word.astype(np.uint64) << np.uint64(32)) + item.astype(np.uint64)))
        return np.where(at >= 0, self.often[at], 0)

    def keyed(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) wherever a row has a word of the item's key."""
        held = np.flatnonzero(known.ravel() >= 0)
        row, word = held // known.shape[1], known.ravel()[held]
        n = self.key_at[word + 1] - self.key_at[word]
        place = np.arange(int(n.sum())) + np.repeat(self.key_at[word] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)
        return np.repeat(row, n), self.key_items[place]

    def shared(self, known: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The idf of the words in rows (places in the vocabulary, -1 for none) that are words of the items."""
        out = np.zeros(len(row))
        width = known.shape[1]
        for i in range(0, len(row), AT_ONCE // width):
            some = slice(i, i + AT_ONCE // width)
            words = known[row[some]].ravel()
            held = np.flatnonzero(words >= 0)
            at, word = held // width, words[held]
            hit = np.flatnonzero(self.times(word, item[some][at]))
            out[some] = np.bincount(at[hit], self.weights[word[hit]], len(out[some]))
        return out

    def in_a_row(self, w: Tokens) -> list[tuple[int, int]]:
        """(place of the first word, item) wherever all words of a short item stand in a row."""
        found = []
        for n, own in self.runs.items():
            keys = np.array([h for h, _ in own], np.uint64)
            runs = run_hashes(w.hashes, n)
            first, last = np.searchsorted(keys, runs), np.searchsorted(keys, runs, "right")
            for i in np.flatnonzero((first < last) & (w.owner[: len(runs)] == w.owner[n - 1 :])).tolist():
                found += [(i, j) for _, j in own[first[i] : last[i]]]
        return found


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(31) + words[j : len(words) - n + 1 + j])
    return out


def key_words(own: np.ndarray, weights: np.ndarray, tail: int, direct: float, loose: float, answer: float) -> set[int]:
    """Words (places in the vocabulary) of which any text that confirms the item holds one: rarest first, more than may be missing."""

    def rarest(of: np.ndarray, share: float) -> set[int]:
        missing = len(of) - int(np.ceil(share * len(of) - 1e-9))
        word, n = np.unique(of, return_counts=True)
        order = np.argsort(-weights[word], kind="stable")
        return set(word[order[: int(np.searchsorted(np.cumsum(n[order]), missing, "right")) + 1]].tolist())

    def cost(words: set[int]) -> float:
        return float(np.exp(-weights[list(words)]).sum())

    return rarest(own, direct) | min(rarest(own, loose), rarest(own[len(own) - tail :], answer), key=cost)


def _answer_words(text: bytes, n: int) -> int:
    """How many words at an item's end are its last sentence, between 1 and half of the item."""
    parts = [p for p in re.split(rb"[.?!:]\s", text.strip()) if p.strip()]
    last = len(Tokens([parts[-1]]).hashes) if parts else 1
    return max(1, min(last, n // 2))


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Bits of the item's words on a longest common subsequence, by the bit-parallel recurrence; returned as a mask."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for x in text:
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


def _candidates(items: Items, w: Tokens, text: np.ndarray, known: np.ndarray, sums: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item) of the windows to compare with items, sorted, and the cosines of all; a window begins at its row."""
    windows, around = sums.copy(), [known]
    for k in range(1, WINDOW // STRIDE):
        same = text[k:] == text[:-k]
        windows[:-k][same] += sums[k:][same]
        later = np.full_like(known, -1)
        later[:-k][same] = known[k:][same]
        around.append(later)
    windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-12)
    near = windows @ items.points.T
    i, j = np.divmod(np.flatnonzero(near.ravel() >= cosine), len(items.words))
    long = ~items.short[j]
    i, j = i[long], j[long]
    held = items.shared(np.concatenate(around, axis=1), i, j) >= items.least[j]
    row, item = items.keyed(known)
    n = len(items.words)
    both = np.unique(np.concatenate((i[held] * n + j[held], row * n + item)))
    return both // n, both % n, near


def _compared(items: Items, w: Tokens, known: np.ndarray, a: np.ndarray, e: np.ndarray, item: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """(candidate, longest common subsequence as bits) of words a to e with items, where `least` of the item's words can be met."""
    ends = np.cumsum(e - a)
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
        size = (e - a)[first:last]
        which = np.repeat(np.arange(first, last), size)
        place = np.arange(len(which)) + np.repeat(a[first:last] - (np.cumsum(size) - size), size)
        some = known[place] >= 0
        which, place = which[some], place[some]
        often = items.times(known[place], item[which])
        which, place, often = which[often > 0], place[often > 0], often[often > 0].astype(np.int64)
        often[often == 255] = 1 << 40
        # each word counts as often as the item holds it at most
        _, at, n = np.unique((which - first) * len(items.vocabulary) + known[place], return_index=True, return_counts=True)
        most = np.bincount(which[at] - first, np.minimum(n, often[at]), last - first)
        bounds = np.searchsorted(which, np.arange(first, last + 1))
        for c in np.flatnonzero(most >= least * items.lengths[item[first:last]] - 1e-9).tolist():
            yield first + c, common_subsequence(items.words[item[first + c]], w.hashes[place[bounds[c] : bounds[c + 1]]].tolist())
        first = last


def _search(space_shared, blocks: list, limits: tuple[float, float, float, float]):
    cosine, direct, loose, answer = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = len(space_shared.value)
        space = np.concatenate((space_shared.value, np.zeros((1, RANK), np.float32)))
        for batch in flat(batches):
            out = []
            for at, raw in chunked(batch.column(1), PARTS_CHUNK if len(blocks) > 1 else CHUNK):
                w = Tokens(raw)
                f, text = _blocks(w, _features(w), STRIDE, none)
                if not len(f):
                    continue
                sums = np.concatenate([space[f[i : i + 8192]].sum(axis=1) for i in range(0, len(f), 8192)])
                first = np.searchsorted(text, text)
                for items in in_turn(blocks):
                    items.ready()
                    if not items.words:
                        continue
                    best: dict[tuple[int, int], tuple] = {}
                    known = items.find(w.hashes)
                    x, y, near = _candidates(items, w, text, _blocks(w, known, STRIDE, -1)[0], sums, cosine)
                    t = text[x]
                    word = (x - first[x]) * STRIDE
                    begin = w.offsets[t]
                    a = np.maximum(begin, begin + word - items.lengths[y])
                    e = np.minimum(w.offsets[t + 1], begin + word + WINDOW + items.lengths[y])
                    for c, bits in _compared(items, w, known, a, e, y, min(direct, loose)):
                        j = int(y[c])
                        size, tail = len(items.words[j]), items.answers[j]
                        share, kept = bits.bit_count() / size, (bits >> (size - tail)).bit_count() / tail
                        if share >= direct or (share >= loose and kept >= answer):
                            row = (share, kept, float(near[x[c], j]), int(word[c]))
                            if best.get((at + int(t[c]), j), (-1.0,)) < row:
                                best[at + int(t[c]), j] = row
                    for i, j in items.in_a_row(w):
                        own = int(w.owner[i])
                        place = i - int(w.offsets[own])
                        row = (1.0, 1.0, float(near[np.searchsorted(text, own) + place // STRIDE, j]), place)
                        if best.get((at + own, j), (-1.0,)) < row:
                            best[at + own, j] = row
                    out += [(i, items.ids[j], *row) for (i, j), row in best.items()]
            rows = np.array([o[0] for o in out], np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), *(pa.array([o[k] for o in out], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64())))], ["id", "item_id", "share", "answer", "cosine", "word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, direct: float = DIRECT, loose: float = LOOSE, answer: float = ANSWER) -> DataFrame:
    """(id, item_id, share, answer, cosine, word): documents and the items that they hold, one row a pair."""
    spark = docs.sparkSession
    found_space = latent_space(docs, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = "id long, item_id long, share double, answer double, cosine double, word long"
    if found_space is None:
        return spark.createDataFrame([], shape)
    space, idf = found_space
    space_shared = spark.sparkContext.broadcast(space)
    wanted = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    blocks: list = []
    some: list[tuple[int, bytes]] = []

    def close() -> None:
        blocks.append(spark.sparkContext.broadcast(Items([i for i, _ in some], [t for _, t in some], space, idf, (direct, loose, answer))))
        release(blocks[-1])
        some.clear()

    for row in wanted.toLocalIterator():
        some.append((row["i"], row["t"].encode()))
        if len(some) == ITEMS:
            close()
    if some:
        close()
    found = rows.mapInArrow(_search(space_shared, blocks, (cosine, direct, loose, answer)), shape)
    best = F.max(F.struct("share", "answer", "cosine", (-F.col("word")).alias("word")))
    return found.groupBy("id", "item_id").agg(best.alias("b")).select("id", "item_id", "b.share", "b.answer", "b.cosine", (-F.col("b.word")).alias("word"))
