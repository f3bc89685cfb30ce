"""Embedding near-dedup (1): inverted lists with product-quantised residuals, bounded search, exact cosine rerank.

Method. Vectors are compared on the unit sphere, where cosine >= t means a distance of at most r = sqrt(2 - 2 t). A coarse
k-means quantiser deals each vector to the list of its nearest centroid; its residual is coded by one of CODES
centroids in each of SUBSPACES subspaces, and the error of that code is kept. A query probes every list that can hold a
partner: a partner lies within r of the query and on its list's side of the bisecting plane between the query's own
centroid and the list's, so that a list is probed iff the query's distance to that half-space is at most r. In a
probed list, distances to all codes come from a table per subspace; a code is a candidate iff its distance is at most
r plus its own coding error. Both bounds are exact: no partner is lost, whatever the data (recall is 1). Candidates
are confirmed by the cosine of the raw vectors in double precision. The index sees the first D components of a unit
vector, D being the most frequent length (MOST_DIM at most): leaving components out brings vectors nearer only, so that
the bounds hold for longer ones, and one long vector makes no other larger.

Plan. Equal vectors of a label collapse to one vertex with a multiplicity (partial aggregation), so that copies never
meet pairwise. Quantisers are fitted on the driver on at most SAMPLE vectors, a sample by hash, of which each task hands on
its expected share only; all rows are indexed. Rows and probes are dealt by (label, dimension, list), large lists as pairs of blocks; a task returns link
counts by vector and spanning links only, never all pairs. Components come from the spanning links.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
link with nothing. Vectors of different length don't link. Each row is a vector of its own, also where ids repeat or are
null; its component is the smallest id that it reaches, null if it reaches null ids only. kept is whether both are equal,
two nulls included. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import flat, stash
from rasterloom.llm.components import Forest, components
from rasterloom.llm.neardup import _bounds, _runs

SAMPLE, LISTS, SUBSPACES, CODES, ROUNDS = 16_384, 1024, 8, 256, 8
#: Rows of a block of a list, as partners or as queries; also the rows that a list of the largest label should have,
#: since a query is sent to each list that it probes.
BLOCK = 2048
#: Components that the index sees at most.
MOST_DIM = 2048
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids of x; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 8192] @ centres.T).argmin(axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, int)])


class Index:
    """The quantisers: centres (lists, D) and codebooks (SUBSPACES, codes, D / SUBSPACES)."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centres = kmeans(sample, lists, ROUNDS, 11)
        rest = (sample - self.centres[nearest(sample, self.centres)]).reshape(len(sample), SUBSPACES, -1)
        self.books = np.stack([kmeans(np.ascontiguousarray(rest[:, m]), CODES, ROUNDS, 12 + m) for m in range(SUBSPACES)])
        between = np.sqrt(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2))
        self.between = np.maximum(between, 1e-300)

    def code(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error) of each unit vector."""
        own = nearest(units, self.centres)
        rest = (units - self.centres[own]).reshape(len(units), SUBSPACES, -1)
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, m]), self.books[m]) for m in range(SUBSPACES)], axis=1)
        error = np.sqrt(sum(((rest[:, m] - self.books[m][codes[:, m]]) ** 2).sum(axis=1) for m in range(SUBSPACES)))
        return own, codes.astype(np.uint8), error

    def probes(self, units: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """(vectors, lists) whether a list can hold a partner within the radius."""
        d = (self.centres**2).sum(axis=1) - 2 * units @ self.centres.T
        gap = (d - d[np.arange(len(units)), own][:, None]) / (2 * self.between[own])
        gap[np.arange(len(units)), own] = 0
        return gap <= radius + _SLACK

    def distances(self, queries: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query vectors to the codes of one list, by table look-up."""
        rest = (queries - self.centres[where]).reshape(len(queries), SUBSPACES, -1)
        out = np.zeros((len(queries), len(codes)))
        for m in range(SUBSPACES):
            book = self.books[m]
            table = (rest[:, m] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None] - 2 * rest[:, m] @ book.T
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in an array<double> column."""
    offsets = np.asarray(column.offsets)
    sizes, flat_ = np.diff(offsets), np.asarray(column.values)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat_[offsets[rows][:, None] + np.arange(dim)[None]]


def projected(units: np.ndarray, dim: int) -> np.ndarray:
    """The first `dim` components, zeros where there are fewer."""
    if units.shape[1] >= dim:
        return units[:, :dim]
    return np.concatenate((units, np.zeros((len(units), dim - units.shape[1]))), axis=1)


def _packed(raw: np.ndarray) -> list[bytes]:
    """Rows as bytes: 32-bit where that loses nothing."""
    short = raw.astype(np.float32)
    exact = (short.astype(np.float64) == raw).all(axis=1)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(short, raw, exact, strict=True)]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows], np.float64).reshape(-1, dim)


def units_of(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _deal(shared, radius: float):
    """A row for each vector in its own list (role 0), and one for each list that it probes (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in flat(batches):
            for at in range(0, batch.num_rows, 1024):
                for rows, raw in _matrices(batch.slice(at, 1024).column("v")):
                    part = batch.slice(at, 1024).take(pa.array(rows))
                    units = projected(units_of(raw), index.dim)
                    own, codes, error = index.code(units)
                    row, lists = np.nonzero(index.probes(units, own, radius))
                    take = pa.array(np.concatenate((np.arange(len(own)), row)))
                    both = part.select(["label", "dim", "node", "copies"]).take(take)
                    role = np.concatenate((np.zeros(len(own), np.int32), np.ones(len(row), np.int32)))
                    vec = pa.array(_packed(raw), pa.binary()).take(take)
                    code = pa.array([c.tobytes() + np.float64(e).tobytes() for c, e in zip(codes, error, strict=True)] + [b""] * len(row), pa.binary())
                    yield pa.record_batch([*both.columns, pa.array(np.concatenate((own, lists)).astype(np.int32)), pa.array(role), vec, code], ["label", "dim", "id", "copies", "list", "role", "vec", "code"])

    return run


DEALT = "label long, dim int, id long, copies long, list int, role int, vec binary, code binary"
_KEYS = ["label", "dim", "list", "part"]


def _search(shared, threshold: float, radius: float):
    """Link counts (a = vector, b null, n) and spanning links (a, b, n null) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for t in _runs(batches, _KEYS, 1 << 12):
            bounds = _bounds(t, _KEYS)
            ids, copies, role, lists = (np.asarray(t.column(c)) for c in ("id", "copies", "role", "list"))
            packed, code, dims = t.column("vec").to_pylist(), t.column("code").to_pylist(), np.asarray(t.column("dim"))
            a_out, b_out, n_out = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                held, asking = a + np.flatnonzero(role[a:b] == 0), a + np.flatnonzero(role[a:b] == 1)
                if not len(held) or not len(asking):
                    continue
                vec = _unpacked(packed[a:b], int(dims[a]))
                both = np.frombuffer(b"".join(code[i] for i in held), np.uint8).reshape(-1, SUBSPACES + 8)
                codes, error = both[:, :SUBSPACES], np.ascontiguousarray(both[:, SUBSPACES:]).view(np.float64).ravel()
                norm = np.sqrt((vec[held - a] ** 2).sum(axis=1))
                names, place = np.unique(ids[a:b], return_inverse=True)
                forest = Forest(len(names))
                for q in range(0, len(asking), 256):
                    some = asking[q : q + 256]
                    near = index.distances(projected(units_of(vec[some - a]), index.dim), int(lists[a]), codes) <= radius + error + _SLACK
                    near &= ids[some][:, None] != ids[held][None]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    own = np.sqrt((vec[some - a] ** 2).sum(axis=1))
                    if len(i) * 8 > near.size:  # dense: one product
                        cosine = (vec[some - a] @ vec[held - a].T)[i, j] / (own[i] * norm[j])
                    else:
                        cosine = np.einsum("ij,ij->i", vec[some[i] - a], vec[held[j] - a]) / (own[i] * norm[j])
                    good = cosine >= threshold
                    i, j = i[good], j[good]
                    n = np.bincount(i, copies[held[j]], len(some))
                    for x in np.flatnonzero(n):
                        a_out.append(ids[some[x]])
                        b_out.append(None)
                        n_out.append(int(n[x]))
                    left, right = place[some[i] - a], place[held[j] - a]
                    while len(left):
                        roots = forest.roots()
                        apart = roots[left] != roots[right]
                        left, right = left[apart], right[apart]
                        for x, y in zip(left[:256], right[:256], strict=True):
                            if forest.join(int(x), int(y)):
                                a_out.append(names[x])
                                b_out.append(names[y])
                                n_out.append(None)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (a_out, b_out, n_out)], ["a", "b", "n"])

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row; see the module's text."""
    spark = vectors.sparkSession
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = rows.withColumn("good", F.coalesce(whole, F.lit(False))).withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "v")))
    # a vertex is a distinct vector of a label
    classes = keyed.where("good").groupBy("label", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stash(classes.withColumn("dim", F.size("v")).withColumn("node", F.col("h1")), "vectors")
    shape = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    often = shape.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not often:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = -(-min(often[0]["dim"], MOST_DIM) // SUBSPACES) * SUBSPACES
    fitting = classes.where(F.col("dim") == often[0]["dim"])
    if often[0]["n"] > 2 * SAMPLE:  # about twice the sample, so that tasks don't hand on SAMPLE rows each
        fitting = fitting.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * 2 * SAMPLE / often[0]["n"]))
    sample = fitting.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    index = Index(projected(units_of(next(_matrices(sample))[1]), dim), max(1, min(LISTS, math.ceil(often[0]["most"] / BLOCK))))
    shared = spark.sparkContext.broadcast(index)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    dealt = stash(classes.select("label", "dim", "node", "copies", "v").mapInArrow(_deal(shared, radius), DEALT), "dealt")

    sizes = dealt.groupBy("label", "dim", "list").agg(F.ceil(F.count_if(F.col("role") == 0) / BLOCK).alias("held"), F.ceil(F.count_if(F.col("role") == 1) / BLOCK).alias("asking")).where("held > 0")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, F.col("held")).otherwise(F.col("asking")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.greatest("asking", F.lit(1))).otherwise(F.col("held")) - 1)
    parts = F.transform(others, lambda o: F.when(F.col("role") == 0, F.col("own") * F.col("asking") + o).otherwise(o * F.col("asking") + F.col("own")))
    met = dealt.join(sizes, ["label", "dim", "list"]).withColumn("own", own).withColumn("part", F.explode(parts)).drop("own", "held", "asking")
    found = stash(met.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_search(shared, threshold, radius), "a long, b long, n long"), "links")

    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null"), "a", "b").toDF("node", "class")
    placed = classes.select("label", "h1", "h2", "node", "copies", "least").join(counts, "node", "left").join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    roots = placed.groupBy("class").agg(F.min("least").alias("root"))
    reps = placed.join(roots, "class").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root")
    out = keyed.select("id", "good", "label", "h1", "h2").join(reps, ["label", "h1", "h2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("root")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
