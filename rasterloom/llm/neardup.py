"""MinHash near-dedup (7): a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

Method. Each text is the set of its distinct `width`-word shingles (64-bit hashes). Its signature holds `hashes`
symbols of 16 bits (MinHash). Two sets of similarity s differ in a symbol with probability 1 - s; `errors` is the least
number that a pair at the threshold exceeds with a probability below MISSED. The signature is split into errors // 2 + 1
chunks; by pigeonhole a pair within `errors` differing symbols has a chunk with at most one of them. Enumerating the one allowed error of a chunk (a
key for each symbol left out) therefore guarantees that every pair under the signature distance shares a key.

Plan. (1) One pass computes set size, a 128-bit set key and the signature; equal sets collapse to one vertex in
a partially aggregated group-by, so that copies never meet pairwise. (2) Keys of the vertices are grouped; keys
of one vertex only are dropped before signatures are joined on. Groups are swept in key order inside partitions. A sweep
emits spanning links of pairs within the signature distance, nearest first, never all pairs. Groups of a few blocks are
swept in pairs of blocks. Larger ones are swept in parts, each with the same few pivots of the group, and in pairs of
parts only if that leaves the group in several components. (3) The components of these links hold every candidate pair. Texts of their vertices only are
read again. A component of a few blocks is confirmed in pairs of blocks: |A & B| * 100 >= |A | B| * percent on full sets. In a larger
one the candidate links themselves are confirmed first, a join of pairs; only if true links leave it in
several pieces are its blocks dealt in pairs to confirm all pairs of different pieces. Every pair of a component is thus
confirmed or already linked through others, whatever the component's size. (4) Components of the confirmed links give
the classes. No step collects; hot keys and hubs are dealt by broadcasts of bounded size (components.py).

Defined cases. Null or empty texts and texts of white space: no shingles, linked with nothing. Fewer than `width`
words: the whole sequence is the one shingle. Each row is a document, also where ids repeat or are null; its component is
the smallest id that it reaches, which is null if it reaches null ids only. kept is whether both are equal, two nulls
included. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_IDS, chunked, cut, flat, stash
from rasterloom.llm.components import Forest, components, hub_size
from rasterloom.llm.words import Words, mix, shingles

HASHES, WIDTH, MISSED = 64, 5, 1e-5
#: Rows of a block: a larger key group or component is dealt as pairs of blocks.
BLOCK_SETS = 1024
#: Shingles of a block of full sets.
BLOCK_SHINGLES = 1 << 20
#: Parts up to which a group is dealt in pairs of parts at once, each row as often as there are parts.
PAIRED = 4
#: Vertices of a larger key group that are in each of its parts.
PIVOTS = 4

_RNG = np.random.Generator(np.random.PCG64(7))
_TURNS = _RNG.integers(1, 2**31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDED = _RNG.integers(0, 2**32, 512, dtype=np.uint32)

SIGNED = "id long, digest long, n_shingles long, k1 long, k2 long, sig binary"


def allowed_errors(percent: int, hashes: int = HASHES) -> int:
    """The least number of differing symbols that a pair at the threshold exceeds with a probability below MISSED."""
    p = 1 - percent / 100
    tail = 0.0
    for k in range(hashes, -1, -1):
        tail += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if tail >= MISSED:
            return k
    return 0


def distinct_sets(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets."""
    all_of, offsets = shingles(Words(raw), width)
    parts = [np.unique(all_of[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def signatures(values: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """(sets, hashes) uint16 symbols; sets without members get zeros."""
    out = np.zeros((len(offsets) - 1, hashes), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    x, at = (values >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
    for j in range(hashes):
        least = np.minimum.reduceat(x * _TURNS[j] + _ADDED[j], at)
        out[full, j] = (mix(least.astype(np.uint64) + np.uint64(j << 40)) >> np.uint64(48)).astype(np.uint16)
    return out


def _sign(width: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            for at, raw in chunked(batch.column(2)):
                values, offsets = distinct_sets(raw, width)
                sig = signatures(values, offsets, hashes)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(y))) for y in (mix(values ^ np.uint64(0x9E3779B97F4A7C15)), mix(values * np.uint64(0xD6E8FEB86659FD93)))]
                k1, k2 = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
                rest = [batch.column(c).slice(at, len(raw)) for c in (0, 1)]
                yield pa.record_batch([*rest, pa.array(np.diff(offsets)), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "digest", "n_shingles", "k1", "k2", "sig"])

    return run


def chunk_bounds(hashes: int, chunks: int) -> list[tuple[int, int]]:
    return [(hashes * c // chunks, hashes * (c + 1) // chunks) for c in range(chunks)]


def chunk_keys(sig: np.ndarray, chunks: int, allowed: int) -> np.ndarray:
    """(sets, keys): a key for each chunk and each way to leave out `allowed` (0 or 1) of its symbols."""
    n, hashes = sig.shape
    codes = mix(sig.astype(np.uint64) + (np.arange(hashes, dtype=np.uint64) << np.uint64(20)) + np.uint64(1))
    keys = []
    for c, (a, b) in enumerate(chunk_bounds(hashes, chunks)):
        total = codes[:, a:b].sum(axis=1, dtype=np.uint64)
        if not allowed:
            keys.append(mix(total + np.uint64(c)))
            continue
        keys += [mix(total - codes[:, j] + np.uint64((c << 8) + j)) for j in range(a, b)]
    return np.stack(keys, axis=1) if keys else np.zeros((n, 0), np.uint64)


def _key_rows(hashes: int, chunks: int, allowed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, hashes)
            keys = chunk_keys(sig, chunks, allowed)
            yield pa.record_batch([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), keys.shape[1]))], ["key", "node"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 15) -> Iterator[pa.Table]:
    """Sorted batches, joined so that no run of equal keys is divided; a table holds whole runs."""
    held: list[pa.RecordBatch] = []

    def cut_at(t: pa.Table) -> int:
        last = {k: t.column(k)[-1].as_py() for k in keys}
        same = np.ones(t.num_rows, bool)
        for k, v in last.items():
            same &= np.asarray(t.column(k)) == v
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            t = pa.Table.from_batches(held)
            if at := cut_at(t):
                yield t.slice(0, at)
                held = t.slice(at).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = np.asarray(t.column(k))
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def _near(hashes: int, errors: int):
    """For each run of (key, part): spanning links (a, b) of pairs within the signature distance, and as many (m, r) that
    link members to the least of their tree. Members of one piece are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "part"]):
            bounds = _bounds(t, ["key", "part"])
            ids, piece = np.asarray(t.column("node")), np.asarray(t.column("piece"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, hashes)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            close = two[((sig[two] != sig[two + 1]).sum(axis=1) <= errors) & (piece[two] != piece[two + 1])]
            out = [(close, close + 1, close + 1, close)]
            for a, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                forest, own, links = Forest.of_groups(piece[a : a + n]), sig[a : a + n], []
                before = forest.roots()
                for i in range(1, int(n)):
                    roots = forest.roots()[:i]
                    open_ = np.flatnonzero(roots != forest.find(i))
                    if not len(open_):
                        continue
                    apart = (own[open_] != own[i]).sum(axis=1)
                    near = np.flatnonzero(apart <= errors)
                    links += [(i, j) for j in open_[near[np.argsort(apart[near], kind="stable")]].tolist() if forest.join(i, j)]
                if links:
                    moved = forest.moved(before)
                    out.append((*(a + np.array(links).T), *(a + moved)))
            a, b, m, r = (ids[np.concatenate(x)] for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(m), pa.array(r)], ["a", "b", "m", "r"])

    return run


NEAR = "a long, b long, m long, r long"


def in_pairs_of_parts(df: DataFrame, id_: str) -> DataFrame:
    """df, whose groups have `parts` parts, with a column `part` of all pairs of parts: a row is repeated `parts` times.

    Every two rows of a group meet in at least one part.
    """
    df = df.withColumn("_own", F.pmod(F.xxhash64(id_), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.least(other, F.col("_own")) * F.col("parts") + F.greatest(other, F.col("_own")))
    return df.withColumn("part", F.explode(pair)).drop("_own", "parts")


def signature_links(reps: DataFrame, hashes: int, errors: int) -> tuple[DataFrame, DataFrame]:
    """Components (node, comp) of the vertices (node, sig) by signatures within the distance, and the links (a, b) that make them."""
    chunks = errors // 2 + 1
    keyed = stash(reps.select("node", "sig").mapInArrow(_key_rows(hashes, chunks, errors // chunks), "key long, node long"), "keys")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    signed = reps.select("node", "sig")

    def swept(met: DataFrame) -> DataFrame:
        met = met.join(signed, "node").select("key", "part", "node", "piece", "sig")
        return met.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_near(hashes, errors), NEAR)

    # keys of very many vertices are taken from a broadcast, others meet their sizes in a join
    hot = sizes.where(F.col("rows") > max(BLOCK_SETS, hub_size(int(keyed.count())))).select("key", F.col("rows").alias("_hot"))
    marked = keyed.join(F.broadcast(hot), "key", "left")
    sized = marked.where("_hot is null").drop("_hot").join(sizes.select("key", "rows"), "key").unionByName(marked.where("_hot is not null").withColumnRenamed("_hot", "rows"))
    sized = sized.withColumn("parts", F.ceil(F.col("rows") / BLOCK_SETS)).select("key", "node", "parts")
    links = stash(swept(in_pairs_of_parts(sized.where(F.col("parts") <= PAIRED), "node").withColumn("piece", F.col("node"))), "near")
    large = sizes.withColumn("parts", F.ceil(F.col("rows") / BLOCK_SETS)).where(F.col("parts") > PAIRED)
    if large.limit(1).count():
        wide = sized.where(F.col("parts") > PAIRED)
        own = wide.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("key", "part", "node")
        drawn = wide.groupBy("key", "parts").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(j)), "node"))["node"].alias(f"p{j}") for j in range(PIVOTS)))
        pivots = drawn.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.array_distinct(F.array(*(f"p{j}" for j in range(PIVOTS)))).alias("node")).withColumn("node", F.explode("node"))
        links = stash(links.union(swept(own.union(pivots).distinct().withColumn("piece", F.col("node")))), "near")
        pieces = cut(components(links, "m", "r").toDF("node", "piece"))
        # large groups that are still in several pieces
        placed = wide.join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node"))
        open_ = cut(placed.groupBy("key").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least <> most").select("key"))
        if not open_.limit(1).count():
            return pieces.toDF("node", "comp"), links
        links = stash(links.union(swept(in_pairs_of_parts(placed.join(open_, "key", "left_semi").select("key", "node", "piece", "parts"), "node"))), "near")
    return cut(components(links, "m", "r").toDF("node", "comp")), links


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            for at, raw in chunked(batch.column("text")):
                values, offsets = distinct_sets(raw, width)
                rest = [batch.column(c).slice(at, len(raw)) for c in ("node", "comp")]
                yield pa.record_batch([*rest, pa.array(np.diff(offsets)), pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "comp", "n", "members"])

    return run


def confirmed(sets: list[np.ndarray], piece: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(member, least of its tree) by pairs with 100 * |A & B| >= percent * |A | B|, checked on all members. Sets of one piece are linked already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.zeros(int(dense.max(initial=0)) + 1, bool)
    forest = Forest.of_groups(piece)
    before = forest.roots()
    for i in range(1, n):
        fits = np.flatnonzero((100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & (forest.roots()[:i] != forest.find(i)))
        if not len(fits):
            continue
        mine = dense[ends[i] : ends[i + 1]]
        seen[mine] = True
        # a few at once: as soon as one links, those of its tree need no check
        for at in range(0, len(fits), 64):
            some = [int(j) for j in fits[at : at + 64] if forest.find(int(j)) != forest.find(i)]
            if not some:
                continue
            both = np.add.reduceat(seen[np.concatenate([dense[ends[j] : ends[j + 1]] for j in some])], np.concatenate(([0], np.cumsum(sizes[some])[:-1])), dtype=np.int64)
            for j, common in zip(some, both, strict=True):
                if 100 * int(common) >= percent * int(sizes[i] + sizes[j] - common):
                    forest.join(i, j)
        seen[mine] = False
    return forest.moved(before).T.tolist()


def _confirm(percent: int):
    """Spanning links of each run of (comp, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["comp", "part"], 1 << 11):
            bounds, ids, piece, members = _bounds(t, ["comp", "part"]), np.asarray(t.column("node")), np.asarray(t.column("piece")), t.column("members").combine_chunks()
            a_out, b_out = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.slice(a, b - a)]
                    for i, j in confirmed(own, piece[a:b], percent):
                        a_out.append(ids[a + i])
                        b_out.append(ids[a + j])
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _confirm_pairs(percent: int):
    """Those of the pairs (a, b, one, other) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame, name: str, rows: int) -> DataFrame:
    """pairs with the set of one side's vertex; a hub's pairs are dealt to several tasks, with a copy of its set each."""
    other = "b" if side == "a" else "a"
    most = hub_size(rows)
    hubs = pairs.groupBy(side).agg(F.ceil(F.count("*") / most).alias("salts")).where("salts > 1")
    left = pairs.join(F.broadcast(hubs), side, "left").withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(other), "salts"))).drop("salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1))
    right = sets.select(F.col("node").alias(side), F.col("members").alias(name)).join(F.broadcast(hubs), side, "left").withColumn("salt", copies).drop("salts")
    return left.join(right, [side, "salt"]).drop("salt")


def confirmed_links(members: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that give the classes, of members (node, comp, n, members) and links (a, b) of candidates."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    large = cut(sizes.withColumn("parts", parts).where("parts > 1").select("comp", "parts"))
    # at most one in BLOCK_SETS of the vertices, or in BLOCK_SHINGLES of the shingles
    few = large.count() <= BROADCAST_IDS
    marked = members.join(F.broadcast(large) if few else large, "comp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))

    def swept(sets: DataFrame) -> DataFrame:
        dealt = in_pairs_of_parts(sets, "node").select("comp", "part", "node", "piece", "members")
        return dealt.repartition("comp", "part").sortWithinPartitions("comp", "part", "node").mapInArrow(_confirm(percent), "a long, b long")

    links = swept(marked.where(F.col("parts") <= PAIRED).withColumn("piece", F.col("node")))
    if not large.where(F.col("parts") > PAIRED).limit(1).count():
        return links
    sets = marked.where(F.col("parts") > PAIRED)
    asked = cut(near.select("a", "b").join(sets.select(F.col("node").alias("a")), "a", "left_semi").distinct())
    rows = asked.count()
    pairs = _with_sets(_with_sets(asked, "a", sets, "one", rows), "b", sets, "other", rows).select("a", "b", "one", "other")
    links = stash(links.union(pairs.mapInArrow(_confirm_pairs(percent), "a long, b long")), "confirmed")
    pieces = cut(components(links, "a", "b").toDF("node", "piece"))
    placed = sets.select("node", "comp").join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node"))
    open_ = cut(placed.groupBy("comp").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least <> most").select("comp"))
    if not open_.limit(1).count():
        return links
    again = sets.join(F.broadcast(open_) if few else open_, "comp", "left_semi").join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node"))
    return links.union(swept(again))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row; see the module's text for method and defined cases."""
    errors = allowed_errors(percent, hashes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("digest"), "text")
    signed = stash(texts.mapInArrow(_sign(width, hashes), SIGNED), "signed")
    # a vertex is a distinct set; its text is found again by id and digest
    classes = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.first("sig").alias("sig"), F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("of"))
    reps = stash(classes.withColumn("node", F.col("k1")), "reps")
    groups, candidates = signature_links(reps, hashes, errors)

    found = stash(groups.join(reps.select("node", "of.*"), "node"), "groups")
    few = found.count() <= BROADCAST_IDS
    again = texts.join(F.broadcast(found) if few else found, (texts["digest"] == found["digest"]) & texts["id"].eqNullSafe(found["id"])).select("node", "comp", "text")
    if texts.groupBy("id").count().where("count > 1").limit(1).count():  # rows of one id and text
        again = again.groupBy("node", "comp").agg(F.first("text").alias("text"))
    members = stash(again.mapInArrow(_sets(width), "node long, comp long, n long, members binary"), "sets")
    linked = components(confirmed_links(members, candidates, percent), "a", "b").toDF("node", "class")

    placed = reps.select("k1", "k2", "node", "least").join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = placed.groupBy("class").agg(F.min("least").alias("root"))
    roots = placed.join(least, "class").select("k1", "k2", "root")
    out = signed.select("id", "n_shingles", "k1", "k2").join(roots, ["k1", "k2"], "left")
    out = out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
