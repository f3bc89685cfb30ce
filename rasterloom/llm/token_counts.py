"""Token counts (9): edit-aware counting with kept segment trees of pre-tokens.

Method. build() finds a text's pre-tokens and their numbers of ids once and keeps, beside the text, a segment tree: a leaf
stands for LEAF neighbouring pre-tokens, and every node holds the sums of its part of the text: code points, ids,
pre-tokens. apply() takes edits (start, end, text: code points of the kept text replaced) against kept trees. Sums of code
points lead from a position to its leaf. Pre-tokens are found anew from the start of the leaf that holds the edit and its
context before it, until one begins where an old leaf begins behind the edit: what follows depends on the text behind
it only, hence is unchanged. Only these pre-tokens are encoded; they are dealt to the leaves that they replace, and
sums change on the paths to the root. So an edit costs its own length, a few leaves and the depth of the tree, and
nothing else of the document is read as pre-tokens or encoded. A leaf that has grown beyond FULL pre-tokens is
divided, for which the tree's sums alone are built anew. The context of an edit is two code points (a pre-token looks no
further past its end) and the length of the file's longest added token, which may begin at any of them.

Plan. build() is a map; its result is a table to be kept. apply() is a map over the kept table, without a shuffle when
edits are a column of it; edits in a table of their own are gathered by document and joined by id (with_edits), broadcast
if counted few. The result of apply() is such a table again, so that rounds of edits follow each other.

Defined cases. Null texts count as empty; null edits or a null list as none. Edits are taken in order of start, then
end, then text; positions are clipped to the text, and one that overlaps an earlier one is not applied (insertions at
the same place all apply). Null replacements are empty. One row for each input row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_IDS, flat, stash
from rasterloom.llm.pretokens import Encoder, encoder, text_chunks

LEAF, FULL = 64, 512
#: Pieces whose number of ids a worker remembers.
HELD_PIECES = 1 << 18
EDITS = "array<struct<start:long,end:long,text:string>>"
LENGTH, TOKENS, PIECES = 0, 1, 2
KEPT = "id long, text string, tree array<int>"

# fixed value: the byte-level pattern
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def pieces_of(text: str, own: Encoder) -> Iterator[tuple[int, int]]:
    """Spans of the pre-tokens of a short text."""
    at = 0
    for m in own.added.finditer(text) if own.added else ():
        yield from (p.span() for p in PATTERN.finditer(text[:m.start()], at))
        yield m.span()
        at = m.end()
    yield from (p.span() for p in PATTERN.finditer(text, at))


class Tree:
    """Sums (code points, ids, pre-tokens) in heap order: node 1 is the root, leaf i is node base + i."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums
        self.base = len(sums) // 2

    @classmethod
    def of(cls, leaves: np.ndarray) -> Tree:
        """The tree over (leaves, 3) sums."""
        base = 1 << max(0, len(leaves) - 1).bit_length()
        sums = np.zeros((2 * base, 3), np.int32)
        sums[base : base + len(leaves)] = leaves
        while base > 1:
            sums[base // 2 : base] = sums[base : 2 * base : 2] + sums[base + 1 : 2 * base : 2]
            base //= 2
        return cls(sums)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, where it begins) of the leaf that holds a position; (base, length of the text) behind the text."""
        if position >= self.sums[1, LENGTH]:
            return self.base, int(self.sums[1, LENGTH])
        node, begins = 1, 0
        while node < self.base:
            node *= 2
            left = int(self.sums[node, LENGTH])
            if position >= begins + left:
                begins += left
                node += 1
        return node - self.base, begins

    def put(self, leaf: int, sums: tuple[int, int, int]) -> None:
        """A leaf's new sums, and those of its path."""
        node = self.base + leaf
        change = np.array(sums, np.int32) - self.sums[node]
        while node:
            self.sums[node] += change
            node >>= 1

    def total(self, what: int) -> int:
        return int(self.sums[1, what])


def accepted(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """The edits that apply, in order."""
    found = []
    for e in edits or ():
        if e is not None and e["start"] is not None:
            a = min(max(0, e["start"]), length)
            b = min(max(a, e["end"] if e["end"] is not None else a), length)
            found.append((a, b, e["text"] or ""))
    out, free = [], 0
    for a, b, t in sorted(found):
        if a >= free:
            out.append((a, b, t))
            free = b
    return out


class Kept:
    """A document's text and tree; apply() edits both."""

    def __init__(self, text: str, tree: Tree, own: Encoder, size_of):
        self.text, self.tree, self.own, self.size_of = text, tree, own, size_of
        self.context = 2 + max([0, *map(len, own.added_ids)])
        self.encoded = 0

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """All edits, which are accepted ones; those close together are one region."""
        regions, n, i = [], len(edits), 0
        while i < n:
            first, at = self.tree.leaf_at(max(0, edits[i][0] - self.context)) if self.text else (0, 0)
            new, until = self.text[at : edits[i][0]] + edits[i][2], edits[i][1]
            i += 1
            reach = 0
            while True:
                reach = 2 * reach or 4 * self.context
                end = self.tree.leaf_at(min(until + reach, len(self.text)))[1]
                end = min(len(self.text), max(end, until) + self.context)
                # an edit whose context begins in what is read anew belongs to this region
                if i < n and (end == len(self.text) or self.tree.leaf_at(max(0, edits[i][0] - self.context))[1] < end):
                    new += self.text[until : edits[i][0]] + edits[i][2]
                    until = edits[i][1]
                    i += 1
                    reach = 0
                    continue
                found = self._scan(new, until, end)
                if found is not None:
                    regions.append((first, *found))
                    break
        self._replace(regions)
        parts, at = [], 0
        for a, b, t in edits:
            parts += [self.text[at:a], t]
            at = b
        self.text = "".join([*parts, self.text[at:]])

    def _scan(self, new: str, until: int, end: int) -> tuple[int, list[tuple[int, int, int]]] | None:
        """(first old leaf that stays, new pre-tokens before it); None if more text is needed to tell."""
        text, edge, closed = new + self.text[until:end], len(new), end == len(self.text)
        found = []
        for a, b in pieces_of(text, self.own):
            if a >= edge:
                leaf, begins = self.tree.leaf_at(until + a - edge)
                if begins == until + a - edge and leaf < self.tree.base:
                    return leaf, self._sized(text, found)
            if not closed and b + self.context > len(text):
                return None
            found.append((a, b))
        return (self.tree.base, self._sized(text, found)) if closed else None

    def _sized(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        self.encoded += len(spans)
        return [(b - a, self.size_of(text[a:b]), 1) for a, b in spans]

    def _replace(self, regions: list[tuple[int, int, list[tuple[int, int, int]]]]) -> None:
        over = any(len(new) > FULL * max(1, last - first) for first, last, new in regions)
        if over:  # leaves are divided
            leaves, parts, at = self.tree.sums[self.tree.base :], [], 0
            for first, last, new in regions:
                parts.append(leaves[at:first])
                parts.append(np.array([np.sum(new[j : j + LEAF], axis=0) for j in range(0, len(new), LEAF)], np.int32).reshape(-1, 3))
                at = last
            whole = np.concatenate([*parts, leaves[at:]])
            self.tree = Tree.of(whole[whole[:, PIECES] > 0])
            return
        for first, last, new in regions:
            if last == first:  # nothing is replaced: new pre-tokens join the leaf that they stand before
                new, last = [*new, tuple(map(int, self.tree.sums[self.tree.base + first]))], first + 1
            slots = last - first
            each = -(-len(new) // slots)
            for j in range(slots):
                part = new[j * each : (j + 1) * each]
                if part or self.tree.sums[self.tree.base + first + j].any():
                    self.tree.put(first + j, tuple(map(sum, zip(*part, strict=True))) if part else (0, 0, 0))


class _Sizes:
    """Numbers of ids of single pieces, remembered up to a bounded number."""

    def __init__(self, own: Encoder):
        self.own, self.held = own, {}

    def __call__(self, piece: str) -> int:
        size = self.held.get(piece)
        if size is None:
            if len(self.held) >= HELD_PIECES:
                self.held.clear()
            size = self.held[piece] = len(self.own.one(piece))
        return size


def trees(texts: list[str], own: Encoder) -> list[Tree]:
    """The trees of a chunk of texts."""
    p = own.pretokens(texts)
    counts = own.counts(p)
    n = np.diff(p.offsets)
    of_text = -(-n // LEAF)
    first = np.concatenate(([0], np.cumsum(of_text)))
    # the leaves of all texts, end to end
    begins = np.repeat(p.offsets[:-1], of_text) + (np.arange(first[-1]) - np.repeat(first[:-1], of_text)) * LEAF
    if not len(begins):
        return [Tree.of(np.zeros((0, 3), np.int32)) for _ in texts]
    leaves = np.stack([np.add.reduceat(x, begins) for x in (p.ends - p.starts, counts, np.ones_like(counts))], axis=1).astype(np.int32)
    return [Tree.of(leaves[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _flat_trees(built: list[Tree]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([t.sums.size for t in built]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([t.sums.ravel() for t in built]) if built else np.zeros(0, np.int32)))


def _build(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in flat(batches):
            for at, texts in text_chunks([x or "" for x in batch.column(1).to_pylist()]):
                rest = [c.slice(at, len(texts)) for c in batch.columns[2:]]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(texts), _flat_trees(trees(texts, own)), *rest], ["id", "text", "tree", *batch.schema.names[2:]])

    return run


def build(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, text, tree): the table to keep; with edits_col also the documents' first edits, as `edits`."""
    edits = [F.col(edits_col).cast(EDITS).alias("edits")] if edits_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *edits)
    return rows.mapInArrow(_build(tokenizer), f"{KEPT}, edits {EDITS}" if edits_col else KEPT)


def _apply(tokenizer: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        sizes = _Sizes(own)
        for batch in flat(batches):
            kept = batch.column(2)
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts, edits = some.column(1).to_pylist(), some.column(3).to_pylist()
                docs, rows = [], []
                for j, (text, own_edits) in enumerate(zip(texts, edits, strict=True)):
                    tree = Tree(np.array(kept[i + j].values, np.int32).reshape(-1, 3))
                    before = tree.total(TOKENS), tree.total(PIECES)
                    doc = Kept(text, tree, own, sizes)
                    mine = accepted(own_edits, len(text))
                    if mine:
                        doc.apply(mine)
                    docs.append(doc)
                    rows.append((before[0], len(mine), doc.tree.total(TOKENS), before[1], doc.encoded))
                now = [pa.array([d.text for d in docs]), _flat_trees([d.tree for d in docs])] if whole else []
                yield pa.record_batch([some.column(0), *now, *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], ["id", *(["text", "tree"] if whole else []), *COUNTS])

    return run


COUNTS = ["n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]


def apply(kept: DataFrame, tokenizer: str, whole: bool = True) -> DataFrame:
    """Kept rows (id, text, tree) with a column `edits`: text and tree after them, and counts; with whole=False counts only.

    n_tokens and n_pretokens are those before the edits, n_tokens_edited that after, n_reencoded the pre-tokens encoded.
    """
    rows = kept.select("id", "text", "tree", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(_apply(tokenizer, whole), (KEPT if whole else "id long") + "".join(f", {c} long" for c in COUNTS))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded): trees are built and kept in the shared folder, then edited."""
    if not edits_col:
        docs, edits_col = docs.select(id_col, text_col, F.lit(None).cast(EDITS).alias("_edits")), "_edits"
    return apply(stash(build(docs, tokenizer, id_col, text_col, edits_col), "trees"), tokenizer, whole=False)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", name: str = "edits") -> DataFrame:
    """docs (or kept rows) with a column of their edits from a table (id_col, start, end, text); edits without id go unused."""
    own = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_edited")).agg(F.collect_list(F.struct("start", "end", "text")).alias(name))
    if edits.count() <= BROADCAST_IDS // 10:
        own = F.broadcast(own)
    return docs.join(own, docs[id_col] == own["_edited"], "left").drop("_edited")
