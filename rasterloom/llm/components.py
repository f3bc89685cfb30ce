"""Connected components of a link table, without collecting it: large-star / small-star rounds of joins.

A vertex of many links (a hub) has its least neighbour from a partially aggregated group-by, which no number of links
overloads; the join back to its links takes hubs from a broadcast, so that they are never dealt to one task. A hub has more
than HUB links and more than one in MOST_HUBS of all, which bounds the broadcast to 2 * MOST_HUBS rows of two ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut

#: Rounds double the reach, so that this many are never used up; a link table that needs more raises an error.
MOST_ROUNDS = 60
HUB, MOST_HUBS = 256, 500_000


def hub_size(rows: int) -> int:
    """Rows of one key above which it is a hub among so many rows."""
    return max(HUB, rows // MOST_HUBS)


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star round. edges (u, v) with u > v, distinct. Links each neighbour of a vertex to the least of them."""
    seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    hubs = least.where(F.col("n") > hub_size(rows)).select("u", "m")
    marked = seen.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("m is null").drop("m").join(least.where(F.col("n") <= hub_size(rows)).select("u", "m"), "u")
    joined = marked.where("m is not null").union(rest)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each vertex of the links a - b with the least vertex that it reaches. Any direction, repeats and loops allowed.

    A row is returned only for vertices that have a link to another vertex.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    now, before = cut(now), None
    rows = now.count()
    for _ in range(MOST_ROUNDS):
        now = cut(_star(_star(now, True, rows), False, rows))
        mark = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        rows = mark[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components: no fixed point after {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


class Forest:
    """Union-find over 0..n-1 with the least member as root: what a task uses to emit spanning links only."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    @classmethod
    def of_groups(cls, own: np.ndarray) -> Forest:
        """Members of equal `own` are joined from the start."""
        out = cls(len(own))
        _, first, at = np.unique(own, return_index=True, return_inverse=True)
        out.parent = first[at]
        return out

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = q
                return q
            p = q

    def moved(self, before: np.ndarray) -> np.ndarray:
        """(2, n): former roots that have a root now, and that root. As many as there were joins."""
        now = self.roots()
        at = np.flatnonzero((before == np.arange(len(now))) & (now != before))
        return np.stack([at, now[at]])

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
