"""Colour quantisation: packed histograms, palettes, nearest colours, k-means.

Nearest colours are found against a bounded palette held as a literal array, so that no join is needed and pixels are
neither shuffled nor repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import bucket_level, packed
from rasterloom.operators.regions import CHANNELS, matched

MOST_COLORS = 512


def histogram(px: DataFrame, bits: int = 5) -> DataFrame:
    """(image_id, key, n) of 8-bit channels."""
    return px.groupBy("image_id", packed(*map(F.col, CHANNELS), bits).alias("key")).agg(F.count("*").alias("n"))


def peaks(px: DataFrame, bits: int = 5, share: float = 0.0002, least: int = 64) -> DataFrame:
    """(image_id, key, n, total): buckets of at least max(least, share of the image's pixels)."""
    counts = histogram(px, bits)
    totals = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    return matched(counts, totals, "image_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("total") * share)))


def coverage(px: DataFrame, bits: int = 5, share: float = 0.0002, least: int = 64) -> DataFrame:
    """(image_id, n_peaks, coverage): which part of an image its peaks hold."""
    return peaks(px, bits, share, least).groupBy("image_id").agg(F.count("*").alias("n_peaks"), (F.sum("n") / F.first("total")).alias("coverage"))


def _distance(a: Column, b: Column) -> Column:
    return sum(((a[c] - b[c]) ** 2 for c in CHANNELS), F.lit(0.0))


def palette(px: DataFrame, bits: int = 5, share: float = 0.0002, least: int = 64, apart: float = 0.0, cover: float = 0.9) -> DataFrame:
    """(image_id, colors): peaks by count, each accepted if farther than `apart` from all accepted ones.

    Images with fewer than 2 or more than 512 peaks, or with less than `cover` of their pixels in peaks, have none (they
    take another route). At most 512 colours an image are folded in order.
    """
    color = F.struct(*(bucket_level(F.col("key"), i, bits).alias(c) for i, c in enumerate(CHANNELS)))
    listed = peaks(px, bits, share, least).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key", color.alias("c")))).alias("all"), F.sum("n").alias("n"), F.first("total").alias("total"))
    listed = listed.where(F.size("all").between(2, MOST_COLORS) & (F.col("n") / F.col("total") >= cover))
    kept = F.aggregate("all", F.array().cast("array<struct<r:double,g:double,b:double>>"), lambda acc, x: F.when(F.exists(acc, lambda c: _distance(c, x["c"]) <= apart * apart) & F.lit(apart > 0), acc).otherwise(F.concat(acc, F.array(x["c"]))))
    return listed.select("image_id", kept.alias("colors"))


def nearest(colors: Column, r: Column, g: Column, b: Column) -> Column:
    """The index of the nearest colour of an array, the first among equals."""
    here = {"r": r, "g": g, "b": b}
    scored = F.transform(colors, lambda c, i: F.struct(_distance(c, here).alias("d"), i.alias("i")))
    return F.array_min(scored)["i"]


def lookup(px: DataFrame, palettes: DataFrame, bits: int = 5) -> DataFrame:
    """px (8-bit channels) with label: its bucket's nearest colour of its image's palette; images without palette are left out.

    Buckets, of which an image has 2 ** (3 * bits) at most, are matched with the palette; pixels look theirs up.
    """
    held = matched(histogram(px, bits), palettes, "image_id")
    table = held.select("image_id", "key", nearest(F.col("colors"), *(bucket_level(F.col("key"), i, bits) for i in range(3))).alias("label"))
    return px.withColumn("key", packed(*map(F.col, CHANNELS), bits)).join(table.hint("merge"), ["image_id", "key"]).drop("key")


def centroid_array(centroids: np.ndarray) -> Column:
    return F.array(*(F.struct(*(F.lit(float(v)).alias(c) for c, v in zip(CHANNELS, row, strict=True))) for row in centroids))


def assign(px: DataFrame, centroids: np.ndarray) -> DataFrame:
    """px with cluster: the nearest centroid, the smallest number among equals."""
    return px.withColumn("cluster", nearest(centroid_array(centroids), *map(F.col, CHANNELS)))


def lloyd_step(px: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one becomes the zero vector. One aggregation of at most k rows."""
    rows = assign(px, centroids).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in CHANNELS)).collect()
    out = np.zeros_like(centroids)
    for row in rows:
        out[row["cluster"]] = [row[c] for c in CHANNELS]
    return out


def seeds(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeds; fewer than k if the sample has fewer distinct points."""
    rng = np.random.default_rng(seed)
    chosen = [sample[int(rng.integers(len(sample)))]]
    left = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and left.sum() > 0:
        chosen.append(sample[int(rng.choice(len(sample), p=left / left.sum()))])
        left = np.minimum(left, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def kmeans(px: DataFrame, k: int = 20, rounds: int = 16, seed: int = 7, sample: int = 20_000) -> tuple[np.ndarray, DataFrame]:
    """Centroids and px with cluster. Seeds come from at most `sample` pixels in hash order; Lloyd's rounds see all pixels.

    Of many pixels, tasks hand on about twice the sample in all, by a threshold of the hash.
    """
    order = F.xxhash64("image_id", "y", "x")
    n = px.count()
    some = px.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * sample / n))) if n > 2 * sample else px
    rows = some.orderBy(order, *CHANNELS).limit(sample).select(*CHANNELS).collect()
    if not rows:
        return np.zeros((0, 3)), px.withColumn("cluster", F.lit(None).cast("int"))
    centroids = seeds(np.array([[float(r[c]) for c in CHANNELS] for r in rows]), k, seed)
    for _ in range(rounds):
        centroids = lloyd_step(px, centroids)
    return centroids, assign(px, centroids)
