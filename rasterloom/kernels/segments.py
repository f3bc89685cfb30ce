"""Segmentation of one image: routes to a label image, and the merges that follow. Labels are dense from 0."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from rasterloom.kernels import conv, masks


def dense(labels: np.ndarray) -> np.ndarray:
    if labels.size and labels.min() >= 0 and labels.max() <= 4 * labels.size:  # few small numbers need no sort
        return (np.cumsum(np.bincount(labels.ravel()) > 0) - 1)[labels]
    return np.unique(labels, return_inverse=True)[1].reshape(labels.shape)


class Window(NamedTuple):
    """A region's box in the image, with its mask there and where its pixels lie, in scan order."""

    label: int
    y0: int
    x0: int
    mask: np.ndarray
    ys: np.ndarray
    xs: np.ndarray

    def plane(self, whole: np.ndarray) -> np.ndarray:
        """The same box of another plane."""
        return whole[self.y0 : self.y0 + self.mask.shape[0], self.x0 : self.x0 + self.mask.shape[1]]


def windows(labels: np.ndarray, margin: int = 0) -> Iterator[Window]:
    """Each label's box, by one sort of the pixels, so that work on regions grows with their own sizes. Negative labels have none."""
    h, w = labels.shape
    flat = labels.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[np.searchsorted(flat[order], 0) :]
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    for part in np.split(order, first[1:]) if len(order) else ():
        ys, xs = np.divmod(part, w)
        i = int(flat[part[0]])
        y0, y1 = max(0, int(ys[0]) - margin), min(h, int(ys[-1]) + 1 + margin)
        x0, x1 = max(0, int(xs.min()) - margin), min(w, int(xs.max()) + 1 + margin)
        yield Window(i, y0, x0, labels[y0:y1, x0:x1] == i, ys, xs)


def cores(labels: np.ndarray, radius: int) -> np.ndarray:
    """Pixels all of whose neighbours within so many steps along rows and columns lie in the image and have their label."""
    inside = np.ones(labels.shape, bool)
    for _ in range(radius):
        inside = np.logical_and.reduce([(masks.shifted(labels, dy, dx, -1) == labels) & masks.shifted(inside, dy, dx, False) for dy, dx in masks.CROSS])
    return inside


def touching(labels: np.ndarray) -> np.ndarray:
    """Distinct pairs (a < b) of labels that share a pixel edge, in order."""
    a = np.concatenate((labels[:, :-1].ravel(), labels[:-1].ravel()))
    b = np.concatenate((labels[:, 1:].ravel(), labels[1:].ravel()))
    a, b = a[a != b], b[a != b]
    if not len(a):
        return np.zeros((0, 2), int)
    least, many = int(labels.min()), int(labels.max()) - int(labels.min()) + 1
    return np.stack(np.divmod(np.unique((np.minimum(a, b) - least) * many + np.maximum(a, b) - least), many), axis=1) + least


def means(labels: np.ndarray, values: np.ndarray) -> np.ndarray:
    n = np.bincount(labels.ravel())
    flat = values.reshape(labels.size, -1)
    return np.stack([np.bincount(labels.ravel(), flat[:, c]) for c in range(flat.shape[1])], axis=1) / np.maximum(n, 1)[:, None]


def merge_similar(labels: np.ndarray, rgb255: np.ndarray, threshold: float, rounds: int = 4, protect: float = 0.0) -> np.ndarray:
    """Join touching regions whose mean colours differ by at most the threshold, nearest pairs first, in rounds.

    Means and distances hold for a round. Order is total (distance, then labels). With protect > 0 a pair is left alone
    if a root of it had a mean saturation above protect when the round began.
    """
    labels = dense(labels)
    for _ in range(rounds):
        colour = means(labels, rgb255)
        safe = np.zeros(len(colour), bool)
        if protect > 0:
            safe = means(labels, rgb255.max(axis=2) - rgb255.min(axis=2))[:, 0] > protect
        pairs = touching(labels)
        d = np.sqrt(((colour[pairs[:, 0]] - colour[pairs[:, 1]]) ** 2).sum(axis=1))
        order = np.lexsort((pairs[:, 1], pairs[:, 0], d))
        root = list(range(len(colour)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        changed = False
        for a, b in pairs[order[d[order] <= threshold]]:
            a, b = find(int(a)), find(int(b))
            if a != b and not safe[a] and not safe[b]:
                root[b] = a
                changed = True
        if not changed:
            break
        labels = dense(np.array([find(i) for i in range(len(root))])[labels])
    return labels


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int, sample: int = 150_000) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, assignment); seeds by squared distance, fixed rounds, an empty cluster at the zero vector."""
    rng = np.random.default_rng(seed)
    own = points if len(points) <= sample else points[np.sort(rng.choice(len(points), sample, replace=False))]
    chosen = [own[int(rng.integers(len(own)))]]
    left = ((own - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and left.sum() > 0:
        chosen.append(own[int(rng.choice(len(own), p=left / left.sum()))])
        left = np.minimum(left, ((own - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)

    def nearest(x: np.ndarray) -> np.ndarray:
        half = (centres**2).sum(axis=1) / 2
        return np.concatenate([(half - x[i : i + 65536] @ centres.T).argmin(axis=1) for i in range(0, len(x), 65536)])

    for _ in range(rounds):
        at = nearest(own)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, own[:, c], len(centres)) for c in range(own.shape[1])], axis=1)
        centres = sums / np.maximum(n, 1)[:, None]
    return centres, nearest(points)


def by_colors(rgb: np.ndarray, k: int = 20, rounds: int = 16, smooth: float = 1.6, threshold: float = 12.0, second: float = 10.0, passes: int = 4, protect: float = 0.0, seed: int = 7) -> np.ndarray:
    """Clusters of smoothed Lab colour, merged as clusters, split into components, merged again."""
    soft = np.stack([conv.gaussian(rgb[..., c], smooth) for c in range(3)], axis=-1)
    _, own = kmeans(conv.lab(np.clip(soft, 0, 1)).reshape(-1, 3), k, rounds, seed)
    labels = merge_similar(own.reshape(rgb.shape[:2]), rgb * 255, threshold, passes, protect)
    return merge_similar(masks.components(labels), rgb * 255, second, 3, protect)


def by_flat_colors(rgb: np.ndarray, bits: int = 5, share: float = 0.0002, cover: float = 0.9, apart: float = 0.0, smooth: float = 0.0, threshold: float = 12.0) -> np.ndarray | None:
    """Nearest colours of a palette of frequent buckets, as components; None if few buckets don't cover the image."""
    soft = np.stack([conv.gaussian(rgb[..., c], smooth) for c in range(3)], axis=-1)
    top = (np.clip(soft, 0, 1) * 255).astype(np.uint8) >> (8 - bits)
    key = (top[..., 0].astype(int) << 2 * bits) | (top[..., 1].astype(int) << bits) | top[..., 2]
    n = np.bincount(key.ravel(), minlength=1 << 3 * bits)
    peak = np.flatnonzero(n >= max(64, int(share * key.size)))
    if not 2 <= len(peak) <= 512 or n[peak].sum() < cover * key.size:
        return None
    parts = np.stack((peak >> 2 * bits, peak >> bits & (1 << bits) - 1, peak & (1 << bits) - 1), axis=1)
    centre = (parts + 0.5) * (1 << (8 - bits)) / 255
    kept: list[np.ndarray] = []
    for i in np.lexsort((peak, -n[peak])):
        if not kept or apart <= 0 or min(((c - centre[i]) ** 2).sum() for c in kept) > apart**2:
            kept.append(centre[i])
    # buckets, not pixels, are matched with the palette
    palette, held = np.array(kept), np.flatnonzero(n)
    parts = np.stack((held >> 2 * bits, held >> bits & (1 << bits) - 1, held & (1 << bits) - 1), axis=1)
    table = np.zeros(len(n), int)
    table[held] = _nearest((parts + 0.5) * (1 << (8 - bits)) / 255, palette)
    return merge_similar(masks.components(table[key]), rgb * 255, threshold, 3)


def _nearest(points: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The first nearest colour of each point."""
    return np.concatenate([((points[i : i + 4096, None] - palette[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(points), 4096)])


def edge_map(energy: np.ndarray, gx: np.ndarray, gy: np.ndarray, high: float = 0.97, low: float = 0.92) -> np.ndarray:
    """Ridges of the energy across the gradient, linked by hysteresis between two of its quantiles."""
    ys, xs = np.mgrid[: energy.shape[0], : energy.shape[1]].astype(float)
    ahead, behind = conv.bilinear(energy, xs + gx, ys + gy), conv.bilinear(energy, xs - gx, ys - gy)
    ridge = np.where((energy >= ahead) & (energy >= behind), energy, 0.0)
    hi, lo = np.quantile(energy, high), np.quantile(energy, low)
    found = masks.hysteresis(ridge, lo, hi)
    return found if found.any() else energy > hi


def by_edges(energy: np.ndarray, gx: np.ndarray, gy: np.ndarray, core: float = 3.0, close: int = 0, smooth: float = 0.6, **quantiles) -> np.ndarray:
    """Cores far from any edge, grown over the falling distance to the edges."""
    wall = edge_map(energy, gx, gy, **quantiles)
    wall = masks.closed(wall, close) if close else wall
    d = masks.distance(wall)[0]
    if not np.isfinite(d).all():
        return np.zeros(energy.shape, int)
    d = conv.gaussian(d, smooth)
    seed = masks.components((d > core).astype(int), d > core) + 1
    return dense(masks.watershed(-d, seed)) if seed.any() else np.zeros(energy.shape, int)


def by_energy(energy: np.ndarray, smooth: float = 1.2, apart: int = 9, compactness: float = 0.0005) -> np.ndarray:
    """Basins of the smoothed energy around minima that lie apart."""
    e = conv.gaussian(energy, smooth)
    return dense(masks.watershed(e, masks.local_minima(e, apart), None, compactness))


def classified(labels: np.ndarray, luma: np.ndarray, rgb: np.ndarray, min_area: int = 600, texture_at: float = 3.0, range_at: float = 0.02, norm: float = 99.5) -> dict[str, np.ndarray]:
    """Per label: area, mean texture over its core, colour spread, and geo, whether it looks drawn rather than painted."""
    tex = conv.texture(luma)
    scale = max(float(np.percentile(tex, norm)), conv.EPS)
    n = np.bincount(labels.ravel())
    t, s = np.zeros(len(n)), np.zeros(len(n))
    for own in windows(labels):
        if n[own.label] >= min_area:
            inner = masks.eroded(own.mask, 2)
            t[own.label] = own.plane(tex)[inner if inner.sum() >= 30 else own.mask].mean()
            low, high = np.percentile(rgb[own.ys, own.xs], (5, 95), axis=0)
            s[own.label] = (high - low).max()
    return {"area": n, "tex": t, "spread": s, "geo": (t / scale < texture_at) & (s < range_at)}


def hybrid(rgb: np.ndarray, tensor: dict[str, np.ndarray], band: float = 3.0, snap: str = "refine", **options) -> tuple[np.ndarray, np.ndarray]:
    """(labels, geometric pixels): colour regions, whose borders in drawn parts may snap to the energy's ridges."""
    labels = by_colors(rgb, **options)
    kind = classified(labels, tensor["luma"], rgb)
    geo = kind["geo"][labels]
    if snap == "watershed":
        border = np.zeros(labels.shape, bool)
        for dy, dx in masks.CROSS:
            other = masks.shifted(labels, dy, dx, -1)
            border |= (other >= 0) & (other != labels)
        near = (masks.distance(border)[0] <= band) & geo if border.any() else border
        labels = dense(masks.watershed(tensor["energy"], np.where(near, 0, labels + 1), near | (labels >= 0)))
    return labels, geo


def merge_small(labels: np.ndarray, min_area: int, rgb255: np.ndarray | None = None, protect: float = 0.0, rounds: int = 8, min_width: int = 0) -> np.ndarray:
    """Pixels of regions below min_area go to the nearest pixel of a kept region, in rounds; nothing kept ends it."""
    labels = dense(labels)
    if min_width:
        labels = open_labels(labels, min_width)
    for _ in range(rounds):
        keep = np.bincount(labels.ravel()) >= min_area
        if protect > 0 and rgb255 is not None:
            keep |= means(labels, rgb255.max(axis=2) - rgb255.min(axis=2))[:, 0] > protect
        if keep.all() or not keep.any():
            break
        _, y, x = masks.distance(keep[labels])
        labels = dense(labels[y, x])
    return labels


def open_labels(labels: np.ndarray, width: int) -> np.ndarray:
    """Parts thinner than the width go to the nearest core; a core pixel's square window holds its own label only."""
    r = width // 2
    low, high = labels.copy(), labels.copy()
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            low = np.minimum(low, masks.shifted(labels, dy, dx, labels.max()))
            high = np.maximum(high, masks.shifted(labels, dy, dx, 0))
    core = (low == labels) & (high == labels)
    if not core.any():
        return labels
    _, y, x = masks.distance(core)
    return dense(labels[y, x])
