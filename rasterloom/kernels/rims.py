"""Transition bands along the rims of drawn regions: how deep the image's own transition reaches, and a staircase of it.

A source image crosses a region's border over two or three pixels. Each drawn region gets its half of that transition as
narrow bands, parallel to its contour and inside it, one for each level and each stretch with one neighbour, in the colour
that the image has there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from rasterloom.kernels import conv, curves, masks, segments

# fixed values: least edge pixels and least usable profiles, least rise of a profile, sampling step across an edge,
# rounds of the quantiser, shortest ring, run and stretch in points, and how far inward a point looks for its region's end
EDGE_PIXELS, PROFILES, RISE, STEP, ROUNDS = 200, 100, 0.08, 0.25, 24
RING, RUN, STRETCH, REACH, SAMPLES = 12, 5, 6, 4.0, 6000


@dataclass(frozen=True)
class Depths:
    """Depths from the border into a region: where the levels part, and where their colours are taken."""

    cuts: np.ndarray
    at: np.ndarray

    @staticmethod
    def even(half: float, levels: int) -> Depths:
        cuts = np.linspace(0.0, half, levels + 1)
        return Depths(cuts, (cuts[1:] + cuts[:-1]) / 2)


def mean_profile(luma: np.ndarray, tensor: dict[str, np.ndarray], threshold: float, half: float) -> np.ndarray | None:
    """The median transition across strong edges, from -half to half in steps, scaled to 0..1; None without enough edges.

    At most SAMPLES edge pixels, evenly taken in scan order, are measured.
    """
    ys, xs = np.nonzero(tensor["energy"] > threshold)
    if len(ys) < EDGE_PIXELS:
        return None
    some = np.unique(np.linspace(0, len(ys) - 1, min(SAMPLES, len(ys))).astype(int))
    ys, xs = ys[some].astype(float), xs[some].astype(float)
    ahead = np.arange(-half, half + 1e-9, STEP)[:, None]
    across = conv.bilinear(luma, xs + ahead * conv.bilinear(tensor["gx"], xs, ys), ys + ahead * conv.bilinear(tensor["gy"], xs, ys))
    rise = across[-1] - across[0]
    good = np.abs(rise) > RISE
    if good.sum() < PROFILES:
        return None
    return np.median((across[:, good] - across[0, good]) / rise[good], axis=1)


def ramp_depths(profile: np.ndarray | None, half: float, levels: int) -> Depths | None:
    """Depths that part the inner half of a profile into levels of least variance (one-dimensional Lloyd); None if they coincide."""
    if profile is None:
        return None
    inner = profile[len(profile) // 2 :]
    depth = np.linspace(0.0, half, len(inner))
    cuts = np.linspace(0.0, half, levels + 1)

    def centres(cuts: np.ndarray) -> np.ndarray | None:
        level = np.searchsorted(cuts[1:-1], depth, "right")
        n = np.bincount(level, minlength=levels)
        return np.bincount(level, inner, levels) / n if n.all() else None

    for _ in range(ROUNDS):
        if (c := centres(cuts)) is None:
            return None
        between = np.interp((c[1:] + c[:-1]) / 2, inner, depth)
        moved = np.maximum.accumulate(np.concatenate(([0.0], between, [half])))
        still = np.abs(moved - cuts).max() <= 0.01
        cuts = moved
        if still:
            break
    if (c := centres(cuts)) is None or np.diff(cuts).min() <= 1e-3:
        return None
    return Depths(cuts, np.interp(c, inner, depth))


def _label_at(labels: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Labels under points (..., 2) of x and y; those outside the image take the nearest pixel's."""
    h, w = labels.shape
    at = np.rint(points).astype(int)
    return labels[np.clip(at[..., 1], 0, h - 1), np.clip(at[..., 0], 0, w - 1)]


def inward(ring: np.ndarray) -> np.ndarray:
    """Unit normals of a closed ring (without its repeated end) into its region, which lies on the right of the way around."""
    along = np.roll(ring, -1, axis=0) - np.roll(ring, 1, axis=0)
    size = np.hypot(along[:, 0], along[:, 1])
    return np.stack((-along[:, 1], along[:, 0]), axis=1) / np.where(size > 0, size, 1)[:, None]


def half_widths(ring: np.ndarray, normal: np.ndarray, labels: np.ndarray, label: int, half: float) -> np.ndarray:
    """How deep bands may reach at each point: less where the region ends soon, smoothed around the ring."""
    ahead = np.arange(0.5, REACH, 0.5)
    inside = _label_at(labels, ring[:, None] + ahead[:, None] * normal[:, None]) == label
    ends = np.where(inside.all(axis=1), REACH, ahead[np.argmin(inside, axis=1)])
    width = np.clip(0.75 * (ends - 0.5), 0.15, half)
    return sum(np.roll(width, k) for k in range(-2, 3)) / 5


def neighbours_of(ring: np.ndarray, normal: np.ndarray, labels: np.ndarray, label: int) -> np.ndarray | None:
    """The region a pixel outside each point; points that see their own region, and short runs, take the point's before. None if all do."""
    seen = _label_at(labels, ring - normal).astype(np.int64)
    foreign = np.flatnonzero(seen != label)
    if not len(foreign):
        return None
    # the last foreign point up to each one, around the ring
    seen = seen[foreign[np.searchsorted(foreign, np.arange(len(ring)), "right") - 1]]
    if len(ring) > 24:
        for _ in range(2):
            first = np.flatnonzero(np.diff(seen, prepend=seen[0] - 1))
            value, size = seen[first], np.diff(np.append(first, len(seen)))
            for k in range(1, len(value)):
                if size[k] < RUN:
                    value[k] = value[k - 1]
            seen = np.repeat(value, size)
    return seen


def stretches(around: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first point, points, neighbour) of the runs of a closed ring."""
    n = len(around)
    first = np.flatnonzero(around != np.roll(around, 1))
    if not len(first):
        yield 0, n, int(around[0])
    for k, a in enumerate(first.tolist()):
        yield a, (int(first[(k + 1) % len(first)]) - a - 1) % n + 1, int(around[a])


def rims(labels: np.ndarray, rgb: np.ndarray, geo: np.ndarray, root: np.ndarray, tensor: dict[str, np.ndarray], levels: int = 2, width: float = 2.5, threshold: float = 0.0, profile: str = "shape", least_geo: float = 0.5, least_radius: float = 1.4, least_points: int = 8, tolerance: float = 0.15, degrees: float = 62.0, synthetic: bool = False, snap=None, **contour) -> tuple[list[dict], list[dict]]:
    """(bands, audit): bands with label, neighbor, level, area, color and path data d; and every stretch that was looked at.

    geo marks drawn pixels; a region is drawn if least_geo of it is. root tells which regions come from one that was split:
    between them the border is synthetic and has no bands unless `synthetic`. Regions and borders that are too thin have none.
    """
    half = width / 2
    depths = ramp_depths(mean_profile(tensor["luma"], tensor, threshold, half), half, levels) if profile == "shape" else None
    depths = depths or Depths.even(half, levels)
    roots = {w.label: int(root[w.ys[0], w.xs[0]]) for w in segments.windows(labels)}
    bands, audit = [], []
    for own in segments.windows(labels, 2):
        if geo[own.ys, own.xs].mean() < least_geo:
            continue
        depth = masks.inside_distance(own.mask)
        deepest = depth[own.mask].max()
        if deepest < least_radius:  # infinite for a region that fills its box, which the image's edge cuts off
            continue
        for ring in curves.mask_rings(masks.dilated(own.mask), offset=(own.x0, own.y0), **contour):
            ring = snap(ring) if snap else ring
            ring = ring[:-1] if np.allclose(ring[0], ring[-1]) else ring
            if len(ring) < RING:
                continue
            normal = inward(ring)
            if (_label_at(labels, ring + normal) == own.label).mean() <= 0.6:
                continue
            around = neighbours_of(ring, normal, labels, own.label)
            if around is None:
                continue
            share = half_widths(ring, normal, labels, own.label, half)[:, None] / half
            for first, n, other in stretches(around):
                split = roots[other] == roots[own.label]
                audit.append({"label": own.label, "neighbor": other, "points": n, "ring": len(ring), "synthetic": split})
                if n < max(STRETCH, least_points) or n > len(ring) - 3 or (split and not synthetic):
                    continue
                at = np.arange(first, first + n) % len(ring)
                line, deep = ring[at], normal[at] * share[at]
                for k in range(levels):
                    outline = np.concatenate((line + deep * depths.cuts[k], (line + deep * depths.cuts[k + 1])[::-1]))
                    outline = curves.simplified(np.concatenate((outline, outline[:1])), 0.06)
                    if len(outline) < 4:
                        continue
                    middle = line + deep * depths.at[k]
                    color = np.median(conv.bilinear(rgb, middle[:, 0], middle[:, 1]), axis=0)
                    area = n * (depths.cuts[k + 1] - depths.cuts[k]) * float(share[at].mean())
                    bands.append({"label": own.label, "neighbor": other, "level": k, "area": area, "color": np.clip(color, 0, 1), "d": curves.path_data(curves.bezier_segments(outline, tolerance, degrees))})
    return bands, audit
