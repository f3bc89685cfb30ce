"""Streamlines along the tangent field, ribbons, colours; evenly spaced within one region, in a fixed order."""

from __future__ import annotations

import numpy as np

from rasterloom.functions.text import fixed
from rasterloom.kernels.conv import bilinear


# fixed value: how far seeds are moved from their grid, in spacings
JITTER = 0.45


def streamline(start: tuple[float, float], tx: np.ndarray, ty: np.ndarray, coh: np.ndarray, free, step: float, longest: float, least_coh: float, most_turn: float) -> np.ndarray:
    """Points (x, y) from a start, both ways, by midpoint steps; ends where coherence, turn, the image or `free` says so."""
    h, w = coh.shape
    limit = np.cos(np.radians(most_turn))

    def direction(x: float, y: float, along: np.ndarray | None) -> np.ndarray | None:
        if not (0 <= x <= w - 1 and 0 <= y <= h - 1):
            return None
        d = np.array([float(bilinear(tx, np.array([x]), np.array([y]))[0]), float(bilinear(ty, np.array([x]), np.array([y]))[0])])
        n = np.hypot(*d)
        if n < 1e-9:
            return None
        d /= n
        return -d if along is not None and d @ along < 0 else d

    halves = []
    for way in (1.0, -1.0):
        p, line = np.array(start, float), []
        before = direction(*p, None)
        before = None if before is None else way * before
        while before is not None and step * len(line) < longest / 2:
            middle = direction(*(p + before * step / 2), before)
            if middle is None or middle @ before < limit:
                break
            q = p + middle * step
            iy, ix = int(round(q[1])), int(round(q[0]))
            if not (0 <= iy < h and 0 <= ix < w) or coh[iy, ix] < least_coh or not free(iy, ix):
                break
            line.append(q)
            p, before = q, middle
        halves.append(line)
    return np.array([*halves[1][::-1], np.array(start, float), *halves[0]])


def streamlines(mask: np.ndarray, tensor: dict[str, np.ndarray], seed: int, spacing: float = 10.0, ratio: float = 0.45, step: float = 3.0, longest: float = 120.0, shortest: float = 24.0, nodes: int = 12, least_coh: float = 0.12, most_turn: float = 70.0) -> list[np.ndarray]:
    """Lines from jittered grid seeds, most coherent first; each takes discs of ratio * spacing that later ones avoid."""
    rng = np.random.default_rng(seed)
    h, w = mask.shape
    # the grid keeps a spacing from the image's sides, and no jittered seed leaves its inside
    grid = np.mgrid[spacing : h - spacing : spacing, spacing : w - spacing : spacing]
    gy, gx = (np.clip(g + rng.uniform(-JITTER, JITTER, g.shape) * spacing, min(1, n - 1), max(0, n - 2)) for g, n in zip(grid, (h, w), strict=True))
    y, x = gy.ravel(), gx.ravel()
    iy, ix = y.astype(int), x.astype(int)
    good = mask[iy, ix] & (tensor["coh"][iy, ix] >= least_coh)
    taken = np.zeros((h, w), bool)
    r = ratio * spacing
    out = []
    for i in np.lexsort((ix, iy, -tensor["coh"][iy, ix])):
        if not good[i] or taken[iy[i], ix[i]]:
            continue
        line = streamline((x[i], y[i]), tensor["tx"], tensor["ty"], tensor["coh"], lambda a, b: mask[a, b] and not taken[a, b], step, longest, least_coh, most_turn)
        length = np.hypot(*np.diff(line, axis=0).T).sum() if len(line) > 1 else 0.0
        if length < shortest:
            continue
        for px, py in line:
            a, b = max(0, int(py - r)), max(0, int(px - r))
            part = taken[a : int(py + r) + 2, b : int(px + r) + 2]
            ys, xs = np.mgrid[a : a + part.shape[0], b : b + part.shape[1]]
            part |= (ys - py) ** 2 + (xs - px) ** 2 <= r * r
        out.append(line[np.unique(np.linspace(0, len(line) - 1, min(nodes, len(line))).round().astype(int))])
    return out


def widths(line: np.ndarray, coh: np.ndarray, width: float = 7.5) -> np.ndarray:
    """Wider where coherent, tapered towards both ends."""
    t = np.linspace(0, 1, len(line))
    return width * (0.5 + 0.5 * bilinear(coh, line[:, 0], line[:, 1])) * np.clip(np.minimum(t, 1 - t) / 0.16, 0.25, 1)


def ribbon(line: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The closed outline of a line with a width at each point."""
    d = np.gradient(line, axis=0)
    n = np.hypot(*d.T)
    normal = np.stack((-d[:, 1], d[:, 0]), axis=1) / np.where(n > 0, n, 1)[:, None] * width[:, None] / 2
    return np.concatenate((line + normal, (line - normal)[::-1]))


def ribbon_path(outline: np.ndarray) -> str:
    return "M" + "L".join(f"{fixed(x)} {fixed(y)}" for x, y in outline) + "z"


def stroke_color(rgb: np.ndarray, line: np.ndarray, rng: np.random.Generator, jitter: float = 0.012) -> np.ndarray:
    """The median colour under a line, with a little noise."""
    return np.clip(np.median(bilinear(rgb, line[:, 0], line[:, 1]), axis=0) + rng.normal(0, jitter, 3), 0, 1)


def region_strokes(mask: np.ndarray, rgb: np.ndarray, tensor: dict[str, np.ndarray], activity: np.ndarray, number: int, seed: int = 7, alpha: float = 0.6, reference: float = 0.012, least_alpha: float = 0.03, width: float = 7.5, least_pixels: int = 400, **options) -> list[tuple[str, np.ndarray, float]]:
    """(path, colour, alpha) of a region's strokes; the seed depends on the region's number only. Faint regions get none."""
    if mask.sum() < least_pixels:
        return []
    strength = alpha * min(1.0, float(activity[mask].mean()) / reference)
    if strength < least_alpha:
        return []
    rng = np.random.default_rng((seed * 1000003 + number + 1) & 0x7FFFFFFF)
    out = []
    for line in streamlines(mask, tensor, int(rng.integers(1 << 31)), **options):
        out.append((ribbon_path(ribbon(line, widths(line, tensor["coh"], width))), stroke_color(rgb, line, rng), min(strength, 0.95)))
    return out
