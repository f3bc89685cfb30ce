"""Contours, simplification, subpixel snapping, curve fitting and path data of one region or line."""

from __future__ import annotations

import numpy as np

from rasterloom.functions.text import fixed
from rasterloom.kernels.conv import bilinear, gaussian


#: Sides of a cell: 0 top, 1 right, 2 bottom, 3 left; for each code of high corners, steps from side to side with the high part on the right.
LEAD = {1: ((0, 3),), 2: ((1, 0),), 3: ((1, 3),), 4: ((2, 1),), 5: ((0, 3), (2, 1)), 6: ((2, 0),), 7: ((2, 3),), 8: ((3, 2),), 9: ((0, 2),), 10: ((1, 0), (3, 2)), 11: ((1, 2),), 12: ((3, 1),), 13: ((0, 1),), 14: ((3, 0),)}
#: The same as a table of two steps a code, -1 where there is none.
STEPS = np.array([[*LEAD.get(code, ()), (-1, -1), (-1, -1)][:2] for code in range(16)])


def contours(field: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed rings (x, y) where a field padded with zeros crosses the level, by marching squares; saddles join the high corners' sides apart.

    A side that a ring crosses is a number that orders first sides between rows apart from those between columns, then by
    place; each is left once, so that the steps are a permutation.
    """
    h, w = field.shape[0] + 2, field.shape[1] + 2
    f = np.zeros((h, w))
    f[1:-1, 1:-1] = field
    high = f > level
    code = high[:-1, :-1] * 1 + high[:-1, 1:] * 2 + high[1:, 1:] * 4 + high[1:, :-1] * 8
    y, x = np.nonzero((code > 0) & (code < 15))
    steps = STEPS[code[y, x]]
    at = y * w + x
    sides = np.stack((at, at + h * w + 1, at + w, at + h * w), axis=1)
    cell, step = np.nonzero(steps[..., 0] >= 0)
    begin, end = (sides[cell, steps[cell, step, k]] for k in (0, 1))
    ahead = dict(zip(begin.tolist(), end.tolist(), strict=True))
    rings = []
    for first in sorted(ahead):
        if first in ahead:
            ring, here = [], first
            while here in ahead:
                ring.append(here)
                here = ahead.pop(here)
            ring.append(first)
            rings.append(np.array(ring))
    out = []
    for ring in rings:
        falls = ring >= h * w
        y, x = np.divmod(np.where(falls, ring - h * w, ring), w)
        a, b = f[y, x], f[y + falls, x + ~falls]
        t = (level - a) / (b - a)
        out.append(np.stack((x - 1 + np.where(falls, 0, t), y - 1 + np.where(falls, t, 0)), axis=1))
    return out


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker, without recursion; ends stay."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = line[a], line[b] - line[a]
        rest = line[a + 1 : b] - p
        size = np.hypot(*d)
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size > 0 else np.hypot(rest[:, 0], rest[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def mask_rings(mask: np.ndarray, smooth: float = 1.0, least_area: float = 30.0, offset: tuple[float, float] = (0.0, 0.0)) -> list[np.ndarray]:
    """Rings of a blurred mask, in image coordinates, above an area."""
    pad = int(4 * smooth + 1)
    rings = contours(gaussian(np.pad(mask.astype(float), pad), smooth))
    return [r - pad + np.array(offset) for r in rings if len(r) >= 5 and ring_area(r) >= least_area]


def snapped(ring: np.ndarray, luma: np.ndarray, energy: np.ndarray, reach: float = 3.0, step: float = 0.15, most: float = 1.5, contrast: float = 0.06, least_energy: float = 0.0, mode: str = "half") -> tuple[np.ndarray, int]:
    """Ring points moved along their normals onto the edge: where the smoothed profile crosses its middle, or where it is steepest.

    A point stays if contrast or energy is too low, or the way is longer than `most`. Returns the ring and how many moved.
    """
    tangent = np.roll(ring, -1, axis=0) - np.roll(ring, 1, axis=0)
    size = np.hypot(tangent[:, 0], tangent[:, 1])
    normal = np.stack((-tangent[:, 1], tangent[:, 0]), axis=1) / np.where(size > 0, size, 1)[:, None]
    t = np.arange(-int(reach / step), int(reach / step) + 1) * step
    at = ring[:, None] + t[None, :, None] * normal[:, None]
    profile = bilinear(luma, at[..., 0], at[..., 1])
    profile[:, 1:-1] = (profile[:, :-2] + profile[:, 1:-1] + profile[:, 2:]) / 3
    ends = max(3, len(t) // 6)
    inner, outer = np.median(profile[:, :ends], axis=1), np.median(profile[:, -ends:], axis=1)
    good = (np.abs(outer - inner) > contrast) & (bilinear(energy, ring[:, 0], ring[:, 1]) > least_energy) & (size > 0)
    shift = np.zeros(len(ring))
    if mode == "half":
        side = (profile - ((inner + outer) / 2)[:, None])[good]
        i, k = np.nonzero((side[:, :-1] * side[:, 1:] <= 0) & (side[:, :-1] != side[:, 1:]))
        where = t[k] + step * side[i, k] / (side[i, k] - side[i, k + 1])
        order = np.lexsort((k, np.abs(where), i))  # the nearest crossing of each point
        i, first = np.unique(i[order], return_index=True)
        shift[np.flatnonzero(good)[i]] = where[order][first]
    else:
        for i in np.flatnonzero(good):
            slope = np.abs(np.diff(profile[i]))
            k = int(slope.argmax())
            fine = 0.0
            if 0 < k < len(slope) - 1 and (bend := slope[k - 1] - 2 * slope[k] + slope[k + 1]) < 0:
                fine = 0.5 * (slope[k - 1] - slope[k + 1]) / bend
            shift[i] = t[k] + (0.5 + fine) * step
    shift[np.abs(shift) > most] = 0
    return ring + shift[:, None] * normal, int(np.count_nonzero(shift))


def _bernstein(u: np.ndarray) -> np.ndarray:
    v = 1 - u
    return np.stack((v**3, 3 * u * v * v, 3 * u * u * v, u**3), axis=1)


def _directions(v: np.ndarray) -> np.ndarray:
    n = np.hypot(v[:, 0], v[:, 1])[:, None]
    return np.where(n > 0, v / np.where(n > 0, n, 1), 0.0)


def cubic_fits(points: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4 control points of each line, distances of all points) of the least-squares cubics with fixed ends and end directions, by chord length.

    Lines of two points at least stand one behind the other in points, each from its place in first on.
    """
    sizes = np.diff(first, append=len(points))
    last, own = first + sizes - 1, np.repeat(np.arange(len(first)), sizes)
    step = np.hypot(*np.diff(points, axis=0, prepend=points[:1]).T)
    step[first] = 0.0
    run = np.cumsum(step)
    run -= run[first][own]
    total = run[last][own]
    place = np.arange(len(points)) - first[own]
    u = np.where(total > 0, run / np.where(total > 0, total, 1), place / (sizes - 1)[own])
    b = _bernstein(u)
    start, end = points[first], points[last]
    rest = points - ((b[:, 0] + b[:, 1])[:, None] * start[own] + (b[:, 2] + b[:, 3])[:, None] * end[own])
    b1, b2 = b[:, 1], b[:, 2]
    columns = np.stack((b1 * b1, b1 * b2, b2 * b2, b1 * (rest * left[own]).sum(axis=1), b2 * (rest * right[own]).sum(axis=1)), axis=1)
    s11, s12, s22, w1, w2 = np.add.reduceat(columns, first, axis=0).T
    g11, g12, g22 = s11 * (left * left).sum(axis=1), s12 * (left * right).sum(axis=1), s22 * (right * right).sum(axis=1)
    det = g11 * g22 - g12 * g12
    chord = np.hypot(*(end - start).T)
    with np.errstate(all="ignore"):
        lengths = np.stack(((g22 * w1 - g12 * w2) / det, (g11 * w2 - g12 * w1) / det), axis=1)
        poor = ~np.isfinite(lengths).all(axis=1) | (lengths < 1e-6 * chord[:, None]).any(axis=1) | (lengths > 10 * np.maximum(chord, 1e-9)[:, None]).any(axis=1)
    lengths = np.where(poor[:, None], chord[:, None] / 3, lengths)
    control = np.stack((start, start + left * lengths[:, :1], end + right * lengths[:, 1:], end), axis=1)
    return control, np.hypot(*((b[:, :, None] * control[own]).sum(axis=1) - points).T)


def cubic_fit(line: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cubic_fits() of one line."""
    control, far = cubic_fits(line, np.zeros(1, int), left[None], right[None])
    return control[0], far


#: Distances that differ by less are equal.
TIE = 1e-9


def fitted_lines(lines: list[np.ndarray], tolerance: float, depth: int = 8) -> list[np.ndarray]:
    """Cubics (n, 4, 2) along each open polyline, split where one is farther than the tolerance; all parts of a depth at once."""
    points = np.concatenate(lines)
    size = np.array([len(line) for line in lines])
    begin = np.cumsum(size) - size
    end, k = begin + size - 1, np.minimum(3, size - 1)
    left, right, of = _directions(points[begin + k] - points[begin]), _directions(points[end - k] - points[end]), np.arange(len(lines))
    done: list[tuple] = []
    for more in range(depth, -1, -1):
        size = end - begin + 1
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first - begin, size)
        control, far = cubic_fits(points[at], first, left, right)
        most = np.maximum.reduceat(far, first)
        ready = (size < 4) | (most <= tolerance) | (not more)
        done.append((of[ready], begin[ready], control[ready]))
        if ready.all():
            break
        own = np.repeat(np.arange(len(first)), size)
        # the first of the farthest points of each part; rounding doesn't choose among equals
        top = np.flatnonzero(far >= most[own] - TIE)
        cut = top[np.searchsorted(own[top], np.arange(len(first)))] - first
        begin, end, left, right, of, cut = (v[~ready] for v in (begin, end, left, right, of, cut))
        cut = begin + np.clip(cut, 1, end - begin - 1)
        across = _directions(points[np.minimum(cut + 1, end)] - points[cut - 1])
        begin, end, left, right, of = (np.concatenate(v) for v in ((begin, cut), (cut, end), (left, across), (-across, right), (of, of)))
    of, begin, control = (np.concatenate(v) for v in zip(*done, strict=True))
    order = np.lexsort((begin, of))
    return np.split(control[order], np.searchsorted(of[order], np.arange(1, len(lines))))


def fitted(line: np.ndarray, tolerance: float, depth: int = 8) -> list[np.ndarray]:
    """Cubics along an open polyline, split where one is farther than the tolerance."""
    return list(fitted_lines([line], tolerance, depth)[0])


def corners(ring: np.ndarray, degrees: float = 62.0, k: int = 3) -> np.ndarray:
    """Places of a closed ring (without its repeated end) that turn by more than the angle over k points, one a neighbourhood."""
    a, b = ring - np.roll(ring, k, axis=0), np.roll(ring, -k, axis=0) - ring
    turn = np.abs(np.degrees(np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(axis=1))))
    best = turn > degrees
    for j in range(1, k + 1):
        best &= (turn >= np.roll(turn, -j)) & (turn > np.roll(turn, j))
    return np.flatnonzero(best)


def bezier_rings(rings: list[np.ndarray], tolerance: float = 0.1, degrees: float = 62.0) -> list[np.ndarray]:
    """Cubics (n, 4, 2) around each closed ring, cut at its corners, or at two opposite points if it has fewer than two."""
    lines, count = [], []
    for ring in rings:
        ring = ring[:-1] if np.allclose(ring[0], ring[-1]) else ring
        cuts = corners(ring, degrees) if len(ring) > 8 else np.zeros(0, int)
        if len(cuts) < 2:
            cuts = np.array([0, len(ring) // 2])
        lines += [ring[np.arange(a, b + 1) % len(ring)] for a, b in zip(cuts, np.append(cuts[1:], cuts[0] + len(ring)), strict=True)]
        count.append(len(cuts))
    made = fitted_lines(lines, tolerance) if lines else []
    upto = np.cumsum(count, dtype=int)
    return [np.concatenate(made[b - n : b]) for n, b in zip(count, upto, strict=True)]


def bezier_segments(ring: np.ndarray, tolerance: float = 0.1, degrees: float = 62.0) -> list[np.ndarray]:
    """bezier_rings() of one ring."""
    return list(bezier_rings([ring], tolerance, degrees)[0])


def spline_segments(ring: np.ndarray, most: float = 0.55) -> list[np.ndarray]:
    """Catmull-Rom cubics around a closed ring, with clamped controls."""
    p = ring[:-1] if np.allclose(ring[0], ring[-1]) else ring
    before, after, later = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0), np.roll(p, -2, axis=0)
    side = np.hypot(*(after - p).T)[:, None]

    def clamp(v: np.ndarray) -> np.ndarray:
        n = np.hypot(*v.T)[:, None]
        return np.where(n > most * side, v * most * side / np.where(n > 0, n, 1), v)

    return list(np.stack((p, p + clamp((after - before) / 6), after + clamp((p - later) / 6), after), axis=1))


def path_data(segments: list[np.ndarray] | np.ndarray, closed: bool = True, places: int = 1, straight: float = 0.12) -> str:
    """Relative path data; a cubic whose controls lie on its chord becomes a line."""
    if not len(segments):
        return ""
    s = np.asarray(segments)
    d = s[:, 1:] - s[:, :1]
    n = np.hypot(d[:, 2, 0], d[:, 2, 1])[:, None]
    across = np.abs(d[:, 2, :1] * d[:, :2, 1] - d[:, 2, 1:] * d[:, :2, 0])
    off = np.where(n > 0, across / np.where(n > 0, n, 1), np.hypot(d[:, :2, 0], d[:, :2, 1]))
    lines = (off < straight).all(axis=1).tolist()
    x, y = s[0, 0].tolist()
    out = [f"M{fixed(x, places)} {fixed(y, places)}"]
    for line, use in zip(lines, d.reshape(len(s), 6).tolist(), strict=True):
        out.append(("l" if line else "c") + " ".join([fixed(v, places) for v in (use[4:] if line else use)]))
    return "".join(out) + ("z" if closed else "")


def ring_paths(rings: list[np.ndarray], fit: str = "bezier", tolerance: float = 0.75, fit_tolerance: float = 0.1) -> list[str]:
    """Path data of each ring; '' for a spline through fewer than four points."""
    if fit == "bezier":
        return [path_data(s) for s in bezier_rings(rings, fit_tolerance)]
    coarse = [simplified(ring, tolerance) for ring in rings]
    return [path_data(spline_segments(c)) if len(c) >= 4 else "" for c in coarse]


def region_path(mask: np.ndarray, fit: str = "bezier", smooth: float = 1.0, tolerance: float = 0.75, fit_tolerance: float = 0.1, least_area: float = 30.0, offset: tuple[float, float] = (0.0, 0.0), snap=None) -> str:
    """Path data of all rings of a mask; snap may move a ring's points first. '' if no ring is large enough."""
    rings = mask_rings(mask, smooth, least_area, offset)
    return "".join(ring_paths([snap(r) for r in rings] if snap else rings, fit, tolerance, fit_tolerance))
