"""Binary and label morphology, connected components, distance transforms, watershed, thinning."""

from __future__ import annotations

import heapq

import numpy as np

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))
RING8 = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def shifted(plane: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """plane[y + dy, x + dx], `fill` outside."""
    out = np.full_like(plane, fill)
    h, w = plane.shape[:2]
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def eroded(mask: np.ndarray, times: int = 1, around=CROSS) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce([mask, *(shifted(mask, dy, dx, False) for dy, dx in around)])
    return mask


def dilated(mask: np.ndarray, times: int = 1, around=CROSS) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([mask, *(shifted(mask, dy, dx, False) for dy, dx in around)])
    return mask


def opened(mask: np.ndarray, times: int = 1, around=CROSS) -> np.ndarray:
    return dilated(eroded(mask, times, around), times, around)


def closed(mask: np.ndarray, times: int = 1, around=CROSS) -> np.ndarray:
    return eroded(dilated(mask, times, around), times, around)


def components(values: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """8-connected components of equal value (within the mask), numbered from 0 in scan order; -1 outside the mask.

    Minimum labels flow along whole rows, columns and links at once, with pointer jumping, so that rounds grow with the
    logarithm of a component's size.
    """
    h, w = values.shape
    n = h * w
    parent = np.arange(n)
    ids = parent.reshape(h, w)
    links = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        same = values == shifted(values, dy, dx, values.flat[0] if n else 0)
        there = shifted(ids, dy, dx, -1)
        same &= there >= 0
        if mask is not None:
            same &= mask & shifted(mask, dy, dx, False)
        links.append(np.stack([ids[same], there[same]], axis=1))
    a, b = np.concatenate(links).T if links else (np.zeros(0, int),) * 2
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    root = parent.reshape(h, w)
    inside = np.ones((h, w), bool) if mask is None else mask
    # roots are the first pixels of their components
    number = np.cumsum((parent == np.arange(n)) & inside.ravel()) - 1
    return np.where(inside, number[root], -1)


def hysteresis(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Pixels above low whose 8-connected component reaches above high."""
    weak = plane > low
    own = components(weak.astype(np.int8), weak)
    strong = np.unique(own[(plane > high) & weak])
    return weak & np.isin(own, strong[strong >= 0])


def _lower_envelope(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and sources of the 1-D transform of f; the smaller source wins ties."""
    n = len(f)
    v, z, k = np.zeros(n, int), np.full(n + 1, np.inf), -1
    for q in range(n):
        if not np.isfinite(f[q]):
            continue
        s = -np.inf
        while k >= 0:
            s = ((f[q] + q * q) - (f[v[k]] + v[k] * v[k])) / (2 * q - 2 * v[k])
            if s > z[k]:
                break
            k -= 1
        if k < 0:
            k, v[0], z[0], z[1] = 0, q, -np.inf, np.inf
        else:
            k += 1
            v[k], z[k], z[k + 1] = q, s, np.inf
    if k < 0:
        return np.full(n, np.inf), np.zeros(n, int)
    at = np.arange(n)
    j = np.minimum(np.searchsorted(z[1 : k + 1], at, "left"), k)
    return (at - v[j]) ** 2 + f[v[j]], v[j]


def distance(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Euclidean distance to the nearest true pixel, and that pixel's row and column; infinite if there is none."""
    h, w = mask.shape
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, at, -1), axis=0)
    below = np.minimum.accumulate(np.where(mask, at, h)[::-1], axis=0)[::-1]
    up, down = np.where(above >= 0, at - above, np.inf), np.where(below < h, below - at, np.inf)
    f = np.minimum(up, down) ** 2
    rows = np.where(up <= down, np.maximum(above, 0), np.minimum(below, h - 1))
    out, cols = np.empty_like(f), np.zeros((h, w), int)
    # rows near true pixels look at each column within reach, others build the envelope of all columns' parabolas
    near = f.max(axis=1) <= SWEPT**2
    out[near], cols[near] = _swept(f[near])
    for y in np.flatnonzero(~near):
        out[y], cols[y] = _lower_envelope(f[y])
    return np.sqrt(out), rows[at, cols], cols


#: The largest distance along a column for which a row is swept.
SWEPT = 96


def _swept(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _lower_envelope(), for many rows at once, by columns of growing distance; the smaller source wins ties."""
    out, cols = f.copy(), np.broadcast_to(np.arange(f.shape[1]), f.shape).copy()
    for d in range(1, f.shape[1]):
        if not out.size or d * d > out.max():
            break
        for here, there in ((np.s_[:, d:], np.s_[:, :-d]), (np.s_[:, :-d], np.s_[:, d:])):
            far = f[there] + d * d
            source = np.broadcast_to(np.arange(f.shape[1]), f.shape)[there]
            better = (far < out[here]) | ((far == out[here]) & (source < cols[here]))
            out[here] = np.where(better, far, out[here])
            cols[here] = np.where(better, source, cols[here])
    return out, cols


def inside_distance(mask: np.ndarray) -> np.ndarray:
    """Distance of mask pixels to the nearest pixel outside the mask; the image's outside doesn't count."""
    return distance(~mask)[0]


def watershed(elevation: np.ndarray, markers: np.ndarray, mask: np.ndarray | None = None, compactness: float = 0.0) -> np.ndarray:
    """Markers (> 0) flooded in the order of elevation, then of arrival, over 4-neighbours; 0 where nothing reaches.

    With compactness, distance from the marker's first pixel adds to the elevation.
    """
    out = np.where(mask, markers, 0) if mask is not None else markers.copy()
    h, w = elevation.shape
    heap, age = [], 0
    for y, x in zip(*np.nonzero(out), strict=True):
        heap.append((float(elevation[y, x]), age, int(y), int(x), int(y), int(x)))
        age += 1
    heapq.heapify(heap)
    while heap:
        _, _, y, x, sy, sx = heapq.heappop(heap)
        for dy, dx in CROSS:
            ny, nx = y + dy, x + dx
            if 0 <= ny < h and 0 <= nx < w and not out[ny, nx] and (mask is None or mask[ny, nx]):
                out[ny, nx] = out[y, x]
                cost = float(elevation[ny, nx])
                if compactness:
                    cost += compactness * float(np.hypot(ny - sy, nx - sx))
                heapq.heappush(heap, (cost, age, ny, nx, sy, sx))
                age += 1
    return out


def local_minima(plane: np.ndarray, apart: int) -> np.ndarray:
    """Markers (1, 2, ...) at minima, lowest first, each at least `apart` pixels (per axis) from the ones before."""
    low = plane.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            low = np.minimum(low, shifted(plane, dy, dx, np.inf))
    ys, xs = np.nonzero(plane <= low)
    order = np.lexsort((xs, ys, plane[ys, xs]))
    out, free, n = np.zeros(plane.shape, int), np.ones(plane.shape, bool), 0
    for i in order:
        y, x = ys[i], xs[i]
        if free[y, x]:
            n += 1
            out[y, x] = n
            free[max(0, y - apart + 1) : y + apart, max(0, x - apart + 1) : x + apart] = False
    return out


def thinned(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning to lines one pixel wide."""
    img = np.pad(mask, 1).astype(np.uint8)
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        gone = 0
        for phase in (0, 1):
            p = [shifted(img, dy, dx, 0) for dy, dx in ring]
            count = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            corner = (n * e * s == 0) & (e * s * w == 0) if phase == 0 else (n * e * w == 0) & (n * s * w == 0)
            drop = (img == 1) & (count >= 2) & (count <= 6) & (turns == 1) & corner
            img[drop] = 0
            gone += int(drop.sum())
        if not gone:
            return img[1:-1, 1:-1].astype(bool)


def skeleton_paths(mask: np.ndarray, least: int = 8) -> list[np.ndarray]:
    """Polylines (x, y) of a thin mask: walks from ends and junctions along unused pixels, then the loops that are left."""
    ys, xs = np.nonzero(mask)
    pixels = set(zip(ys.tolist(), xs.tolist(), strict=True))
    around = {p: [q for dy, dx in RING8 if (q := (p[0] + dy, p[1] + dx)) in pixels] for p in pixels}
    used: set[tuple] = set()
    out = []

    def walk(start: tuple, step: tuple) -> list[tuple]:
        line, before, here = [start], start, step
        while True:
            used.add((before, here) if before < here else (here, before))
            line.append(here)
            if len(around[here]) != 2:
                return line
            ahead = [q for q in around[here] if q != before and ((here, q) if here < q else (q, here)) not in used]
            if not ahead:
                return line
            before, here = here, ahead[0]

    for knot in (True, False):
        for p in sorted(pixels):
            if (len(around[p]) != 2) == knot:
                for q in around[p]:
                    if ((p, q) if p < q else (q, p)) not in used:
                        out.append(walk(p, q))
    return [np.array([(x, y) for y, x in line], float) for line in out if len(line) >= least]
