"""Colour models of one image's regions: gradient fits, gradient-aware merging, refinement."""

from __future__ import annotations

import heapq

import numpy as np

from rasterloom.kernels import masks
from rasterloom.kernels.segments import dense, touching, windows

EPS = 1e-12


STOPS, BINS = 10, 8


def _ends(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.percentile(t, (1, 99), axis=1), without its overhead for few values."""
    n = t.shape[1]
    at = (n - 1) * np.array([0.01, 0.99])
    below = np.floor(at).astype(int)
    above = np.minimum(below + 1, n - 1)
    part = at - below
    t = np.partition(t, np.concatenate((below, above)), axis=1)
    low, high = t[:, below], t[:, above]
    return tuple(np.where(part >= 0.5, high - (high - low) * (1 - part), low + (high - low) * part).T)


class _Shades:
    """A region's colours, each channel sorted once, for medians by the bins of many axes."""

    def __init__(self, colors: np.ndarray):
        self.colors = colors
        self.order = np.argsort(colors.T, axis=1, kind="stable")
        self.sorted = colors[self.order, np.arange(colors.shape[1])[:, None]]
        self.whole = not np.isnan(self.sorted[:, -1]).any()

    def medians(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(axes, bins, channels): medians of the colours of each axis' bins, of which at (axes, pixels) has the numbers; any value for none."""
        # a stable sort by bin keeps each channel's order within the bins
        moved = np.argsort(at.astype(np.uint8)[:, self.order], axis=2, kind="stable")
        channel, axis, n = np.arange(self.sorted.shape[0]), np.arange(len(at))[:, None, None], at.shape[1]
        first = np.cumsum(sizes, axis=1) - sizes

        def value(place: np.ndarray) -> np.ndarray:
            place = np.minimum(place, n - 1)[:, :, None]
            return self.sorted[channel, moved[axis, channel, place]]

        found = (value(first + np.maximum(sizes - 1, 0) // 2) + value(first + sizes // 2)) / 2
        return found if self.whole else np.where(np.isnan(value(first + np.maximum(sizes - 1, 0))), np.nan, found)


def _sizes(at: np.ndarray, bins: int) -> np.ndarray:
    """(axes, bins): how many pixels lie in each bin."""
    return np.bincount((at + bins * np.arange(len(at))[:, None]).ravel(), minlength=bins * len(at)).reshape(len(at), bins)


def _gains(u: np.ndarray, shades: _Shades) -> np.ndarray:
    """The share of the squared colour error that medians of the bins of each axis' positions remove."""
    at = np.floor(u * BINS).astype(int)  # the far end belongs to no bin
    sizes = _sizes(at, BINS + 1)
    counted = sizes > 15
    counted[:, BINS] = False
    axis = np.arange(len(u))[:, None]
    rest = shades.colors - shades.medians(at, sizes)[axis, at]
    error = ((rest * rest).sum(axis=2) * counted[axis, at]).sum(axis=1)
    return 1 - error / (((shades.colors - shades.colors.mean(axis=0)) ** 2).sum() + EPS)


def fit(ys: np.ndarray, xs: np.ndarray, colors: np.ndarray, gx: np.ndarray | None = None, gy: np.ndarray | None = None, weight: np.ndarray | None = None, min_gain: float = 0.12, min_range: float = 0.004, margin: float = 0.05) -> dict | None:
    """The best linear or radial ramp of a region's pixels; None if a flat colour does.

    All axes and centres are looked at together. A ramp's values are medians of the region's colours; gains are computed
    only where some ramp has the range asked for.
    """
    if len(ys) < 200 or np.ptp(colors, axis=0).max() < min_range:
        return None
    cx, cy = xs.mean(), ys.mean()
    p = np.stack((xs - cx, ys - cy), axis=1)
    m = p.T @ (colors - colors.mean(axis=0))
    axes = [np.linalg.eigh(m @ m.T)[1][:, 1]]
    if gx is not None:
        d = np.array([(gx * weight).mean(), (gy * weight).mean()])
        if np.hypot(*d) > EPS:
            axes.append(d / np.hypot(*d))
    centres = [(cx, cy), ((xs.min() + xs.max()) / 2, (ys.min() + ys.max()) / 2)]
    if gx is not None:
        s = gy * xs - gx * ys
        a11, a12, a22 = (gy * gy).sum(), -(gx * gy).sum(), (gx * gx).sum()
        det = a11 * a22 - a12 * a12
        if det > 1e-3 * (a11 + a22) ** 2:
            b1, b2 = (gy * s).sum(), -(gx * s).sum()
            centres.append(((a22 * b1 - a12 * b2) / det, (a11 * b2 - a12 * b1) / det))
    t = np.stack([*(p @ u for u in axes), *(np.hypot(xs - x0, ys - y0) for x0, y0 in centres)])
    shapes = [*({"cx": cx, "cy": cy, "u": u, "radial": False} for u in axes), *({"cx": x0, "cy": y0, "radial": True} for x0, y0 in centres)]
    radial = np.arange(len(t)) >= len(axes)
    lo, hi = _ends(t)
    wide = hi - lo >= np.where(radial, 2, 4)
    u = np.clip((t - lo[:, None]) / np.where(wide, hi - lo, 1)[:, None], 0, 1)
    at = np.minimum((u * STOPS).astype(int), STOPS - 1)
    sizes = _sizes(at, STOPS)
    held = sizes >= 15
    made = wide & (held.sum(axis=1) >= 2)
    if not made[~radial].any():
        return None
    shades = _Shades(colors)
    values = shades.medians(at, sizes)
    ranges = (np.where(held[..., None], values, -np.inf).max(axis=1) - np.where(held[..., None], values, np.inf).min(axis=1)).max(axis=1)
    enough = made & (ranges >= min_range)
    if not enough.any():
        return None
    asked = np.flatnonzero(made & (~radial | enough[radial].any()))
    gains = np.full(len(t), -np.inf)
    gains[asked] = _gains(u[asked], shades)

    def model(i: int) -> dict:
        centre = (np.flatnonzero(held[i]) + 0.5) / STOPS
        offsets = (lo[i] + centre * (hi[i] - lo[i])) / hi[i] if radial[i] else centre
        return {"lo": lo[i], "hi": hi[i], "offsets": offsets, "values": values[i][held[i]], "range": float(ranges[i]), "gain": float(gains[i])} | shapes[i]

    best = int(np.argmax(np.where(radial, -np.inf, gains)))
    if enough[radial].any():
        ring = int(np.argmax(np.where(radial, gains, -np.inf)))
        if 1 - gains[ring] < (1 - gains[best]) * (1 - margin) and enough[ring] and gains[ring] >= min_gain:
            return model(ring)
    return model(best) if enough[best] and gains[best] >= min_gain else None


def predict(model: dict | None, flat: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Colours of a model at pixels; the flat one without a model."""
    if model is None:
        return np.broadcast_to(flat, (len(ys), 3))
    if model["radial"]:
        t = np.hypot(xs - model["cx"], ys - model["cy"]) / model["hi"]
    else:
        t = (xs - model["cx"]) * model["u"][0] + (ys - model["cy"]) * model["u"][1]
        t = np.clip((t - model["lo"]) / (model["hi"] - model["lo"]), 0, 1)
    return np.stack([np.interp(t, model["offsets"], model["values"][:, c]) for c in range(3)], axis=1)


def _flat(model: dict | None, colors: np.ndarray) -> np.ndarray:
    """The flat colour of pixels; a model has no use for it."""
    return np.median(colors, axis=0) if model is None else colors[0]


def _squared(ys: np.ndarray, xs: np.ndarray, colors: np.ndarray) -> float:
    model = fit(ys, xs, colors)
    return float(((colors - predict(model, _flat(model, colors), ys, xs)) ** 2).mean())


def merge_by_gradient(labels: np.ndarray, rgb: np.ndarray, tolerance: float = 0.05, rounds: int = 4) -> np.ndarray:
    """Touching regions that one ramp explains as well as two: pairs in order, each region once a round, never the background."""
    labels = dense(labels)
    edge = np.concatenate((labels[0], labels[-1], labels[:, 0], labels[:, -1]))
    ground = int(np.bincount(edge).argmax())
    own: dict[int, tuple] = {}
    pixels = {w.label: (w.ys, w.xs) for w in windows(labels)}
    refused: set[tuple[int, int]] = set()

    def of(i: int) -> tuple:
        if i not in own:
            ys, xs = pixels[i]
            own[i] = (ys, xs, rgb[ys, xs], _squared(ys, xs, rgb[ys, xs]))
        return own[i]

    for _ in range(rounds):
        used: set[int] = set()
        for a, b in touching(labels).tolist():
            if ground in (a, b) or a in used or b in used or (a, b) in refused:
                continue
            (ya, xa, ca, ea), (yb, xb, cb, eb) = of(a), of(b)
            base = (len(ya) * ea + len(yb) * eb) / (len(ya) + len(yb))
            ys, xs, cs = np.concatenate((ya, yb)), np.concatenate((xa, xb)), np.concatenate((ca, cb))
            if base > EPS and (e := _squared(ys, xs, cs)) <= base * (1 + tolerance) + EPS:
                labels[yb, xb] = a
                own[a] = (ys, xs, cs, e)
                own.pop(b)
                used |= {a, b}
                refused = {p for p in refused if a not in p and b not in p}
            else:
                refused.add((a, b))
        if not used:
            break
    return dense(labels)


def region_error(ys: np.ndarray, xs: np.ndarray, colors: np.ndarray, model: dict | None, flat: np.ndarray, threshold: float) -> tuple[np.ndarray, float, float, int]:
    e = np.abs(colors - predict(model, flat, ys, xs)).max(axis=1)
    return e, float(np.sqrt((e**2).mean())), float((np.maximum(e - threshold, 0) ** 2).mean()), int((e > threshold).sum())


def refine(labels: np.ndarray, rgb: np.ndarray, threshold: float = 0.02, min_area: int = 400, depth: int = 6, gain: float = 0.2, budget: int = 0) -> tuple[np.ndarray, dict[int, int]]:
    """(labels, root of each label): regions with large errors split by a line or a blob, largest first, as long as it pays."""
    labels = dense(labels)
    n = int(labels.max()) + 1
    budget = budget or max(64, min(256, n))
    child = max(32, min_area // 4)
    bad = max(16, child // 2)
    root = {i: i for i in range(n)}
    pixels = {w.label: (w.ys, w.xs) for w in windows(labels)}
    heap = [(-int(a), i, 0) for i, a in enumerate(np.bincount(labels.ravel())) if a >= min_area]
    heapq.heapify(heap)
    evaluated = 0

    def measured(ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, float, float, int]:
        c = rgb[ys, xs]
        model = fit(ys, xs, c)
        return region_error(ys, xs, c, model, _flat(model, c), threshold)

    while heap and budget and evaluated < budget + 512:
        _, i, level = heapq.heappop(heap)
        if level >= depth:
            continue
        ys, xs = pixels[i]
        evaluated += 1
        e, rms, excess, worse = measured(ys, xs)
        if worse < bad or excess <= 0:
            continue
        best = None
        y0, x0 = int(ys.min()), int(xs.min())
        mask = labels[y0 : int(ys.max()) + 1, x0 : int(xs.max()) + 1] == i
        for part in _splits(mask, ys - y0, xs - x0, e, threshold, child, min_area):
            halves = [measured(ys[k], xs[k]) for k in (part, ~part)]
            share = part.mean()
            after = share * halves[0][2] + (1 - share) * halves[1][2], np.sqrt(share * halves[0][1] ** 2 + (1 - share) * halves[1][1] ** 2)
            if after[0] <= (1 - gain) * excess and after[1] <= 1.05 * rms and (best is None or after < best[0]):
                best = after, part
        if best is not None:
            budget -= 1
            new = len(root)
            labels[ys[best[1]], xs[best[1]]] = new
            pixels[new], pixels[i] = ((ys[k], xs[k]) for k in (best[1], ~best[1]))
            root[new] = root[i]
            for j, area in ((new, int(best[1].sum())), (i, int((~best[1]).sum()))):
                if area >= min_area:
                    heapq.heappush(heap, (-area, j, level + 1))
    return labels, root


def _splits(mask: np.ndarray, ys: np.ndarray, xs: np.ndarray, e: np.ndarray, threshold: float, child: int, min_area: int):
    """Candidate parts of a region: one side of a line through the error, or the largest blob of it."""
    w = e**2
    if w.sum() > 0:
        p = np.stack((xs, ys), axis=1).astype(float)
        q = p - np.average(p, axis=0, weights=w)
        t = q @ np.linalg.eigh((q * w[:, None]).T @ q)[1][:, 1]
        order = np.argsort(t, kind="stable")
        cut = t[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]
        part = t > np.clip(cut, *np.percentile(t, (25, 75)))
        if child <= part.sum() <= len(part) - child:
            yield part
    if mask.sum() >= 2 * min_area:
        high = np.zeros(mask.shape, bool)
        high[ys[e > threshold], xs[e > threshold]] = True
        own = masks.components(high.astype(int), high)
        if (own >= 0).any():
            blob = masks.dilated(own == np.bincount(own[own >= 0]).argmax(), 2) & mask
            part = blob[ys, xs]
            if child <= part.sum() <= len(part) - child and masks.eroded(blob, 2).any():
                yield part
