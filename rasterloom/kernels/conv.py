"""Separable Gaussian filters with an explicit boundary, the structure tensor, texture, and colour planes."""

from __future__ import annotations

import numpy as np

EPS = 1e-12


def taps(sigma: float, order: int = 0) -> np.ndarray:
    """Normalised Gaussian weights on -r..r, r = int(4 sigma + 0.5); order 1 gives those of the derivative."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    return g if order == 0 else x / sigma**2 * g


def along(plane: np.ndarray, weights: np.ndarray, axis: int, mode: str) -> np.ndarray:
    """Correlation along an axis; mode 'nearest' repeats the edge, 'reflect' mirrors it with the edge repeated."""
    r, n = len(weights) // 2, plane.shape[axis]
    at = np.arange(-r, n + r)
    if mode == "nearest":
        at = np.clip(at, 0, n - 1)
    else:
        at %= 2 * n
        at = np.minimum(at, 2 * n - 1 - at)
    wide = plane.take(at, axis)
    out = np.zeros_like(plane, dtype=float)
    ahead = (slice(None),) * axis
    for i, w in enumerate(weights):
        out += w * wide[(*ahead, slice(i, i + n))]
    return out


def gaussian(plane: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    if sigma <= 0:
        return plane.astype(float)
    return along(along(plane.astype(float), taps(sigma), 0, mode), taps(sigma), 1, mode)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def structure_tensor(rgb: np.ndarray, sigma_d: float = 1.0, sigma_i: float = 2.5) -> dict[str, np.ndarray]:
    """Eigenvalues l1 >= l2, coherence, energy, luma, gradient direction (gx, gy) and tangent (tx, ty) of (H, W, 3)."""
    smooth, slope = taps(sigma_d), taps(sigma_d, 1)
    xx = xy = yy = 0.0
    for c in range(rgb.shape[2]):
        dx = along(along(rgb[..., c], smooth, 0, "nearest"), slope, 1, "nearest")
        dy = along(along(rgb[..., c], slope, 0, "nearest"), smooth, 1, "nearest")
        xx, xy, yy = xx + dx * dx, xy + dx * dy, yy + dy * dy
    xx, xy, yy = (gaussian(p / rgb.shape[2], sigma_i, "nearest") for p in (xx, xy, yy))
    half, root = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
    l1, l2 = half + root, half - root
    ax, ay, bx, by = xy, l1 - xx, l1 - yy, xy
    longer = ax**2 + ay**2 >= bx**2 + by**2
    gx, gy = np.where(longer, ax, bx), np.where(longer, ay, by)
    norm = np.hypot(gx, gy)
    norm = np.where(norm < EPS, 1.0, norm)
    gx, gy = gx / norm, gy / norm
    return {"l1": l1, "l2": l2, "coh": (l1 - l2) / (l1 + l2 + EPS), "energy": l1, "luma": luma(rgb), "gx": gx, "gy": gy, "tx": -gy, "ty": gx}


def thumbnail_change(rgb: np.ndarray, side: int = 64) -> float:
    """Mean absolute change along columns plus along rows of an image's side x side thumbnail (means over its cells)."""
    h, w = rgb.shape[:2]
    small = rgb
    for axis, n in ((0, h), (1, w)):
        if n >= side:
            small = np.add.reduceat(small, np.arange(side) * n // side, axis=axis) / np.diff(np.append(np.arange(side) * n // side, n)).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
    if small.shape[:2] != (side, side):
        y, x = np.meshgrid((np.arange(side) + 0.5) * small.shape[0] / side - 0.5, (np.arange(side) + 0.5) * small.shape[1] / side - 0.5, indexing="ij")
        small = bilinear(small, x, y)
    return float(np.abs(np.diff(small, axis=0)).mean() + np.abs(np.diff(small, axis=1)).mean())


def texture(luma: np.ndarray, sigma: float = 2.5, smooth: float = 6.0) -> np.ndarray:
    """Smoothed energy of what a blur removes."""
    return gaussian((luma - gaussian(luma, sigma)) ** 2, smooth)


def bilateral(rgb: np.ndarray, sigma_color: float, sigma_space: float = 2.0) -> np.ndarray:
    """Edge-preserving smoothing: weights fall with distance and with colour difference."""
    r = int(2 * sigma_space + 0.5)
    wide = np.pad(rgb, ((r, r), (r, r), (0, 0)), mode="edge")
    total, weight = np.zeros_like(rgb), np.zeros(rgb.shape[:2])
    h, w = rgb.shape[:2]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = wide[r + dy : r + dy + h, r + dx : r + dx + w]
            k = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - ((other - rgb) ** 2).sum(axis=2) / (2 * max(sigma_color, EPS) ** 2))
            total += other * k[..., None]
            weight += k
    return total / weight[..., None]


def resized(rgb: np.ndarray, scale: float, least: int = 32, lobes: int = 3) -> np.ndarray:
    """Lanczos resampling, each axis by itself, widened when shrinking; sides of `least` at least unless scale is 1."""
    if scale == 1:
        return rgb.astype(float)
    out = rgb.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        m = max(least, int(n * scale))
        wide = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        at = np.arange(n)
        d = (at[None] - centre[:, None]) / wide
        k = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
        out = np.moveaxis(np.tensordot(k / k.sum(axis=1, keepdims=True), out, axes=(1, axis)), 0, axis)
    return np.clip(out, 0, 1)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab planes (D65) of sRGB in 0..1."""
    c = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    # fixed values: the sRGB matrix and white point
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def bilinear(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at real positions, clamped to the image."""
    h, w = plane.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if plane.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (plane[y0, x0] * (1 - fx) + plane[y0, x1] * fx) * (1 - fy) + (plane[y1, x0] * (1 - fx) + plane[y1, x1] * fx) * fy
