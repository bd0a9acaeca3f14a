"""Difference-of-Gaussian blobs (Lindeberg 1998, Lowe 2004) with quadratic localisation; background by local medians."""

from __future__ import annotations

import numpy as np

#: Ratio of the two widths, and how many widths a kernel reaches.
RATIO, REACH = 2 ** (1 / 4), 3.0


def gaussian(sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(REACH * sigma)))
    x = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return x / x.sum()


def halo(sigma: float) -> int:
    """Voxels around a block that its detections depend on: the wider kernel, one for the extrema, one for the fit."""
    return len(gaussian(sigma * RATIO)) // 2 + 2


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    k = gaussian(sigma)
    r = len(k) // 2
    for axis in range(a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        mode = "symmetric"
        wide = np.pad(a, pad, mode=mode)
        out = np.zeros_like(a, dtype=float)
        for i, w in enumerate(k):
            out += w * np.take(wide, np.arange(i, i + a.shape[axis]), axis=axis)
        a = out
    return a


def difference(a: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Narrow minus wide, of intensities scaled to [0, 1], with scale-normalized amplitude: blobs brighter than around are maxima."""
    a = (a.astype(float) - low) / (high - low)
    return (smooth(a, sigma) - smooth(a, sigma * RATIO)) / (RATIO - 1)


def extrema(d: np.ndarray, threshold: float, kind: str = "MAX") -> np.ndarray:
    """Voxels that are strict extrema among their 26 neighbours and beyond the threshold; borders are none."""
    found = []
    for sign in {"MAX": (1,), "MIN": (-1,), "BOTH": (1, -1)}[kind]:
        s = sign * d
        if min(s.shape) < 3:
            continue
        centre = s[1:-1, 1:-1, 1:-1]
        ok = centre > threshold
        for dx in (0, 1, 2):
            for dy in (0, 1, 2):
                for dz in (0, 1, 2):
                    if (dx, dy, dz) != (1, 1, 1):
                        ok &= centre > s[dx : s.shape[0] - 2 + dx, dy : s.shape[1] - 2 + dy, dz : s.shape[2] - 2 + dz]
        found.append(np.argwhere(ok) + 1)
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def localize(d: np.ndarray, at: np.ndarray, moves: int = 4) -> np.ndarray:
    """Subpixel places: the top of a quadratic through the 3x3x3 neighbourhood, moved on while it lies beyond half a voxel."""
    out = at.astype(float)
    for n, p in enumerate(at):
        p = p.copy()
        for _ in range(moves):
            c = d[tuple(slice(x - 1, x + 2) for x in p)]
            grad = np.array([(c[2, 1, 1] - c[0, 1, 1]), (c[1, 2, 1] - c[1, 0, 1]), (c[1, 1, 2] - c[1, 1, 0])]) / 2
            h = np.zeros((3, 3))
            for i in range(3):
                e = [1, 1, 1]
                e[i] = 2
                f = [1, 1, 1]
                f[i] = 0
                h[i, i] = c[tuple(e)] - 2 * c[1, 1, 1] + c[tuple(f)]
                for j in range(i):
                    s = 0.0
                    for u in (0, 2):
                        for v in (0, 2):
                            k = [1, 1, 1]
                            k[i], k[j] = u, v
                            s += (1 if u == v else -1) * c[tuple(k)]
                    h[i, j] = h[j, i] = s / 4
            if abs(np.linalg.det(h)) < 1e-18:
                break
            step = -np.linalg.solve(h, grad)
            if np.abs(step).max() <= 0.5:
                out[n] = p + step
                break
            new = np.clip(p + np.sign(step).astype(int) * (np.abs(step) > 0.5), 1, np.array(d.shape) - 2)
            if (new == p).all():
                out[n] = p + np.clip(step, -0.5, 0.5)
                break
            p = new
    return out


def detect(a: np.ndarray, sigma: float, threshold: float, low: float, high: float, kind: str = "MAX", localization: str = "QUADRATIC") -> tuple[np.ndarray, np.ndarray]:
    """(places, intensities) of the blobs of an image."""
    d = difference(a, sigma, low, high)
    at = extrema(d, threshold, kind)
    places = localize(d, at) if localization == "QUADRATIC" else at.astype(float)
    return places, sample(a, places)


def sample(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation with extended borders."""
    out = np.zeros(len(at))
    base = np.floor(at).astype(int)
    frac = at - base
    top = np.array(a.shape) - 1
    for k in range(8):
        bit = np.array([k & 1, k >> 1 & 1, k >> 2 & 1])
        w = np.where(bit == 1, frac, 1 - frac).prod(axis=1)
        i = np.clip(base + bit, 0, top)
        out += w * a[i[:, 0], i[:, 1], i[:, 2]]
    return out


def median_ratio(a: np.ndarray, radius: int) -> np.ndarray:
    """Each slice divided by its median in a disk; 0 where the median is not above 0. Borders are mirrored."""
    offsets = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    out = np.zeros(a.shape)
    for z in range(a.shape[2]):
        wide = np.pad(a[:, :, z].astype(float), radius, mode="symmetric")
        m = np.median([wide[radius + x : radius + x + a.shape[0], radius + y : radius + y + a.shape[1]] for x, y in offsets], axis=0)
        out[:, :, z] = np.where(m > 0, a[:, :, z] / np.where(m > 0, m, 1), 0)
    return out


def halved(a: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """Mean of cells, axis by axis; factors are powers of two, a rest at the end is left out."""
    for axis, f in enumerate(factors):
        while f > 1:
            n = a.shape[axis] // 2 * 2
            even = np.take(a, np.arange(0, n, 2), axis=axis).astype(float)
            a = (even + np.take(a, np.arange(1, n, 2), axis=axis)) / 2
            f //= 2
    return a
