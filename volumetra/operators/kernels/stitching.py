"""Shift between two overlapping images by phase correlation (Kuglin and Hines 1975), checked by cross-correlation."""

from __future__ import annotations

import itertools

import numpy as np


def correlation_at(a: np.ndarray, b: np.ndarray, shift, min_share: float = 0.05) -> tuple[float, int]:
    """(r, voxels) of the part in which b moved by ``shift`` lies on a; r is -1 where that is too small or flat."""
    cut_a, cut_b = [], []
    for n, m, s in zip(a.shape, b.shape, shift, strict=True):
        lo, hi = max(0, s), min(n, m + s)
        if hi - lo < 2:
            return -1.0, 0
        cut_a.append(slice(lo, hi))
        cut_b.append(slice(lo - s, hi - s))
    x, y = a[tuple(cut_a)].astype(float), b[tuple(cut_b)].astype(float)
    if x.size < min_share * min(a.size, b.size):
        return -1.0, x.size
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return (float((x * y).sum() / norm) if norm > 1e-12 else -1.0), x.size


def phase_correlation(a: np.ndarray, b: np.ndarray, peaks: int = 5, subpixel: bool = True, max_shift=(None, None, None)) -> tuple[np.ndarray, float] | None:
    """(shift, r): moving b by ``shift`` puts it on a. The ``peaks`` highest peaks in all their wrapped readings are checked."""
    if min(*a.shape, *b.shape) < 2:
        return None
    shape = [int(2 ** np.ceil(np.log2(n + m))) if n + m > 8 else n + m for n, m in zip(a.shape, b.shape, strict=True)]

    def prepared(x: np.ndarray) -> np.ndarray:
        x = x.astype(float) - x.mean()
        for axis, n in enumerate(x.shape):  # soft borders, so that the images' edges are no feature
            w = np.minimum(1, (np.minimum(np.arange(n), np.arange(n)[::-1]) + 1) / max(1, n // 10 + 1))
            x = x * np.expand_dims(w, [i for i in range(x.ndim) if i != axis])
        return np.fft.rfftn(x, shape, axes=(0, 1, 2))

    fa, fb = prepared(a), prepared(b)
    cross = fa * np.conj(fb)
    pcm = np.fft.irfftn(cross / np.maximum(np.abs(cross), 1e-12), shape, axes=(0, 1, 2))
    is_peak = np.ones(pcm.shape, bool)
    for axis in range(3):
        is_peak &= (pcm >= np.roll(pcm, 1, axis)) & (pcm >= np.roll(pcm, -1, axis))
    flat = np.flatnonzero(is_peak)
    flat = flat[np.argsort(-pcm.ravel()[flat], kind="stable")[:peaks]]
    best: tuple[float, int, tuple[int, ...], tuple[int, ...]] | None = None
    for f in flat:
        at = np.unravel_index(f, pcm.shape)
        for shift in itertools.product(*[(int(x), int(x) - n) for x, n in zip(at, shape, strict=True)]):
            if any(m is not None and abs(s) > m for s, m in zip(shift, max_shift, strict=True)):
                continue
            r, n = correlation_at(a, b, shift)
            if best is None or (r, n) > best[:2]:
                best = (r, n, shift, tuple(int(x) for x in at))
    if best is None or best[0] <= -1:
        return None
    # Climb to the best whole shift nearby, then to the top of a parabola through its neighbours along each axis.
    r, _, shift, _ = best
    allowed = lambda s: all(m is None or abs(x) <= m for x, m in zip(s, max_shift, strict=True))
    while True:
        around = [tuple(x + (d if i == axis else 0) for i, x in enumerate(shift)) for axis in range(3) for d in (-1, 1)]
        near = {s: correlation_at(a, b, s)[0] for s in around}
        top = max((s for s in around if allowed(s)), key=near.get, default=None)
        if top is None or near[top] <= r:
            break
        shift, r = top, near[top]
    out = np.array(shift, float)
    if subpixel:
        for axis in range(3):
            lo, hi = near[around[2 * axis]], near[around[2 * axis + 1]]
            bend = lo - 2 * r + hi
            if lo > -1 and hi > -1 and bend < 0:
                out[axis] += float(np.clip((lo - hi) / (2 * bend), -0.5, 0.5))
    return out, r
