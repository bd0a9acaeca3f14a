"""Linear intensity relations of overlapping cells, by consensus or histograms, and the coefficients that reconcile them."""

from __future__ import annotations

import numpy as np


def linear(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, offset) of y = scale x + offset; scale 1 where x does not vary."""
    v = x.var()
    scale = float(((x - x.mean()) * (y - y.mean())).mean() / v) if v > 1e-12 else 1.0
    return scale, float(y.mean() - scale * x.mean())


def ransac(x: np.ndarray, y: np.ndarray, iterations: int = 1000, max_error: float = 5.1, min_ratio: float = 0.1, min_inliers: int = 10, trust: float = 3.0, seed: int = 1) -> tuple[float, float, np.ndarray] | None:
    """(scale, offset, inliers); inliers are then trimmed to ``trust`` times their median error."""
    n = len(x)
    if n < max(2, min_inliers):
        return None
    rng, best = np.random.default_rng(seed), np.zeros(n, bool)
    for i, j in rng.integers(0, n, (iterations, 2)):
        if x[i] == x[j]:
            continue
        s = (y[j] - y[i]) / (x[j] - x[i])
        good = np.abs(s * (x - x[i]) + y[i] - y) <= max_error
        if good.sum() > best.sum():
            best = good
    for _ in range(20):
        if best.sum() < max(2, min_inliers, min_ratio * n):
            return None
        s, o = linear(x[best], y[best])
        e = np.abs(s * x + o - y)
        new = best & (e <= trust * max(np.median(e[best]), 1e-9))
        if (new == best).all():
            break
        best = new
    return s, o, best


def histogram(x: np.ndarray, y: np.ndarray, steps: int = 64) -> tuple[float, float]:
    """(scale, offset) that takes quantiles of x to those of y."""
    q = np.linspace(0.02, 0.98, steps)
    return linear(np.quantile(x, q), np.quantile(y, q))


def relation(x: np.ndarray, y: np.ndarray, method: str = "RANSAC", **options) -> tuple[int, float, float] | None:
    """(values it rests on, scale, offset), whatever the order of the values."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if method == "HISTOGRAM":
        return (len(x), *histogram(x, y))
    found = ransac(x, y, **options)
    return (int(found[2].sum()), found[0], found[1]) if found else None


def solve(matches: list[tuple[object, object, float, float, float]], cells: list, blend: float = 0.1, iterations: int = 1000) -> dict:
    """{cell: (scale, offset)} for matches (a, b, scale, offset, weight) with I_b = scale I_a + offset.

    Least squares over s_a I + o_a = s_b (scale I + offset) + o_b at two intensities, drawn towards scale 1 and offset 0
    by ``blend``; Gauss-Seidel rounds over the cells until nothing moves.
    """
    s, o = {c: 1.0 for c in cells}, {c: 0.0 for c in cells}
    by: dict = {c: [] for c in cells}
    for a, b, k, d, w in matches:
        by[a].append((b, 1.0, 0.0, k, d, w))
        by[b].append((a, k, d, 1.0, 0.0, w))
    for _ in range(iterations):
        change = 0.0
        for c in cells:
            if not by[c]:
                continue
            m, r = np.diag([blend, blend / 255.0**2]), np.array([blend, 0.0])
            for other, k1, d1, k2, d2, w in by[c]:
                for i in (0.0, 255.0):
                    mine, theirs = k1 * i + d1, s[other] * (k2 * i + d2) + o[other]
                    row = np.array([mine, 1.0]) / 255.0
                    m = m + w * np.outer(row, row)
                    r = r + w * row * theirs / 255.0
            new = np.linalg.solve(m, r)
            change = max(change, abs(new[0] - s[c]), abs(new[1] - o[c]) / 255)
            s[c], o[c] = float(new[0]), float(new[1])
        if change < 1e-9:
            break
    return {c: (s[c], o[c]) for c in cells}
