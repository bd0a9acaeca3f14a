"""Correspondences between two point clouds: local descriptors, geometric hashing, and iterative closest points.

Descriptors are sets of vectors to neighbours: as they are (translation), with trials of neighbour subsets (redundancy),
or by what rotation leaves unchanged, the sorted distances among a point and its neighbours (geometric hashing, Wolfson
and Rigoutsos 1997). A match has to be ``significance`` times better than the
second best. Closest points after Besl and McKay 1992.
"""

from __future__ import annotations

import itertools

import numpy as np

from volumetra.operators.kernels import models


def _neighbours(p: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest other points of each point."""
    _, i = models.nearest(p, p, n + 1)
    own = np.arange(len(p))
    if i.shape[1] < 2:
        return np.tile(own[:, None], (1, n))
    # The others in their order, then the point itself; or, if that is not among them, all but the last.
    order = np.argsort(i == own[:, None], axis=1, kind="stable")
    others = np.take_along_axis(i, order, 1)[:, : i.shape[1] - 1]
    return others[:, np.minimum(np.arange(n), others.shape[1] - 1)]


def _subsets(neighbours: int, redundancy: int) -> list[tuple[int, ...]]:
    """Which of the neighbours + redundancy nearest points make up a descriptor."""
    return list(itertools.combinations(range(neighbours + redundancy), neighbours))


def translation_descriptors(p: np.ndarray, neighbours: int, redundancy: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, vectors): vectors to the neighbours, ordered by distance."""
    near = _neighbours(p, neighbours + redundancy)
    rel = p[near] - p[:, None, :]
    rows = [rel[:, s].reshape(len(p), -1) for s in map(list, _subsets(neighbours, redundancy))]
    return np.tile(np.arange(len(p)), len(rows)), np.concatenate(rows)


def rotation_descriptors(p: np.ndarray, neighbours: int, redundancy: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, numbers): distances from the point to its neighbours in their order, and among the neighbours."""
    near = _neighbours(p, neighbours + redundancy)
    rel = p[near] - p[:, None, :]
    rows = []
    for s in map(list, _subsets(neighbours, redundancy)):
        r = rel[:, s]
        own = np.sqrt((r**2).sum(axis=2))
        among = [np.sqrt(((r[:, i] - r[:, j]) ** 2).sum(axis=1)) for i, j in itertools.combinations(range(neighbours), 2)]
        rows.append(np.column_stack([own, *among]))
    return np.tile(np.arange(len(p)), len(rows)), np.concatenate(rows)


def candidates(p: np.ndarray, q: np.ndarray, method: str = "FAST_ROTATION", significance: float = 3.0, redundancy: int = 1, neighbours: int = 3, search_radius: float | None = None) -> np.ndarray:
    """(i, j) pairs of points whose descriptors match; each pair once."""
    if min(len(p), len(q)) < neighbours + redundancy + 1:
        return np.zeros((0, 2), int)
    make = rotation_descriptors if method == "FAST_ROTATION" else translation_descriptors
    op, dp = make(p, neighbours, redundancy)
    oq, dq = make(q, neighbours, redundancy)
    i, j = _distinct(dp, dq, oq, significance, min(len(dq), 2 + len(dq) // max(1, len(q))))
    i = op[i]
    if search_radius is not None:
        close = ((p[i] - q[j]) ** 2).sum(axis=1) <= search_radius**2
        i, j = i[close], j[close]
    return np.unique(np.column_stack([i, j]), axis=0).reshape(-1, 2)


def _distinct(dp: np.ndarray, dq: np.ndarray, oq: np.ndarray, significance: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of dp, points): descriptors and the point of the nearest of ``dq``, if it is ``significance`` times nearer than any of
    another point. Those that have an equal one need no search: it is nearest, and distinct if no other point has it too."""
    both, of = models.distinct(np.concatenate([dq, dp]))
    best, many = np.full(len(both), -1), np.zeros(len(both), bool)
    cq, cp = of[: len(dq)], of[len(dq) :]
    best[cq[::-1]] = oq[::-1]
    many[cq[oq != best[cq]]] = True
    equal = best[cp] >= 0
    found = np.flatnonzero(equal & ~many[cp])
    rest = np.flatnonzero(~equal)
    if not len(rest):
        return found, best[cp[found]]
    dist, near = models.nearest(dp[rest], dq, k)
    owner = oq[near]
    # The second best is of another point: several descriptors of one point are alike.
    other = owner != owner[:, :1]
    second = np.where(other.any(axis=1), np.take_along_axis(dist, other.argmax(axis=1)[:, None], 1)[:, 0], np.inf)
    good = dist[:, 0] * significance < second
    return np.concatenate([found, rest[good]]), np.concatenate([best[cp[found]], owner[good, 0]])


def match(p: np.ndarray, q: np.ndarray, method: str = "FAST_ROTATION", significance: float = 3.0, redundancy: int = 1, neighbours: int = 3, search_radius: float | None = None, multi: bool = False, **ransac) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(model, (i, j) inlier pairs)]: descriptor matches that agree in a model; several models only if ``multi``."""
    pairs = candidates(p, q, method, significance, redundancy, neighbours, search_radius)
    if not len(pairs):
        return []
    a, b = p[pairs[:, 0]], q[pairs[:, 1]]
    sets = models.multi_consensus(a, b, **ransac) if multi else [x for x in [models.ransac(a, b, **ransac)] if x]
    return [(m, pairs[good]) for m, good in sets]


def closest_points(p: np.ndarray, q: np.ndarray, model: str = "AFFINE", regularizer: str = "NONE", blend: float = 0.1, max_error: float = 5.0, iterations: int = 200, use_ransac: bool = False, **ransac) -> tuple[np.ndarray, np.ndarray] | None:
    """(model, (i, j) pairs): nearest neighbours within ``max_error`` and the model they give, until nothing changes."""
    m, before = models.identity(), None
    for _ in range(iterations):
        if not len(p) or not len(q):
            return None
        moved = models.apply(m, p)
        d, j = models.nearest(moved, q)
        i = np.flatnonzero(d[:, 0] <= max_error)
        pairs = np.column_stack([i, j[i, 0]])
        if use_ransac and len(pairs):
            found = models.ransac(p[pairs[:, 0]], q[pairs[:, 1]], model, regularizer, blend, max_error=ransac.get("max_error", 2.5), iterations=ransac.get("iterations", 200), min_inliers=ransac.get("min_inliers", 12), min_ratio=ransac.get("min_ratio", 0.1))
            if found is None:
                return None
            pairs = pairs[found[1]]
        if len(pairs) < models.NEEDED[model]:
            return None
        if before is not None and pairs.shape == before.shape and (pairs == before).all():
            return m, pairs
        before = pairs
        m = models.fit_regularized(p[pairs[:, 0]], q[pairs[:, 1]], model, regularizer, blend)
    return m, before
