"""Translation, rigid and affine models, their blends, robust fitting, and clusters of points.

A model is a 3x4 matrix that maps points p to q. Rigid fits use the SVD of the cross-covariance (Kabsch 1976, Umeyama
1991), robust fits random sample consensus (Fischler and Bolles 1981).
"""

from __future__ import annotations

import itertools

import numpy as np

NEEDED = {"TRANSLATION": 1, "RIGID": 3, "AFFINE": 4}
#: Points of a group in the search for nearest ones.
LEAF = 128
#: Points that one group meets at once: bounds the memory of a search.
PART = 16_384
#: Distances that a search among few points holds at once.
HELD = 2**21
#: Points of three cells in a row beyond which these are left to the search by groups.
CROWDED = 64


def apply(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:, :3].T + m[:, 3]


def compose(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.column_stack([outer[:, :3] @ inner[:, :3], outer[:, :3] @ inner[:, 3] + outer[:, 3]])


def identity() -> np.ndarray:
    return np.eye(3, 4)


def fit(p: np.ndarray, q: np.ndarray, model: str, weights: np.ndarray | None = None) -> np.ndarray:
    """The least-squares model of one kind; fewer points than it needs give the next simpler kind."""
    w = np.ones(len(p)) if weights is None else weights
    w = w / w.sum()
    cp, cq = w @ p, w @ q
    a, b = p - cp, q - cq
    rotation = np.eye(3)
    if model == "AFFINE" and len(p) >= 4:
        moment = (a * w[:, None]).T @ a
        if np.linalg.cond(moment) < 1e12:
            rotation = np.linalg.solve(moment, (a * w[:, None]).T @ b).T
        else:
            model = "RIGID"
    if (model == "RIGID" or model == "AFFINE" and len(p) < 4) and len(p) >= 3:
        u, _, vt = np.linalg.svd((b * w[:, None]).T @ a)
        rotation = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return np.column_stack([rotation, cq - rotation @ cp])


def fit_regularized(p: np.ndarray, q: np.ndarray, model: str, regularizer: str = "NONE", blend: float = 0.1, weights: np.ndarray | None = None) -> np.ndarray:
    """(1 - blend) of the model plus ``blend`` of the regularizer's."""
    m = fit(p, q, model, weights)
    if regularizer == "NONE":
        return m
    other = identity() if regularizer == "IDENTITY" else fit(p, q, regularizer, weights)
    return (1 - blend) * m + blend * other


def errors(m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((apply(m, p) - q) ** 2).sum(axis=1))


def ransac(p: np.ndarray, q: np.ndarray, model: str = "AFFINE", regularizer: str = "NONE", blend: float = 0.1, iterations: int = 10_000, max_error: float = 5.0, min_ratio: float = 0.1, min_inliers: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """(model, inlier mask) of the largest consensus, refitted until it stands still; None if it is too small."""
    n, k = len(p), NEEDED[model]
    if n < max(k, min_inliers):
        return None
    rng, best = np.random.default_rng(seed), np.zeros(n, bool)
    tries, done = iterations, 0
    while done < tries:
        pick = rng.choice(n, k, replace=False)
        good = errors(fit_regularized(p[pick], q[pick], model, regularizer, blend), p, q) <= max_error
        done += 1
        if good.sum() > best.sum():
            best = good
            # Enough tries to have met a clean sample with a chance of 1 - 1e-6.
            share = min(1 - 1e-9, (best.sum() / n) ** k)
            tries = min(iterations, max(50, int(np.ceil(np.log(1e-6) / np.log1p(-share)))))
    for _ in range(50):
        if best.sum() < max(k, min_inliers):
            return None
        m = fit_regularized(p[best], q[best], model, regularizer, blend)
        new = errors(m, p, q) <= max_error
        if (new == best).all():
            break
        best = new
    if best.sum() < max(min_inliers, min_ratio * n):
        return None
    return fit_regularized(p[best], q[best], model, regularizer, blend), best


def multi_consensus(p: np.ndarray, q: np.ndarray, **options) -> list[tuple[np.ndarray, np.ndarray]]:
    """Consensus sets one after the other, each from what the former left over."""
    out, rest = [], np.arange(len(p))
    while True:
        found = ransac(p[rest], q[rest], **options)
        if found is None:
            return out
        m, good = found
        mask = np.zeros(len(p), bool)
        mask[rest[good]] = True
        out.append((m, mask))
        rest = rest[~good]


def clusters(points: np.ndarray, radius: float) -> np.ndarray:
    """A label for each point; points linked by steps of at most ``radius`` share one.

    All points of a cell whose diagonal is the radius are linked. Two cells within reach are met only while they are not linked
    already, so dense heaps cost no more than their points.
    """
    if not len(points):
        return np.zeros(0, int)
    side = max(radius, 1e-9) / np.sqrt(3) * (1 - 1e-9)
    cells, of = np.unique(np.floor(points / side).astype(np.int64), axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(of))[:-1])
    parent = list(range(len(cells)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def meet(a: np.ndarray, b: np.ndarray) -> bool:
        step = max(1, 2**20 // len(b))
        return any((((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2) <= radius * radius).any() for i in range(0, len(a), step))

    at = {c: i for i, c in enumerate(map(tuple, cells.tolist()))}
    # Nearer cells first: they link most of what further ones would have to be met for.
    around = sorted((o for o in itertools.product(range(-2, 3), repeat=3) if o > (0, 0, 0)), key=lambda o: sum(v * v for v in o))
    for dx, dy, dz in around:
        for (x, y, z), i in at.items():
            j = at.get((x + dx, y + dy, z + dz))
            if j is None:
                continue
            a, b = find(i), find(j)
            if a != b and meet(points[members[i]], points[members[j]]):
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(cells))], int)[of]


def _top(p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, indices) of the k nearest of q for each of p, ties to the smaller index."""
    d = np.maximum(0, (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1) - 2 * p @ q.T)
    rows, d_out, i_out = np.arange(len(p)), np.zeros((len(p), k)), np.zeros((len(p), k), int)
    for n in range(k):
        i_out[:, n] = at = d.argmin(axis=1)
        d_out[:, n] = d[rows, at]
        d[rows, at] = np.inf
    return d_out, i_out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each set of equal rows, a code for each row): codes number the sets in the order of their rows.

    Columns are sorted one after the other: no row is copied."""
    order = np.lexsort(rows.T[::-1])
    new = np.arange(len(rows)) == 0
    for x in rows.T:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    codes = np.empty(len(rows), int)
    codes[order] = np.cumsum(new) - 1
    return order[new], codes


def leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows of p in groups of up to ``size`` that lie close together: halved at the median of the widest axis."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out.append(np.sort(i))
            continue
        x = p[i][:, np.argmax(np.ptp(p[i], axis=0))]
        order, half = np.argpartition(x, len(i) // 2), len(i) // 2
        todo += [i[order[:half]], i[order[half:]]]
    return out


def _nearest_by_leaves(p: np.ndarray, q: np.ndarray, k: int, size: int) -> np.ndarray:
    """The indices of ``nearest``: a group of p meets only those groups of q whose boxes are not beyond its k-th distance so far."""
    i_out = np.zeros((len(p), k), int)
    groups = leaves(q, size)
    lo, hi = (np.array([f(q[g], axis=0) for g in groups]) for f in (np.min, np.max))
    scale = (np.abs(q).max() + np.abs(p).max()) ** 2 * q.shape[1]
    for g in leaves(p, size):
        own = p[g]
        gap = (np.maximum(0, np.maximum(lo - own.max(axis=0), own.min(axis=0) - hi)) ** 2).sum(axis=1)
        # The groups of q nearest to the middle give a first bound.
        mid = own.mean(axis=0)
        first = np.argsort((np.maximum(0, np.maximum(lo - mid, mid - hi)) ** 2).sum(axis=1), kind="stable")[: 2 + k // (size // 2)]
        far = _top(own, q[np.concatenate([groups[x] for x in first])], k)[0].max()
        near = np.sort(np.concatenate([groups[x] for x in np.flatnonzero(gap <= far + 1e-9 * scale)]))
        d_best, i_best = np.zeros((len(g), 0)), np.zeros((len(g), 0), int)
        for a in range(0, len(near), PART):
            d, i = _top(own, q[near[a : a + PART]], min(k, len(near) - a))
            d_best, i_best = np.concatenate([d_best, d], axis=1), np.concatenate([i_best, near[a : a + PART][i]], axis=1)
            first = np.lexsort((i_best, d_best), axis=1)[:, :k]
            d_best, i_best = np.take_along_axis(d_best, first, 1), np.take_along_axis(i_best, first, 1)
        i_out[g] = i_best
    return i_out


def _nearest_in_cells(p: np.ndarray, q: np.ndarray, side: float) -> np.ndarray:
    """The index of the nearest of q for each of p, from the 27 cells around it; -1 where a point beyond these could be as near, or
    where they are crowded."""
    i_out, lo = np.full(len(p), -1), q.min(axis=0)
    size = np.floor((q.max(axis=0) - lo) / side) + 5
    if not (size.prod() < 2**62 and side * 1e-9 > 1e-15 * max(np.abs(p).max(), np.abs(q).max())):
        return i_out
    at = (p - lo) / side
    cell = np.floor(at)
    inside = np.flatnonzero(((cell >= -1) & (cell <= size - 4)).all(axis=1))
    size = size.astype(np.int64)

    def code(c: np.ndarray) -> np.ndarray:
        x, y, z = c.astype(np.int64).T + 2
        return (x * size[1] + y) * size[2] + z

    codes = code(np.floor((q - lo) / side))
    order = np.argsort(codes, kind="stable")
    codes, own = codes[order], code(cell[inside])
    best, near, crowded = np.full(len(inside), np.inf), np.full(len(inside), -1), np.zeros(len(inside), bool)
    for dx, dy in itertools.product((-1, 0, 1), repeat=2):
        # Three cells along z follow each other.
        middle = own + (dx * size[1] + dy) * size[2]
        a, b = np.searchsorted(codes, middle - 1), np.searchsorted(codes, middle + 1, side="right")
        crowded |= b - a > CROWDED
        b = np.minimum(b, a + CROWDED)
        while len(some := np.flatnonzero(a < b)):
            j = order[a[some]]
            d = ((p[inside[some]] - q[j]) ** 2).sum(axis=1)
            nearer = (d < best[some]) | ((d == best[some]) & (j < near[some]))
            best[some[nearer]], near[some[nearer]] = d[nearer], j[nearer]
            a[some] += 1
    into = (at - cell)[inside]
    border = side * (1 + np.minimum(into, 1 - into).min(axis=1))
    good = ~crowded & (np.sqrt(best) < border * (1 - 1e-9))
    i_out[inside[good]] = near[good]
    return i_out


def _nearest_one(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of many places for k = 1: by cells of about one point, then of about eight; the rest by groups."""
    wide = np.ptp(q, axis=0)
    wide = wide[wide > 0]
    spacing = (wide.prod() / len(q)) ** (1 / len(wide)) if len(wide) else 1.0
    i_out = _nearest_in_cells(p, q, spacing)
    rest = np.flatnonzero(i_out < 0)
    if len(rest):
        i_out[rest] = _nearest_in_cells(p[rest], q, 2 * spacing)
        rest = np.flatnonzero(i_out < 0)
    if len(rest):
        i_out[rest] = nearest(p[rest], q, 1, cells=False)[1][:, 0]
    return np.sqrt(((p - q[i_out]) ** 2).sum(axis=1))[:, None], i_out[:, None]


def nearest(p: np.ndarray, q: np.ndarray, k: int = 1, block: int = 512, cells: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(distances, indices) of the k nearest of q for each of p, ties to the smaller index; many points by cells or groups."""
    k = min(k, len(q))
    if cells and k == 1 and p.shape[1] == 3 and len(q) > 4 * LEAF and len(p) > LEAF:
        return _nearest_one(p, q)
    if k and k <= 16 and len(q) > 4 * LEAF and len(p) > LEAF:
        first, back = distinct(p)
        rows = p[first]
        # Of equal points of q only the first k can be among the k nearest.
        _, same = distinct(q)
        order = np.argsort(same, kind="stable")
        sizes = np.bincount(same)
        some = np.sort(order[np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k])
        i_out = some[_nearest_by_leaves(rows, q[some], k, LEAF)][back]
        d_out = np.zeros(i_out.shape)
        for a in range(0, len(p), PART):
            # Differences instead of products: what is equally far gets the same distance.
            d = np.sqrt(((p[a : a + PART, None, :] - q[i_out[a : a + PART]]) ** 2).sum(axis=2))
            order = np.lexsort((i_out[a : a + PART], d), axis=1)
            d_out[a : a + PART], i_out[a : a + PART] = np.take_along_axis(d, order, 1), np.take_along_axis(i_out[a : a + PART], order, 1)
        return d_out, i_out
    d_out, i_out = np.zeros((len(p), k)), np.zeros((len(p), k), int)
    qq = (q**2).sum(axis=1)
    block = max(1, min(block, HELD // max(1, len(q))))
    for i in range(0, len(p), block):
        d = np.maximum(0, (p[i : i + block] ** 2).sum(axis=1)[:, None] + qq - 2 * p[i : i + block] @ q.T)
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        i_out[i : i + block], d_out[i : i + block] = top, np.sqrt(np.take_along_axis(d, top, 1))
    return d_out, i_out
