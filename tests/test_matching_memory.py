import tracemalloc

import numpy as np

from volumetra.operators.kernels import matching, models

RNG = np.random.default_rng(7)


def test_few_queries_hold_few_distances(monkeypatch):
    """A hundred queries against many rows: no matrix of all distances."""
    held, real = [], np.argsort
    monkeypatch.setattr(models, "HELD", 100_000)
    monkeypatch.setattr(models.np, "argsort", lambda a, *args, **kw: (held.append(np.size(a)), real(a, *args, **kw))[1])
    p, q = RNG.uniform(0, 9, (100, 9)), RNG.uniform(0, 9, (20_000, 9))
    d, i = models.nearest(p, q, 2)
    assert max(held) <= 100_000 and (i[:, 0] == ((p[:, None] - q[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_equal_rows_share_a_code():
    rows = RNG.integers(-1, 2, (500, 3)).astype(float) * [1, -1, 1]
    first, codes = models.distinct(rows)
    want, at, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    assert (rows[first] == want).all() and (first == at).all() and (codes == inverse.reshape(-1)).all()
    assert models.distinct(rows[:0])[1].shape == (0,)


def test_descriptors_take_memory_by_parts():
    """Half of the places of a lattice each: searched and equal descriptors together take a few times their own size."""
    at = np.stack(np.meshgrid(*[np.arange(n) for n in (40, 40, 13)], indexing="ij"), -1).reshape(-1, 3).astype(float)
    p, q = at[RNG.random(len(at)) < 0.5], at[RNG.random(len(at)) < 0.5]
    tracemalloc.start()
    matching.candidates(p, q, "PRECISE_TRANSLATION", 1.5, search_radius=60.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Four descriptors of nine numbers for each point of both clouds.
    assert most < 3.5 * (len(p) + len(q)) * 4 * 9 * 8
