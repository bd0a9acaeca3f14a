import numpy as np
import pytest

from volumetra.operators.kernels import models

RNG = np.random.default_rng(7)


def nearest_of_all(p, q):
    d = ((p[:, None, :] - q[None]) ** 2).sum(axis=2)
    i = d.argmin(axis=1)
    return np.sqrt(d[np.arange(len(p)), i]), i


CLOUDS = {
    "lattice": lambda n: RNG.integers(0, 12, (n, 3)).astype(float),
    "spread": lambda n: RNG.uniform(-50, 50, (n, 3)),
    "flat": lambda n: RNG.uniform(0, 30, (n, 3)) * [1, 1, 0],
    "heap": lambda n: np.concatenate([RNG.normal(0, 1e-3, (n - 60, 3)), RNG.uniform(-900, 900, (60, 3))]),
    "one place": lambda n: np.ones((n, 3)),
}


@pytest.mark.parametrize("kind", CLOUDS)
def test_nearest_one_is_exact(kind):
    """Ties go to the smaller index, also of points outside of all cells."""
    p, q = np.concatenate([CLOUDS[kind](700), RNG.uniform(-2000, 2000, (20, 3)).round()]), CLOUDS[kind](900)
    d, i = models.nearest(p, q)
    want_d, want = nearest_of_all(p, q)
    assert (d[:, 0] == want_d).all()
    assert (i[:, 0] == want).all()


def test_places_near_each_other_are_found_by_cells(monkeypatch):
    """Of two clouds of the same density hardly a point is left to the search by groups."""
    rest, real = [], models._nearest_by_leaves
    monkeypatch.setattr(models, "_nearest_by_leaves", lambda p, q, k, size: (rest.append(len(p)), real(p, q, k, size))[1])
    models.nearest(RNG.uniform(0, 50, (8000, 3)), RNG.uniform(0, 50, (8000, 3)))
    assert sum(rest) < 400
