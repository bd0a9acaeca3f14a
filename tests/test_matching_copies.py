import numpy as np

from volumetra.operators.kernels import matching, models


def test_equal_descriptors_need_no_search(monkeypatch):
    """A cloud and its moved copy: no descriptor is searched for, and every point is found."""
    p = np.random.default_rng(2).integers(0, 900, (3000, 3)).astype(float)
    p = np.unique(p, axis=0)
    real, sizes = models.nearest, []
    monkeypatch.setattr(models, "nearest", lambda a, b, k=1: (sizes.append((a.shape[1], len(a))), real(a, b, k))[1])
    found = matching.candidates(p, p + [300, -200, 50], "PRECISE_TRANSLATION", 1.5)
    assert {tuple(x) for x in found} >= {(i, i) for i in range(len(p))}
    assert all(width == 3 for width, _ in sizes)


def test_a_search_among_repeated_points_takes_little_memory(monkeypatch):
    q = np.repeat(np.random.default_rng(3).integers(0, 3, (700, 3)).astype(float), 40, axis=0)
    p = np.unique(q, axis=0).repeat(20, axis=0)
    real, most = models._top, []
    monkeypatch.setattr(models, "_top", lambda a, b, k: (most.append(len(b)), real(a, b, k))[1])
    d, i = models.nearest(p, q, 6)
    want = np.argsort(((p[:1, None] - q[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :6]
    assert max(most) <= 27 * 6 and (i[0] == want[0]).all() and (d == 0).all()
