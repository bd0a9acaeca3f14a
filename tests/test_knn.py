import numpy as np
import pytest

from volumetra.operators import knn, points


def brute(a, b):
    out = {}
    for i, v in a:
        found = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in b if w is not None) if v is not None else []
        if found:
            out[i] = (found[0][1], found[0][0], found[1][0] if len(found) > 1 else None)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in rows], "id long, w array<double>")


def result(df):
    return {r.id_a: (r.id_b, r.d1, r.d2) for r in df.collect()}


@pytest.mark.parametrize("kind", ["clusters", "whole numbers", "one place"])
def test_against_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        centres = rng.normal(0, 50, (30, 6))
        make = lambda n: [centres[i] + rng.normal(0, 1, 6) for i in rng.integers(0, 30, n)]
    elif kind == "whole numbers":  # many ties
        make = lambda n: list(rng.integers(0, 4, (n, 3)))
    else:
        make = lambda n: [np.ones(4)] * n
    a, b = list(enumerate(make(300))) + [(900, None)], [(1000 - i, v) for i, v in enumerate(make(700))] + [(5000, None)]
    meetings: list[int] = []
    got = result(knn.nearest_two(table(spark, a), table(spark, b), "w", block=50, meetings=meetings))
    assert got == brute(a, b)
    if kind == "clusters":
        assert sum(meetings) < 0.15 * 300 * 700


def test_few_rows(spark):
    a, one = [(1, [0.0, 1.0]), (2, [5.0, 5.0])], [(7, [1.0, 1.0])]
    assert result(knn.nearest_two(table(spark, a), table(spark, one), "w")) == brute(a, one)
    assert result(knn.nearest_two(table(spark, a), table(spark, [(1, None)]), "w")) == {}
    assert result(knn.nearest_two(table(spark, []), table(spark, one), "w")) == {}
    two = [(8, [1.0, 1.0]), (7, [1.0, 1.0])]
    assert result(points.best_two(table(spark, a), table(spark, two), "w")) == brute(a, two)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    b, x = rng.normal(0, 3, (400, 5)), rng.normal(0, 4, (50, 5))
    pivots = b[:20]
    home = knn.squared(b, pivots).argmin(axis=1)
    r = np.sqrt(knn.squared(b, pivots).min(axis=1))
    cells = knn.Cells(pivots, [{"cell": c, "low": r[home == c].min(), "high": r[home == c].max(), "n": (home == c).sum()} for c in range(20)])
    d = np.sqrt(knn.squared(x, b))
    most, of, bounds = cells.plan(x)
    for i in range(50):
        second = np.sort(d[i])[1]
        assert most[i] >= second - 1e-9 and list(bounds[i]) == sorted(bounds[i])
        assert all(d[i][home == c].min() >= low - 1e-9 for c, low in zip(of[i], bounds[i], strict=True))
        assert all(d[i][home == c].min() > second - 1e-9 for c in set(range(20)) - set(of[i]))


def test_whole_numbers_are_multiplied(monkeypatch):
    """The same distances, to the last digit, without a difference for each pair and dimension."""
    rng = np.random.default_rng(7)
    p, q = rng.integers(-900, 900, (40, 64)).astype(float), rng.integers(-900, 900, (5000, 64)).astype(float)
    want = ((p[:, None] - q[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(knn.np, "empty", None)
    assert (knn.squared(p, q) == want).all()
