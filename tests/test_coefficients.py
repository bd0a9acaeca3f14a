import numpy as np
import pytest

from volumetra.operators import coefficients


def dense(matches, blend):
    """Least squares over all unknowns at once; offsets in units of the range."""
    cells = sorted({c for m in matches for c in m[:2]})
    rows, right = [], []
    for a, b, k, d, w in matches:
        for v in (0.0, 255.0):
            row = np.zeros(2 * len(cells))
            row[2 * cells.index(a)] += v / 255
            row[2 * cells.index(a) + 1] += 1
            row[2 * cells.index(b)] -= (k * v + d) / 255
            row[2 * cells.index(b) + 1] -= 1
            rows.append(np.sqrt(w) * row)
            right.append(0.0)
    for i in range(len(cells)):
        for at, want in ((2 * i, 1.0), (2 * i + 1, 0.0)):
            row = np.zeros(2 * len(cells))
            row[at] = np.sqrt(blend)
            rows.append(row)
            right.append(np.sqrt(blend) * want)
    x = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
    return {c: (x[2 * i], 255 * x[2 * i + 1]) for i, c in enumerate(cells)}


def four_views():
    rng = np.random.default_rng(6)
    true = {(v, c): (rng.uniform(0.7, 1.4), rng.uniform(-20, 20)) for v in range(4) for c in range(5)}
    out = []
    for (v, c), (s, o) in true.items():
        for (u, e), (s2, o2) in true.items():
            if v < u and c == e and (v, u) != (0, 3):
                out.append(((v, c), (u, e), s / s2 * rng.uniform(0.99, 1.01), (o - o2) / s2, rng.uniform(1, 30)))
    return out


@pytest.mark.parametrize("local", [0, 10_000])
def test_equals_least_squares(spark, monkeypatch, local):
    rows, rounds = four_views(), []
    if local == 0:
        monkeypatch.setattr(coefficients, "BROADCAST_CELLS", 3)  # by shuffle
    table = spark.createDataFrame([(a, b, float(k), float(d), float(w)) for a, b, k, d, w in rows], "a struct<setup:long,c:int>, b struct<setup:long,c:int>, k double, d double, w double")
    got = {tuple(r.cell): (r.scale, r.offset) for r in coefficients.solve(table, 0.1, local=local, rounds=rounds).collect()}
    want = dense(rows, 0.1)
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-6) for c in want)
    assert local or 0 < rounds[0] <= 60
    assert coefficients.solve(table.limit(0), 0.1, local=local).count() == 0
