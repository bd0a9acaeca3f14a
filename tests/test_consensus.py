import numpy as np
import pytest

from volumetra.operators import consensus
from volumetra.operators import registration as reg
from volumetra.operators.kernels import models

RNG = np.random.default_rng(12)
COLUMNS = "setup long, setup_b long, x double, y double, z double, x_b double, y_b double, z_b double"


def cloud(n, m, wrong, noise=0.3):
    p = RNG.uniform(0, 200, (n, 3))
    q = models.apply(np.array(m, float).reshape(3, 4), p) + RNG.normal(0, noise, (n, 3))
    bad = RNG.random(n) < wrong
    q[bad] = RNG.uniform(0, 200, (bad.sum(), 3))
    return np.hstack([p, q])


def rows(spark, groups):
    return spark.createDataFrame([(*k, *[float(v) for v in r]) for k, a in groups.items() for r in a], COLUMNS)


TURNED = (0.8, -0.6, 0, 12, 0.6, 0.8, 0, -7, 0, 0, 1, 3)
MOVED = (1, 0, 0, -30, 0, 1, 0, 4, 0, 0, 1, 9)


@pytest.mark.parametrize("model", ["TRANSLATION", "RIGID", "AFFINE"])
def test_models_are_those_of_the_kernel(spark, model):
    m = MOVED if model == "TRANSLATION" else TURNED
    groups = {(0, 1): cloud(3000, m, 0.5), (0, 2): cloud(400, MOVED, 0.3), (1, 2): cloud(300, m, 1.0)}
    options = {"iterations": 300, "max_error": 2.0, "min_ratio": 0.2}
    got = {(r.setup, r.setup_b): r for r in consensus.large_models(rows(spark, groups), model, sample=1000, **options).collect()}
    want = {k: models.ransac(a[:, :3], a[:, 3:], model, **options) for k, a in groups.items()}
    assert got.keys() == {k for k, w in want.items() if w} == {(0, 1), (0, 2)}
    for k, r in got.items():
        assert r.n == want[k][1].sum() and np.allclose(r.model, want[k][0].ravel(), atol=1e-6)


def test_several_sets_and_repeated_rows(spark):
    one, two = cloud(1500, MOVED, 0.0), cloud(700, TURNED, 0.0)
    groups = {(0, 1): np.vstack([one, two, np.repeat(cloud(1, MOVED, 0.0), 900, axis=0)])}
    found = consensus.large_models(rows(spark, groups), "RIGID", True, iterations=200, max_error=2.0, sample=500).orderBy("consensus").collect()
    assert [r.consensus for r in found] == [0, 1] and found[0].n >= 2390 and found[1].n >= 690
    assert np.abs(np.array(found[1].model) - TURNED).max() < 0.2


def test_both_ways_in_one_call(spark):
    groups = {(0, 1): cloud(900, MOVED, 0.2), (0, 2): cloud(100, MOVED, 0.2)}
    found = reg.robust_models(rows(spark, groups), "TRANSLATION", local=500, iterations=100, max_error=2.0)
    assert {(r.setup, r.setup_b, r.consensus) for r in found.collect()} == {(0, 1, 0), (0, 2, 0)}


def test_nothing(spark):
    assert consensus.large_models(rows(spark, {(0, 1): cloud(3, MOVED, 0.0)}), "RIGID").count() == 0
    assert consensus.large_models(rows(spark, {(0, 1): cloud(3, MOVED, 0.0)}).limit(0), "RIGID", True).count() == 0


def test_models_are_counted_without_a_row_for_each(spark):
    """Every model's count is that of the kernel; candidates are not multiplied by models, nor sorted."""
    groups = {(0, 1): cloud(500, MOVED, 0.5), (0, 2): cloud(40, MOVED, 0.2)}
    tried = {(0, 1): [MOVED, TURNED, np.eye(3, 4).ravel()], (0, 2): [MOVED]}
    guesses = spark.createDataFrame([(*k, [[float(x) for x in m] for m in ms]) for k, ms in tried.items()], "setup long, setup_b long, ms array<array<double>>")
    found = consensus.counted(rows(spark, groups), guesses, 2.0)
    want = {(*k, h): int((models.errors(np.array(m, float).reshape(3, 4), groups[k][:, :3], groups[k][:, 3:]) <= 2.0).sum()) for k, ms in tried.items() for h, m in enumerate(ms)}
    assert {(r.setup, r.setup_b, r.h): r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "first(" not in plan
