import numpy as np
import pytest

from volumetra.operators import points
from volumetra.operators.kernels import models


@pytest.mark.parametrize("block", [2, 16])
def test_clusters_over_blocks(spark, block):
    """Chains over block borders, dense heaps and single points, in two groups; as of all points at once."""
    rng = np.random.default_rng(4)
    chain = np.stack([np.arange(60) * 0.9, np.sin(np.arange(60)), np.zeros(60)], axis=1)
    xyz = np.concatenate([rng.uniform(-30, 30, (150, 3)), chain, rng.normal(5, 0.2, (40, 3)), [[1.0, 1.0, 1.0]] * 3])
    view = rng.integers(0, 2, len(xyz))
    view[150:210] = 1
    rows = [(int(v), i, *map(float, p)) for i, (v, p) in enumerate(zip(view, xyz, strict=True))]
    table = spark.createDataFrame(rows, "setup int, id long, x double, y double, z double").repartition(3)
    got = {}
    for r in points.clustered(table, 1.5, ["setup"], block=block).collect():
        got.setdefault((r.setup, r.gid), set()).add(r.id)
    want = {}
    for v in (0, 1):
        own = np.flatnonzero(view == v)
        for i, label in zip(own, models.clusters(xyz[own], 1.5), strict=True):
            want.setdefault((v, label), set()).add(int(i))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    means = {r.id: (r.n, r.x) for r in points.merged(table, 1.5, ["setup"]).collect()}
    assert means.keys() == {min(c) for c in want.values()} and all(means[min(c)] == (len(c), pytest.approx(xyz[sorted(c), 0].mean())) for c in want.values())
    members = points.grouped(table, 1.5, ["setup"]).collect()
    assert len(members) == len(xyz) and len({r.gid for r in members}) == len(want)
    assert points.merged(table.limit(0), 1.5, ["setup"]).count() == 0
    assert points.dedupe_lists(table.limit(0), 1.5, ["setup"], "id").count() == 0


def test_dense_heaps_cost_their_places(spark, monkeypatch):
    """Repeated points are one place, and cells that are linked already are not met."""
    rng = np.random.default_rng(6)
    heap = rng.integers(0, 12, (20_000, 3)).astype(float)
    seen = []
    real = models.np.unique
    monkeypatch.setattr(models.np, "unique", lambda a, **k: (seen.append(len(a)), real(a, **k))[1])
    assert len(set(models.clusters(np.vstack([heap, heap + 100]), 1.0).tolist())) == 2
    monkeypatch.undo()
    rows = [(0, i, *p) for i, p in enumerate(heap.tolist())]
    table = spark.createDataFrame(rows, "setup int, id long, x double, y double, z double")
    stored = []
    got = points.clustered(table, 1.0, ["setup"], store=lambda df: (stored.append(df.count()), points.stored(df))[1])
    assert stored[0] == 12**3 and got.count() == len(heap) and got.select("gid").distinct().count() == 1


@pytest.mark.parametrize("radius", [0.7, 1.5, 3.0])
def test_clusters_are_those_of_all_pairs(radius):
    p = np.random.default_rng(8).uniform(-8, 8, (400, 3))
    label = np.arange(len(p))
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= radius * radius
    while True:
        new = np.where(near, label[None], len(p)).min(axis=1)
        if (new == label).all():
            break
        label = new
    found = models.clusters(p, radius)
    assert len({*zip(label.tolist(), found.tolist(), strict=True)}) == len(set(label.tolist())) == len(set(found.tolist()))


def test_lists_are_deduplicated_without_broadcasts(spark):
    """What was taken is shuffled, and of points at one place all are kept or none."""
    rows = [(0, i, label, float(x), 0.0, 0.0) for i, (label, x) in enumerate([("a", 0), ("a", 0), ("b", 3), ("b", 9), ("b", 9), ("c", 12.5), ("c", 13.5), (None, 20), ("b", 20.5)])]
    table = spark.createDataFrame(rows, "setup int, id long, label string, x double, y double, z double")
    assert "Broadcast" not in points.far_from(table, table.filter("label = 'a'"), 4, ["setup"])._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in points.dedupe_lists(table, 4.0, ["setup"], "label").collect()) == [0, 1, 3, 4, 6, 7]
