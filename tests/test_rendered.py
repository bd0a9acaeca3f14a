import numpy as np
import pandas as pd
import pytest

from volumetra.operators import registration as reg
from volumetra.operators import rendered
from volumetra.sources import chunks as ch

RNG = np.random.default_rng(5)
SIZES = {(0, 0): (40, 36, 12), (0, 1): (38, 40, 12), (1, 0): (30, 30, 10)}
MAPS = {(0, 0): (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), (0, 1): (0.9, -0.4, 0, 14.3, 0.4, 0.9, 0, -6.2, 0, 0, 1.1, 0.5), (1, 0): (0, 1, 0, 9, -1, 0, 0, 33, 0, 0, 1, 1)}
CELLS = (3, 2, 2)


def boxes(m, size):
    c = np.stack(np.meshgrid(*[(0, n - 1) for n in size], indexing="ij"), axis=-1).reshape(-1, 3)
    w = c @ np.array(m, float).reshape(3, 4)[:, :3].T + np.array(m, float).reshape(3, 4)[:, 3]
    return np.floor(w.min(0)).astype(int), np.ceil(w.max(0)).astype(int)


def brute(images, scale, low, high):
    """Every voxel a row, then a join on the cell of the world."""
    rows = []
    for key, a in images.items():
        i = np.stack(np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij"), axis=-1).reshape(-1, 3)
        m = np.array(MAPS[key], float).reshape(3, 4)
        w = np.floor((i @ m[:, :3].T + m[:, 3]) * scale).astype(int)
        cell = np.ravel_multi_index(np.floor(i * np.array(CELLS) / np.array(a.shape)).astype(int).T, CELLS)
        rows.append(pd.DataFrame({"tp": key[0], "setup": key[1], "wx": w[:, 0], "wy": w[:, 1], "wz": w[:, 2], "cell": cell, "v": a.reshape(-1)}))
    v = pd.concat(rows).groupby(["tp", "setup", "cell", "wx", "wy", "wz"], as_index=False).v.mean()
    v = v[(v.v >= low) & (v.v <= high)]
    m = v.merge(v, on=["wx", "wy", "wz"], suffixes=("", "_b"))
    return m[(m.tp < m.tp_b) | ((m.tp == m.tp_b) & (m.setup < m.setup_b))]


@pytest.fixture(scope="module")
def data(spark):
    images = {k: RNG.integers(0, 200, n).astype("u2") for k, n in SIZES.items()}
    chunks = ch.from_arrays(spark, images, (16, 20, 8))
    views = spark.createDataFrame([(*k, [float(x) for x in MAPS[k]], 1.0, 1.0, 1.0, *n) for k, n in SIZES.items()], "tp int, setup long, m array<double>, fx double, fy double, fz double, nx long, ny long, nz long")
    keys = sorted(SIZES)
    pairs = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            ends = [boxes(MAPS[k], SIZES[k]) for k in (a, b)]
            pairs.append((*a, *b, *[int(e[s][x]) for e in ends for x in range(3) for s in (0, 1)]))
    faces = [f"{x}{i}{s}" for s in ("", "_b") for x in "xyz" for i in (0, 1)]
    pairs = spark.createDataFrame(pairs, "tp int, setup long, tp_b int, setup_b long, " + ", ".join(f"{c} long" for c in faces))
    return images, chunks, views, pairs


@pytest.mark.parametrize(("scale", "block"), [(1.0, 16), (0.5, 8), (0.25, 64)])
def test_values_are_those_of_all_voxels(data, scale, block):
    from pyspark.sql import functions as F

    images, chunks, views, pairs = data
    grid = views.withColumn("m", F.transform("m", lambda c: c * scale))
    found = rendered.cell_values(pairs, grid, chunks, CELLS, scale, 5.0, 190.0, block)
    got: dict = {}
    for r in found.collect():
        x, y = rendered.unpacked([r.v])
        assert len(x) == r.n
        got.setdefault((r.tp, r.setup, r.tp_b, r.setup_b, r.cell, r.cell_b), []).extend(zip(x.round(9).tolist(), y.round(9).tolist(), strict=True))
    want: dict = {}
    for r in brute(images, scale, 5.0, 190.0).itertuples():
        want.setdefault((r.tp, r.setup, r.tp_b, r.setup_b, r.cell, r.cell_b), []).append((round(r.v, 9), round(r.v_b, 9)))
    assert got.keys() == want.keys() and len(got) > 10
    assert all(sorted(got[k]) == sorted(want[k]) for k in want)


def test_fit_is_that_of_matched_rows(spark, data):
    images, chunks, views, pairs = data
    values = rendered.cell_values(pairs, views, chunks, CELLS)
    m = brute(images, 1.0, 0.0, np.inf)
    for method, options in (("HISTOGRAM", {}), ("RANSAC", {"iterations": 50, "max_error": 80.0})):
        fit = {(r.tp, r.setup, r.tp_b, r.setup_b, r.cx, r.cy, r.cz, r.cx_b, r.cy_b, r.cz_b): (r.n, r.scale, r.offset) for r in rendered.match_cells(values, CELLS, method, 300, **options).collect()}
        n = 0
        for key, own in m.groupby(["tp", "setup", "tp_b", "setup_b", "cell", "cell_b"]):
            at = (*key[:4], *np.unravel_index(key[4], CELLS), *np.unravel_index(key[5], CELLS))
            if len(own) < 300:
                assert at not in fit
                continue
            one = spark.createDataFrame([(0, 1, 0, 0, 0, float(a), float(b)) for a, b in zip(own.v, own.v_b, strict=True)], "setup long, setup_b long, cx long, cy long, cz long, v double, v_b double")
            [want] = reg.match_intensities(one, method, 300, **options).collect()
            assert fit[at][0] == want.n and np.allclose(fit[at][1:], (want.scale, want.offset), atol=1e-6)
            n += 1
        assert n == len(fit) > 2


def test_no_voxel_rows(data):
    _, chunks, views, pairs = data
    plan = rendered.match_cells(rendered.cell_values(pairs, views, chunks, CELLS), CELLS)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("MapInPandas") >= 1


def test_nothing(spark, data):
    _, chunks, views, pairs = data
    for some in ((pairs.limit(0), views, chunks), (pairs, views.limit(0), chunks), (pairs, views, chunks.limit(0))):
        assert rendered.match_cells(rendered.cell_values(*some, CELLS), CELLS, "HISTOGRAM", 1).count() == 0


def test_stored_level(spark):
    """Means of a level's voxels are those of full resolution where its cells lie in the grid's."""
    images = {(0, 0): RNG.integers(0, 200, (32, 16, 8)).astype("f4"), (0, 1): RNG.integers(0, 200, (24, 16, 8)).astype("f4")}
    chunks = ch.pyramid(ch.from_arrays(spark, images, (16, 16, 8)), [(1, 1, 1), (2, 2, 1)], (8, 8, 8))
    world = {(0, 0): (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), (0, 1): (1, 0, 0, 12, 0, 1, 0, 4, 0, 0, 1, 0)}
    pairs = spark.createDataFrame([(0, 0, 0, 1, 0, 31, 0, 15, 0, 7, 12, 35, 4, 19, 0, 7)], "tp int, setup long, tp_b int, setup_b long, " + ", ".join(f"{x}{i}{s} long" for s in ("", "_b") for x in "xyz" for i in (0, 1)))
    got = []
    for level, f in ((0, (1, 1, 1)), (1, (2, 2, 1))):
        rows = []
        for k, m in world.items():
            m = np.array(m, float).reshape(3, 4)
            m[:, 3] += m[:, :3] @ ((np.array(f) - 1) / 2) + 0.5
            m[:, :3] *= f
            rows.append((*k, (m * 0.25).ravel().tolist(), *[float(v) for v in f], *images[k].shape))
        views = spark.createDataFrame(rows, "tp int, setup long, m array<double>, fx double, fy double, fz double, nx long, ny long, nz long")
        values = rendered.cell_values(pairs, views, chunks.filter(f"level = {level}"), (2, 2, 1), 0.25, block=4).collect()
        got.append(sorted((r.cell, r.cell_b, *v) for r in values for v in zip(*[x.round(3).tolist() for x in rendered.unpacked([r.v])], strict=True)))
    assert got[0] == got[1] and len(got[0]) > 20
