"""Views are (timepoint, setup): nothing of one timepoint goes into another; overlaps lie in each view's own image."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.operators import points, spatial
from volumetra.operators import registration as reg
from volumetra.operators.kernels import models
from volumetra.sources import chunks as ch

RNG = np.random.default_rng(12)
SHIFTS = {0: 3, 1: -4}


@pytest.fixture(scope="module")
def films(spark):
    """Two timepoints, two tiles each; the second tile shows its scene further right at 0 and further left at 1."""
    arrays = {}
    for tp, n in SHIFTS.items():
        scene = RNG.uniform(0, 100, (60, 24, 8))
        arrays[(tp, 0)], arrays[(tp, 1)] = scene[8:48], scene[8 - n : 48 - n]
    return ch.from_arrays(spark, arrays, (16, 16, 8))


def test_stitching(spark, films):
    rows = [(t, 0, t, 1, 0, 39, 0, 23, 0, 7, 0, 0, 0, 0, 0, 0) for t in SHIFTS]
    pairs = spark.createDataFrame(rows, "tp int, setup long, tp_b int, setup_b long, ix0 long, ix1 long, iy0 long, iy1 long, iz0 long, iz1 long, tx long, ty long, tz long, tx_b long, ty_b long, tz_b long")
    got = {r.tp: (round(r.dx), round(r.dy), round(r.dz)) for r in reg.stitch_pairs(pairs, films).collect()}
    assert got == {t: (-n, 0, 0) for t, n in SHIFTS.items()}


def test_group_combination(spark):
    a, b = RNG.uniform(0, 9, (8, 8, 4)), RNG.uniform(20, 90, (8, 8, 4))
    chunks = ch.from_arrays(spark, {(0, 3): a, (0, 7): b, (1, 3): b, (1, 7): a}, (4, 8, 4))
    members = spark.createDataFrame([(t, s, 3) for t in (0, 1) for s in (3, 7)], "tp int, setup long, leader long")
    for how, want in (("AVERAGE", {0: (a + b) / 2, 1: (a + b) / 2}), ("PICK_BRIGHTEST", {0: b, 1: b})):
        out = reg.combined_views(chunks, members, how)
        assert {r.setup for r in out.select("setup").collect()} == {3}
        for t in (0, 1):
            got = np.concatenate([ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz)) for r in out.filter(F.col("tp") == t).orderBy("ox").collect()])
            assert np.allclose(got, want[t], atol=1e-4)


def view_table(spark, rows):
    """rows: (tp, setup, map, size)"""
    v = spark.createDataFrame([(t, s, [float(x) for x in m], *n) for t, s, m, n in rows], "tp int, setup long, m array<double>, nx long, ny long, nz long")
    lo, hi = g.containing_box(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"n{x}") - 1).cast("double") for x in "xyz"])
    return v.withColumns({f"{x}{i}": c for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))})


def test_nonrigid_fusion_keeps_timepoints_apart(spark):
    chunks = ch.from_arrays(spark, {(0, 0): np.full((20, 20, 6), 10.0), (1, 0): np.full((20, 20, 6), 90.0)}, (16, 16, 8))
    one = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    views = view_table(spark, [(t, 0, one, (20, 20, 6)) for t in (0, 1)]).withColumns({"t_index": F.col("tp"), "c_index": F.lit(0)})
    box = {f"{x}{i}": F.lit((0, n)[i]).cast("long") for x, n in zip("xyz", (19, 19, 5), strict=True) for i in (0, 1)}
    blocks = spark.range(2).select(F.col("id").cast("int").alias("t_index"), F.lit(0).alias("c_index"), *[F.lit(0).alias(f"g{x}") for x in "xyz"], *[c.alias(n) for n, c in box.items()])
    # Only the second timepoint has points: they move nothing.
    pts = [(1, 0, x, y, z, x, y, z) for x, y, z in itertools.product((2.0, 17.0), (2.0, 17.0), (1.0, 4.0))]
    out = reg.fuse_nonrigid(blocks, views, chunks, spark.createDataFrame(pts, "tp int, setup long, x double, y double, z double, cx double, cy double, cz double"))
    got = {r.t_index: ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz)) for r in out.collect()}
    assert np.allclose(got[0], 10, atol=0.01) and np.allclose(got[1][2:18, 2:18, 1:5], 90, atol=0.01)


def test_intensities_and_coefficients(spark):
    rows = []
    for t, (k, d) in {0: (2.0, 5.0), 1: (0.5, 30.0)}.items():
        for x, y in itertools.product(range(24), range(24)):
            v = 40.0 + 7 * ((x * 5 + y * 3) % 11)
            rows += [(t, 0, x + 1000 * t, y, 0, v), (t, 1, x + 1000 * t, y, 0, k * v + d)]
    m = points.cell_matches(spark.createDataFrame(rows, "tp int, setup long, x long, y long, z long, v double"), (5000, 5000, 5000))
    assert m.filter("tp <> tp_b").count() == 0
    fit = {r.tp: (r.scale, r.offset) for r in reg.match_intensities(m, "HISTOGRAM", 100).collect()}
    assert fit[0] == pytest.approx((2, 5)) and fit[1] == pytest.approx((0.5, 30))
    solved = reg.solve_intensities(reg.match_intensities(m, "HISTOGRAM", 100), 0.01)
    got = {(r.tp, r.setup): (r.scale, r.offset) for r in solved.collect()}
    for t, (k, d) in {0: (2.0, 5.0), 1: (0.5, 30.0)}.items():
        (s, o), (s2, o2) = got[t, 0], got[t, 1]
        assert abs(s * 100 + o - (s2 * (k * 100 + d) + o2)) < 2

    chunks = ch.from_arrays(spark, {(0, 0): np.full((8, 8, 4), 10.0), (1, 0): np.full((8, 8, 4), 10.0)})
    views = view_table(spark, [(t, 0, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), (8, 8, 4)) for t in (0, 1)]).withColumns({"t_index": F.col("tp"), "c_index": F.lit(0)})
    box = {f"{x}{i}": F.lit((0, n)[i]).cast("long") for x, n in zip("xyz", (7, 7, 3), strict=True) for i in (0, 1)}
    blocks = spark.range(2).select(F.col("id").cast("int").alias("t_index"), F.lit(0).alias("c_index"), *[F.lit(0).alias(f"g{x}") for x in "xyz"], *[c.alias(n) for n, c in box.items()])
    c = spark.createDataFrame([(t, 0, 0, 0, 0, 1.0 + t, 0.0) for t in (0, 1)], "tp int, setup long, cx int, cy int, cz int, scale double, offset double")
    out = {r.t_index: ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz)).mean() for r in reg.fuse_views(blocks, views, chunks, "AVG", coefficients=c, cells=1).collect()}
    assert out[0] == pytest.approx(10) and out[1] == pytest.approx(20)


def test_points_of_timepoints(spark):
    pts = spark.createDataFrame([(0, 1, 5, 5.0, 5.0, 5.0, 1.0), (1, 1, 5, 50.0, 5.0, 5.0, 2.0)], "tp int, setup long, id long, x double, y double, z double, intensity double")
    views = spark.createDataFrame([(0, 1, 0, 9, 0, 9, 0, 9), (0, 2, 0, 9, 0, 9, 0, 9), (1, 1, 40, 60, 0, 9, 0, 9)], "tp int, setup long, x0 long, x1 long, y0 long, y1 long, z0 long, z1 long")
    assert [(r.tp, r.id) for r in points.in_other_views(pts, views, 32).collect()] == [(0, 5)]
    assert sorted(map(tuple, points.padded(views, pts).collect())) == [(0, 1, 1), (0, 2, 0), (1, 1, 1)]
    pairs = spark.createDataFrame([(0, 1, 0, 2), (1, 1, 1, 2)], "tp int, setup long, tp_b int, setup_b long")
    fixed = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "tp int, setup long")
    assert [r.tp for r in points.without_fixed(pairs, fixed, F.lit(False)).collect()] == [1]


def test_local_overlaps_against_brute_force(spark):
    """Shifted and turned views: which voxels of each image another image covers, both ways of each pair."""
    turned = (0, -1, 0, 60, 1, 0, 0, 5, 0, 0, 1, 2)
    views = [(0, 0, (1, 0, 0, 10, 0, 1, 0, 20, 0, 0, 1, 0), (40, 30, 8)), (0, 1, (1, 0, 0, 35, 0, 1, 0, 25, 0, 0, 1, 3), (40, 30, 8)), (1, 2, turned, (50, 24, 8))]
    got = {(r.tp, r.setup, r.interval): tuple(r[f"{x}{i}"] for x in "xyz" for i in (0, 1)) for r in spatial.local_overlaps(view_table(spark, views), 16).collect()}
    want = {}
    for (t, s, m, n), (t2, s2, m2, n2) in itertools.permutations(views, 2):
        a, b = np.array(m, float).reshape(3, 4), np.array(m2, float).reshape(3, 4)
        idx = np.stack(np.meshgrid(*[np.arange(k) for k in n], indexing="ij"), axis=-1).reshape(-1, 3)
        there = (models.apply(a, idx) - b[:, 3]) @ b[:, :3]  # the maps are rotations
        inside = idx[((there >= -1e-9) & (there <= np.array(n2) - 1 + 1e-9)).all(axis=1)]
        if len(inside):
            want[t, s, f"{t2},{s2}"] = tuple(int(v) for lo, hi in zip(inside.min(axis=0), inside.max(axis=0)) for v in (lo, hi))
    assert got == want and len(got) == 6
    same = spatial.local_overlaps(view_table(spark, views), 16, F.expr("tp = tp_b")).count()
    assert same == 2
    pts = spark.createDataFrame([(0, 0, 1, 39.0, 29.0, 7.0), (0, 0, 2, 0.0, 0.0, 0.0)], "tp int, setup long, id long, x double, y double, z double")
    assert [r.id for r in points.in_intervals(pts, spatial.local_overlaps(view_table(spark, views), 16), 16).collect()] == [1]


@pytest.mark.parametrize("model", ["TRANSLATION", "RIGID", "AFFINE"])
def test_moments_give_the_fit_of_all_places(spark, model):
    p = RNG.uniform(0, 100, (300, 3))
    q = p @ np.array([[1, 0.1, 0], [-0.1, 1, 0], [0, 0, 1]]) + [5, 6, 7] + RNG.normal(size=(300, 3))
    rows = spark.createDataFrame([("a", "b", 1.0, *map(float, x), *map(float, y)) for x, y in zip(p, q)], "a string, b string, weight double, x double, y double, z double, x_b double, y_b double, z_b double")
    m, _ = reg.solve_links(reg.link_moments(rows, ["a", "b", "weight"]), ["a", "b"], {"a"}, model=model, iterations=50, plateau=5)
    assert np.allclose(m["b"], models.fit(q, p, model), atol=1e-5)
