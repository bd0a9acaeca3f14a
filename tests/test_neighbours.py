"""Neighbourhoods by blocks against whole arrays, and how much is shuffled."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.operators import neighbours, registration
from volumetra.operators.kernels import detection
from volumetra.sources import chunks as ch


def sparse(spark, shape, seed, share=0.7, low=(-5, 3, 0)):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 6, shape).astype(float)
    a[rng.random(shape) > share] = np.nan
    rows = [(7, *(int(i) + o for i, o in zip(p, low, strict=True)), float(a[tuple(p)])) for p in np.argwhere(~np.isnan(a))]
    return {r[1:4]: r[4] for r in rows}, spark.createDataFrame(rows, "setup int, x int, y int, z int, v double")


def collected(df):
    return {(r.x, r.y, r.z): r.v for r in df.collect()}


@pytest.mark.parametrize("block", [4, 64])
def test_against_single_voxels(spark, block):
    voxels, table = sparse(spark, (13, 9, 7), 1)
    around = lambda p, offsets: [voxels[q] for o in offsets if (q := tuple(a + b for a, b in zip(p, o, strict=True))) in voxels]
    near = [o for o in neighbours.box_offsets(1, 1, 1) if any(o)]
    for maxima, better in ((True, lambda v, n: all(v > x for x in n)), (False, lambda v, n: all(v < x for x in n))):
        assert collected(neighbours.extrema(table, ("setup",), maxima, block)) == {p: v for p, v in voxels.items() if better(v, around(p, near))}
    for disk in (False, True):
        offsets = neighbours.disk_offsets(2) if disk else neighbours.box_offsets(2, 2, 0)
        want = {p: v / m if (m := np.median(around(p, offsets))) > 0 else 0.0 for p, v in voxels.items()}
        assert collected(neighbours.median_ratio(table, 2, ("setup",), disk, block)) == pytest.approx(want)
    kernel = {(0, 0, 0): 2.0, (1, 0, -1): -0.5, (-2, 1, 0): 0.25}
    want = {p: sum(w * voxels.get(tuple(a - b for a, b in zip(p, o, strict=True)), 0.0) for o, w in kernel.items()) for p in voxels}
    assert collected(neighbours.filtered(table, kernel, ("setup",), block)) == pytest.approx(want)
    assert neighbours.extrema(table.limit(0), ("setup",)).count() == 0
    with pytest.raises(ValueError):
        neighbours.median_ratio(table, 3, ("setup",), block=4)


def test_only_borders_are_sent_twice(spark):
    whole = spark.range(128 * 128 * 16).select((F.col("id") % 128).alias("x"), (F.expr("id div 128") % 128).alias("y"), F.expr("id div 16384").alias("z"), F.lit(1.0).alias("v"))
    for reach in ((1, 1, 1), (2, 2, 0), (2, 0, 0)):
        assert neighbours.with_borders(whole, reach).count() < 1.2 * 128 * 128 * 16


def test_detection_by_blocks(spark):
    """Blocks, chunks and missing chunks do not change what is found; nothing is joined, and slabs alone are sent twice."""
    rng = np.random.default_rng(2)
    idx = np.stack(np.meshgrid(*[np.arange(n) for n in (90, 60, 30)], indexing="ij"), axis=-1)
    a = sum(150 * np.exp(-0.5 * ((idx - c) ** 2).sum(axis=-1) / 1.8**2) for c in rng.uniform([4, 4, 4], [85, 55, 25], (25, 3))).astype("f4")
    want = np.array(sorted(map(tuple, detection.detect(a, 1.8, 0.01, 0, 255)[0])))
    for chunk, block in itertools.product([(16, 16, 16), (50, 64, 30)], [(32, 32, 32), (192, 192, 96)]):
        found = registration.detect_points(ch.from_arrays(spark, {(0, 1): a}, chunk), 1.8, 0.01, 0, 255, block=block)
        got = np.array(sorted((r.x, r.y, r.z) for r in found.collect()))
        assert got.shape == want.shape and np.abs(got - want).max() < 1e-3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    names = re.findall(r"^[ :+-]*(\w+)", plan, re.M)
    assert "Join" not in names and names.count("FlatMapGroupsInPandas") == names.count("MapInPandas") == 1 and "RepartitionByExpression" not in names
