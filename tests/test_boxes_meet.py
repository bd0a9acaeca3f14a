import numpy as np
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.operators import registration as reg
from volumetra.sources import chunks as ch

RNG = np.random.default_rng(8)


def rotation(axis, angle):
    k = np.array(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def deepest(m, lo, hi, other_lo, other_hi, rounds=400):
    """Squared distance of the mapped box from the other, by projections onto one and the other in turn."""
    a, inverse = m[:, :3], np.linalg.inv(m[:, :3])
    p = (np.array(other_lo) + other_hi) / 2
    for _ in range(rounds):
        # The maps of the test turn without scaling, so that the nearest place of the box is the clipped one.
        q = a @ np.clip(inverse @ (p - m[:, 3]), lo, hi) + m[:, 3]
        p = np.clip(q, other_lo, other_hi)
    return float(((p - q) ** 2).sum())


def test_boxes_meet(spark):
    rows, want = [], []
    for _ in range(300):
        m = np.column_stack([rotation(RNG.normal(size=3), RNG.uniform(0, 3)), RNG.uniform(-3, 3, 3)])
        lo, other_lo = RNG.uniform(-4, 0, 3), RNG.uniform(-4, 0, 3)
        hi, other_hi = lo + RNG.uniform(0, 5, 3), other_lo + RNG.uniform(0, 5, 3)
        d = deepest(m, lo, hi, other_lo, other_hi)
        if 1e-12 < d < 1e-3:
            continue
        want.append(d <= 1e-12)
        rows.append((len(rows), *[[float(v) for v in x.ravel()] for x in (m, lo, hi, other_lo, other_hi)]))
    t = spark.createDataFrame(rows, "i int, m array<double>, lo array<double>, hi array<double>, p array<double>, q array<double>")
    at = lambda c: [F.col(c)[i] for i in range(3)]
    got = [r.met for r in t.select("i", g.boxes_meet(F.col("m"), at("lo"), at("hi"), at("p"), at("q")).alias("met")).orderBy("i").collect()]
    assert got == want and 20 < sum(want) < len(want) - 20


def test_fusion_of_turned_views_sends_fewer_parts(spark, monkeypatch):
    """A view turned by 45 degrees: the same voxels, from fewer parts of chunks than bounds alone send."""
    image = RNG.integers(1, 200, (64, 64, 4)).astype("f4")
    chunks = ch.from_arrays(spark, {(0, 0): image}, (8, 8, 4))
    c = np.sqrt(0.5)
    m = [float(v) for v in (c, -c, 0, 46, c, c, 0, 0, 0, 0, 1, 0)]
    views = spark.createDataFrame([(0, 0, 0, 0, m, 64, 64, 4, 0, 92, 0, 92, 0, 3)], "tp int, setup long, t_index int, c_index int, m array<double>, nx long, ny long, nz long, " + ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    blocks = [(0, 0, i, j, 0, 16 * i, 16 * i + 15, 16 * j, 16 * j + 15, 0, 3) for i in range(6) for j in range(6)]
    blocks = spark.createDataFrame(blocks, "t_index int, c_index int, gx int, gy int, gz int, " + ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    sent, found = [], []
    cut = reg._parts

    def counted(df, wanted):
        sent.append(df.count())
        return cut(df, wanted)

    monkeypatch.setattr(reg, "_parts", counted)
    for test in (g.boxes_meet, lambda *_: F.lit(True)):
        monkeypatch.setattr(g, "boxes_meet", test)
        found.append({(r.gx, r.gy): bytes(r.payload) for r in reg.fuse_views(blocks, views, chunks, "AVG").collect()})
    assert found[0] == found[1] and len(found[0]) > 20
    assert sent[0] < 0.8 * sent[1], sent
