import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from volumetra.operators import registration as reg
from volumetra.operators.kernels import detection
from volumetra.sources import chunks as ch

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def scene():
    grid = RNG.uniform([3, 3, 3], [117, 57, 21], (90, 3))
    a = np.zeros((120, 60, 24))
    idx = np.stack(np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij"), axis=-1)
    for c in grid:
        a += 150 * np.exp(-0.5 * ((idx - c) ** 2).sum(axis=-1) / 1.8**2)
    return a


@pytest.fixture(scope="module")
def tiles(spark, scene):
    """Two tiles of the scene; the second is said to start at 60 but shows the scene from 57, 2, 1 on."""
    arrays = {(0, 0): scene[:80, :55, :22], (0, 1): scene[57:117, 2:57, 1:23]}
    return arrays, ch.from_arrays(spark, arrays, (32, 32, 16))


def array_of(chunks, shape, lo=(0, 0, 0)):
    out = np.zeros(shape)
    for r in chunks.collect():
        at = tuple(slice(o - x, o - x + s) for o, s, x in zip((r.ox, r.oy, r.oz), (r.sx, r.sy, r.sz), lo, strict=True))
        out[at] = ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
    return out


def test_chunks_round_trip_and_pyramid(spark, tiles, tmp_path):
    arrays, chunks = tiles
    a = arrays[(0, 0)]
    assert np.allclose(array_of(chunks.filter("setup = 0"), a.shape), a, atol=1e-4)
    ch.write(chunks, str(tmp_path / "c"))
    assert np.allclose(array_of(ch.read(spark, str(tmp_path / "c")).filter("setup = 0"), a.shape), a, atol=1e-4)
    low = ch.pyramid(chunks.filter("setup = 0"), [(1, 1, 1), (2, 2, 1), (2, 2, 2)], (32, 32, 16)).filter("level = 2")
    want = detection.halved(detection.halved(a, (2, 2, 1)), (2, 2, 2))
    assert np.allclose(array_of(low, want.shape), want, atol=1e-3)
    again = ch.rechunked(chunks.filter("setup = 0"), (50, 20, 9))
    assert np.allclose(array_of(again, a.shape), a, atol=1e-4) and again.count() == 2 * 3 * 3
    for codec in ("raw", "gzip", "zstandard"):
        path = "file://" + str(tmp_path / codec)
        ch.write_zarr(chunks, path, (40, 40, 20), codec)
        assert np.allclose(array_of(ch.read_zarr(spark, path, 0, 0), a.shape), a, atol=1e-4)
    assert ch.to_voxels(chunks.filter("setup = 0")).count() == a.size
    zero = ch.from_arrays(spark, {(0, 0): np.zeros((4, 4, 4)), (0, 1): np.ones((4, 4, 4))})
    assert ch.non_empty(zero).count() == 1


def test_detection_over_chunks_equals_the_whole(spark, tiles):
    arrays, chunks = tiles
    got = reg.detect_points(chunks, 1.8, 0.01, 0, 255).filter("setup = 0").collect()
    want, _ = detection.detect(arrays[(0, 0)].astype("f4"), 1.8, 0.01, 0, 255)
    got = np.array(sorted((r.x, r.y, r.z) for r in got))
    want = np.array(sorted(map(tuple, want)))
    # At the images' borders mirrored halos differ from nothing: none here, as neighbours send their slabs.
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-3


def test_stitch_match_solve(spark, tiles):
    _, chunks = tiles
    pair = spark.createDataFrame([(0, 1, 60, 79, 0, 54, 0, 21, 0, 0, 0, 60, 0, 0)], "setup long, setup_b long, ix0 long, ix1 long, iy0 long, iy1 long, iz0 long, iz1 long, tx long, ty long, tz long, tx_b long, ty_b long, tz_b long")
    [link] = reg.stitch_pairs(pair, chunks).collect()
    assert np.abs(np.array([link.dx, link.dy, link.dz]) - [-3, 2, 1]).max() < 0.5 and link.r > 0.9

    points = reg.detect_points(chunks, 1.8, 0.01, 0, 255)
    points = points.withColumn("id", F.row_number().over(Window.partitionBy("setup").orderBy("x", "y", "z")))
    world = points.withColumn("x", F.col("x") + F.when(F.col("setup") == 1, 60).otherwise(0))
    found = reg.match_points(pair, world, "FAST_TRANSLATION", significance=2.0, redundancy=2, model="TRANSLATION", max_error=1.5, min_inliers=4).cache()
    rows = found.collect()
    assert len(rows) >= 4
    shift = np.mean([[r.x - r.x_b, r.y - r.y_b, r.z - r.z_b] for r in rows], axis=0)
    assert np.abs(shift - [-3, 2, 1]).max() < 0.3
    assert reg.robust_models(found, "TRANSLATION", max_error=1.5, min_inliers=4).first().n == len(rows)
    icp = reg.match_points(pair, world, "ICP", model="TRANSLATION", max_error=6.0)
    assert icp.count() >= 5

    links = found.groupBy(F.col("setup").alias("a"), F.col("setup_b").alias("b")).agg(F.collect_list(F.array("x", "y", "z")).alias("p"), F.collect_list(F.array("x_b", "y_b", "z_b")).alias("q")).withColumn("weight", F.lit(1.0))
    for method in ("ONE_ROUND_SIMPLE", "ONE_ROUND_ITERATIVE", "TWO_ROUND_SIMPLE", "TWO_ROUND_ITERATIVE"):
        m, _ = reg.solve_links(links, [0, 1], {0}, method, model="TRANSLATION", iterations=500, plateau=20)
        assert np.abs(m[1][:, 3] - [-3, 2, 1]).max() < 0.3 and np.allclose(m[0], np.eye(3, 4))


def fusion_input(spark, sizes, maps):
    from volumetra.functions import geometry as g

    v = spark.createDataFrame([(0, s, 0, 0, [float(x) for x in m], *n) for (s, n), m in zip(sizes.items(), maps, strict=True)], "tp int, setup long, t_index int, c_index int, m array<double>, nx long, ny long, nz long")
    lo, hi = g.containing_box(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"n{x}") - 1).cast("double") for x in "xyz"])
    return v.withColumns({f"{x}{i}": c for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))})


def blocks(spark, box, size):
    from volumetra.operators import blocks as b

    row = spark.createDataFrame([box], ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    return b.block_boxes(b.grid(row, size)).withColumns({"t_index": F.lit(0), "c_index": F.lit(0)})


@pytest.mark.parametrize("strategy", ["AVG", "AVG_BLEND", "CLOSEST_PIXEL_WINS"])
def test_fusion_of_known_places_gives_the_scene(spark, scene, tiles, strategy):
    _, chunks = tiles
    views = fusion_input(spark, {0: (80, 55, 22), 1: (60, 55, 22)}, [(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), (1, 0, 0, 57, 0, 1, 0, 2, 0, 0, 1, 1)])
    out = reg.fuse_views(blocks(spark, (0, 116, 0, 56, 0, 22), (48, 48, 48)), views, chunks, strategy)
    got = array_of(out, (117, 57, 23))
    covered = np.zeros(got.shape, bool)
    covered[:80, :55, :22] = True
    covered[57:117, 2:57, 1:23] = True
    assert np.abs(got - scene[:117, :57, :23])[covered].max() < 1e-2 and not got[~covered].any()


def test_masks_types_and_coefficients(spark, tiles):
    _, chunks = tiles
    views = fusion_input(spark, {0: (80, 55, 22)}, [(1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0)])
    b = blocks(spark, (0, 99, 0, 54, 0, 21), (64, 64, 64))
    mask = array_of(reg.fuse_views(b, views, chunks, dtype="UINT8", masks=True), (100, 55, 22))
    assert (mask[10:90] == 255).all() and not mask[:10].any() and not mask[90:].any()
    c = spark.createDataFrame([(0, i, j, k, 2.0, 5.0) for i in range(2) for j in range(2) for k in range(2)], "setup long, cx int, cy int, cz int, scale double, offset double")
    plain = array_of(reg.fuse_views(b, views, chunks, "AVG"), (100, 55, 22))
    more = array_of(reg.fuse_views(b, views, chunks, "AVG", coefficients=c, cells=2), (100, 55, 22))
    assert np.abs(more[10:90] - 2 * plain[10:90] - 5).max() < 1e-3
    scaled = array_of(reg.fuse_views(b, views, chunks, "AVG", "UINT16", 0, 300), (100, 55, 22))
    assert np.abs(scaled - np.clip(plain / 300, 0, 1) * 65535).max() <= 0.51


def test_nonrigid_fusion_without_deformation_moves_nothing(spark, scene, tiles):
    _, chunks = tiles
    views = fusion_input(spark, {0: (80, 55, 22), 1: (60, 55, 22)}, [(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), (1, 0, 0, 60, 0, 1, 0, 0, 0, 0, 1, 0)])
    # The second view's points say that it belongs 3 to the left and 2, 1 further.
    p = [(1, x, y, z, x - 3.0, y + 2.0, z + 1.0) for x in (65.0, 110.0) for y in (5.0, 50.0) for z in (2.0, 20.0)]
    points = spark.createDataFrame(p, "setup long, x double, y double, z double, cx double, cy double, cz double")
    out = reg.fuse_nonrigid(blocks(spark, (0, 116, 0, 56, 0, 22), (128, 128, 128)), views, chunks, points)
    got = array_of(out, (117, 57, 23))
    assert np.abs(got - scene[:117, :57, :23])[3:112, 4:53, 2:20].max() < 1.0


def test_intensities(spark):
    rng = np.random.default_rng(2)
    rows = [(s, x, y, 0, float(100 + 50 * np.sin(x / 3 + y)) * (1 if s == 0 else 1.5) + (0 if s == 0 else 10) + rng.normal() * 0.1) for s in (0, 1) for x in range(32) for y in range(32)]
    from volumetra.operators import points

    v = spark.createDataFrame(rows, "setup long, x long, y long, z long, v double")
    m = points.cell_matches(v, (16, 16, 16))
    for method in ("RANSAC", "HISTOGRAM"):
        fit = reg.match_intensities(m, method, at_least=100).collect()
        assert len(fit) == 4 and all(abs(r.scale - 1.5) < 0.02 and abs(r.offset - 10) < 2 for r in fit)
    solved = {(r.setup, r.cx, r.cy): r for r in reg.solve_intensities(reg.match_intensities(m, at_least=100), 0.01).collect()}
    a, b = solved[(0, 0, 0)], solved[(1, 0, 0)]
    assert abs(a.scale * 100 + a.offset - (b.scale * 160 + b.offset)) < 3


def turned(degrees, at):
    """The map that turns about z around the origin and then moves."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return [float(v) for v in (c, -s, 0, at[0], s, c, 0, at[1], 0, 0, 1, at[2])]


def seen_through(scene, m, shape):
    """What a view with this map to the world shows of the scene; 0 outside of it."""
    m = np.array(m).reshape(3, 4)
    at = np.stack(np.meshgrid(*[np.arange(n, dtype=float) for n in shape], indexing="ij"), axis=-1).reshape(-1, 3) @ m[:, :3].T + m[:, 3]
    inside = ((at >= 0) & (at <= np.array(scene.shape) - 1)).all(axis=1)
    return np.where(inside, detection.sample(scene, np.where(inside[:, None], at, 0)), 0).reshape(shape)


@pytest.mark.parametrize(("degrees", "factors"), [(10, (1, 1, 1)), (-10, (2, 2, 1)), (90, (1, 1, 1))])
def test_stitching_of_turned_views(spark, scene, degrees, factors):
    true = turned(degrees, (70, 5, 1) if degrees != 90 else (110, 2, 1))
    said = list(true)
    for i, off in ((3, 4.0), (7, -3.0), (11, 1.0)):
        said[i] += off
    sizes = {0: (90, 60, 24), 1: (48, 48, 22) if degrees != 90 else (48, 60, 22)}
    views = [turned(0, (0, 0, 0)), true]
    arrays = {(0, s): seen_through(scene, views[s], sizes[s]) for s in (0, 1)}
    chunks = ch.from_arrays(spark, arrays, (32, 32, 16))
    if factors != (1, 1, 1):
        chunks = ch.downsampled(chunks, factors, (16, 16, 16))
    v = fusion_input(spark, sizes, [views[0], said])
    from volumetra.functions import geometry as g
    from volumetra.operators import spatial

    pairs = spatial.overlapping_pairs(v.drop("t_index", "c_index"), 64)
    pairs = pairs.select("tp", "setup", "tp_b", "setup_b", "m", "m_b", *[f"n{x}{s}" for x in "xyz" for s in ("", "_b")], *g.intersection())
    [link] = reg.stitch_rendered(pairs, chunks, factors).collect()
    assert np.abs(np.array([link.dx, link.dy, link.dz]) - [-4, 3, -1]).max() < 0.5 and link.r > 0.8
    # A pair that shares nothing, and no pairs at all.
    far = pairs.withColumn("m_b", g.affine(turned(degrees, (5000, 0, 0))))
    assert reg.stitch_rendered(far, chunks, factors).count() == 0 == reg.stitch_rendered(pairs.limit(0), chunks, factors).count()
