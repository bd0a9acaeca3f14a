import json

import numpy as np
import pytest

from volumetra import cli
from volumetra.sources import chunks as ch
from volumetra.sources import container
from volumetra.sources import project as projects

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Two tiles of a scene of blobs; the project says 44, the truth is 41."""
    top = tmp_path_factory.mktemp("data")
    idx = np.stack(np.meshgrid(*[np.arange(n) for n in (96, 40, 16)], indexing="ij"), axis=-1)
    scene = sum(150 * np.exp(-0.5 * ((idx - c) ** 2).sum(axis=-1) / 1.8**2) for c in RNG.uniform([3, 3, 3], [93, 37, 13], (60, 3)))
    ch.write(ch.from_arrays(spark, {(0, 0): scene[:60], (0, 1): scene[41:]}, (32, 40, 16)), str(top / "images"))
    p = projects.Project(spark)
    p["views"] = spark.createDataFrame([(0, s, 0, 0, 0, s, True, n, 40, 16, 1.0, 1.0, 1.0) for s, n in ((0, 60), (1, 55))], projects.SCHEMAS["views"])
    p["transforms"] = spark.createDataFrame([(0, 1, 0, "grid", [float(v) for v in (1, 0, 0, 44, 0, 1, 0, 0, 0, 0, 1, 0)])], projects.SCHEMAS["transforms"])
    p.save(str(top / "project"))
    return top, scene


def run(*args):
    cli.main([str(a) for a in args])


def test_register_and_fuse(spark, data, capsys):
    top, scene = data
    p, images = top / "project", ["--images", top / "images"]
    run("stitching", "-x", p, *images, "-ds", "1,1,1", "--minR", "0.5")
    [link] = projects.load(spark, str(p))["links"].collect()
    assert abs(link.dx + 3) < 0.5 and abs(link.dy) < 0.5
    run("solver", "-x", p, "-s", "STITCHING", "-tm", "TRANSLATION", "-rm", "NONE")
    m = {r.setup: r.m for r in projects.models(projects.load(spark, str(p))).collect()}
    assert abs(m[1][3] - 41) < 0.5 and m[0][3] == 0

    run("detect-interestpoints", "-x", p, *images, "-l", "blobs", "-s", "1.8", "-t", "0.01", "-i0", "0", "-i1", "255", "-dsxy", "1", "--storeIntensities")
    pts = projects.load(spark, str(p))["points"]
    assert pts.count() > 40 and pts.filter("intensity is null").count() == 0
    run("match-interestpoints", "-x", p, "-l", "blobs", "-m", "ICP", "-tm", "TRANSLATION", "-rm", "NONE")
    assert projects.load(spark, str(p))["correspondences"].count() >= 8
    run("match-interestpoints", "-x", p, "-l", "blobs", "-m", "ICP", "-tm", "TRANSLATION", "-rm", "NONE", "--groupChannels", "--clearCorrespondences")
    assert projects.load(spark, str(p))["correspondences"].count() >= 8
    run("solver", "-x", p, "-s", "IP", "-l", "blobs", "-tm", "TRANSLATION", "-rm", "NONE")
    assert abs({r.setup: r.m for r in projects.models(projects.load(spark, str(p))).collect()}[1][3] - 41) < 0.2

    run("solver", "-x", p, "-s", "IP", "-l", "blobs", "-tm", "TRANSLATION", "-rm", "NONE", "--method", "TWO_ROUND_SIMPLE", "--groupTiles", "--dryRun")

    out = top / "fused"
    run("create-fusion-container", "-x", p, "-o", out, "--blockSize", "32,32,16", "-ds", "1,1,1;2,2,1")
    props = container.read(spark, str(out))
    assert props["data_type"] == "FLOAT32" and "min_intensity" not in props and len(props["levels"]) == 2
    run("affine-fusion", "-o", out, *images, "-f", "AVG_BLEND")
    a = np.zeros((100, 44, 20))
    for r in spark.read.schema(ch.SCHEMA).parquet(str(out / "volumes")).filter("level = 0").collect():
        a[r.ox : r.ox + r.sx, r.oy : r.oy + r.sy, r.oz : r.oz + r.sz] = ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
    lo = props["box_min"]
    got = a[5 - lo[0] : 90 - lo[0], 3 - lo[1] : 36 - lo[1], 2 - lo[2] : 13 - lo[2]]
    assert np.corrcoef(got.ravel(), scene[5:90, 3:36, 2:13].ravel())[0, 1] > 0.99

    run("match-intensities", "-x", p, *images, "--numCoefficients", "2,2,1", "--renderScale", "0.5", "--minNumCandidates", "50", "-o", top / "bright")
    fit = projects.load(spark, str(top / "bright"))["intensity_matches"].collect()
    assert fit and all(abs(r.scale - 1) < 0.1 and r.setup == 0 and r.setup_b == 1 for r in fit)
    run("solve-intensities", "-x", top / "bright")
    assert all(abs(r.scale - 1) < 0.1 for r in projects.load(spark, str(top / "bright"))["coefficients"].collect())

    run("transform-points", "-x", p, "-vi", "0,1", "-p", "1,2,3", "bad")
    assert capsys.readouterr().out.strip().splitlines()[-1].startswith("4")
    run("clear-registrations", "-x", p, "--keep", "1")
    assert projects.load(spark, str(p))["transforms"].filter("setup = 1").count() == 1
    run("clear-interestpoints", "-x", p, "--dryRun")
    assert projects.load(spark, str(p))["points"].count() > 0
    run("clear-interestpoints", "-x", p)
    assert projects.load(spark, str(p))["points"].count() == 0


def test_split(spark, data):
    top, _ = data
    run("split-images", "-x", top / "project", "-xo", top / "split", "-tis", "32,32,16", "-to", "8,8,4", "--fakeInterestPoints", "--fipExclusionRadius", "2")
    p = projects.load(spark, str(top / "split"))
    assert p["views"].count() > 4 and p["points"].count() == p["correspondences"].count() > 0


def test_refusals(data):
    top, _ = data
    with pytest.raises(FileNotFoundError):
        run("affine-fusion", "-o", top / "nothing")
    with pytest.raises(ValueError):
        run("clear-registrations", "-x", top / "project")
    with pytest.raises(ValueError):
        run("solver", "-x", top / "project", "-s", "STITCHING", "--tileId", "77")


def test_zarr_to_fusion_to_zarr(spark, data):
    """One image resaved as zarr with a pyramid, fused where it lies into a zarr container, is the image, voxel by voxel."""
    top, scene = data
    p = projects.Project(spark)
    p["views"] = spark.createDataFrame([(0, 5, 0, 0, 0, 0, True, 60, 40, 16, 1.0, 1.0, 1.0)], projects.SCHEMAS["views"])
    p.save(str(top / "one"))
    image = scene[:60].copy()
    image[32:, 16:, :] = 0  # chunks of zeros are not stored
    ch.write(ch.from_arrays(spark, {(0, 5): image}, (32, 32, 16)), str(top / "one_images"))
    run("resave", "-x", top / "one", "--images", top / "one_images", "-o", f"file://{top}/one.zarr", "--blockSize", "16,16,16", "-ds", "1,1,1;2,2,1")
    stored = ch.read_zarr_arrays(spark, f"file://{top}/one.zarr", [(0, 5, 0), (0, 5, 1)])
    assert {r.level for r in stored.select("level").collect()} == {0, 1} and stored.filter("level = 0").count() < 12
    run("create-fusion-container", "-x", top / "one", "-o", f"file://{top}/fused.zarr", "--blockSize", "16,16,16", "-ds", "1,1,1;2,2,2")
    run("affine-fusion", "-o", f"file://{top}/fused.zarr", "-f", "AVG")
    got = np.zeros(image.shape)
    for r in ch.read_zarr(spark, f"file://{top}/fused.zarr/volumes.zarr", 0, 0).collect():
        got[r.ox : r.ox + r.sx, r.oy : r.oy + r.sy, r.oz : r.oz + r.sz] = ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
    assert np.array_equal(got, image.astype("f4"))
    assert ch.read_zarr(spark, f"file://{top}/fused.zarr/volumes.zarr", 0, 0, 1).count() > 0
    with pytest.raises(ValueError):
        run("resave", "-x", top / "one", "--images", top / "one_images", "-o", top / "one.h5")


def test_stitching_of_turned_and_scaled_views(spark, tmp_path):
    """Views with a right angle or a scale in their maps are rendered; others are shifted by parts of steps too; a stored level is read."""
    idx = np.stack(np.meshgrid(*[np.arange(n) for n in (96, 40, 16)], indexing="ij"), axis=-1)
    scene = sum(150 * np.exp(-0.5 * ((idx - c) ** 2).sum(axis=-1) / 2.5**2) for c in RNG.uniform([3, 3, 3], [93, 37, 13], (60, 3)))
    b = scene[41:]
    chunks = ch.from_arrays(spark, {(0, 0): scene[:60], (0, 1): np.rot90(b, axes=(0, 1)).copy(), (0, 2): b}, (32, 40, 16))
    ch.write(ch.pyramid(chunks, [(1, 1, 1), (2, 2, 1)], (32, 32, 16)), str(tmp_path / "images"))
    p = projects.Project(spark)
    p["views"] = spark.createDataFrame([(0, s, 0, 0, 0, s, True, *n, 16, 1.0, 1.0, 1.0) for s, n in ((0, (60, 40)), (1, (40, 55)), (2, (55, 40)))], projects.SCHEMAS["views"])
    # rot90 puts voxel (x, y) to (39 - y, x); both maps put it 3 too far.
    maps = [(0, 1, 0, "turned", [float(v) for v in (0, 1, 0, 44, -1, 0, 0, 39, 0, 0, 1, 0)]), (0, 2, 0, "moved", [float(v) for v in (1, 0, 0, 44, 0, 1, 0, 0, 0, 0, 1, 0)])]
    p["transforms"] = spark.createDataFrame(maps, projects.SCHEMAS["transforms"])
    p["properties"] = spark.createDataFrame([("images", json.dumps(str(tmp_path / "images"))), ("levels", "[[1, 1, 1], [2, 2, 1]]")], projects.SCHEMAS["properties"])
    p.save(str(tmp_path / "project"))
    for wanted in ("1,1,1", "2,2,1"):
        run("stitching", "-x", tmp_path / "project", "-ds", wanted, "--minR", "0.5")
        links = {(r.setup, r.setup_b): (r.dx, r.dy, r.dz) for r in projects.load(spark, str(tmp_path / "project"))["links"].collect()}
        assert set(links) == {(0, 1), (0, 2), (1, 2)}
        for pair, want in (((0, 1), (-3, 0, 0)), ((0, 2), (-3, 0, 0)), ((1, 2), (0, 0, 0))):
            assert np.abs(np.array(links[pair]) - want).max() < 0.5, (wanted, pair, links[pair])
