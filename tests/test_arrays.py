"""Containers of arrays: bytes after the published formats, round trips, pruning, commits."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra import cli
from volumetra.sources import arrays, codecs
from volumetra.sources import chunks as ch
from volumetra.sources import project as projects

RNG = np.random.default_rng(8)


def image(shape, kind="<u2", holes=True):
    a = RNG.integers(1, 60_000, shape).astype(kind)
    if holes:
        a[:16, :16, :8] = 0
    return a


def back(df, shape):
    out = np.zeros(shape)
    rows = df.collect()
    for r in rows:
        out[r.ox : r.ox + r.sx, r.oy : r.oy + r.sy, r.oz : r.oz + r.sz] = ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
    return out, len(rows)


@pytest.mark.parametrize("codec", [*codecs.NAMES.values(), "lz4raw"])
def test_codecs(codec):
    for data in (b"", b"x", bytes(200_000), RNG.integers(0, 256, 150_000).astype("u1").tobytes()):
        assert codecs.decompress(codecs.compress(data, codec), codec) == data


def test_codec_names():
    assert codecs.named("Zstandard") == "zstd"
    for bad in (lambda: codecs.named("blosc"), lambda: codecs.n5_codec({"type": "blosc"}), lambda: codecs.zarr_codec({"id": "blosc"}), lambda: codecs.decompress(b"no stream of blocks here", "lz4")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("layout", ["n5", "zarr", "ngff", "ngff-views"])
@pytest.mark.parametrize(("codec", "kind", "name"), [("raw", "<u2", "UINT16"), ("gzip", "<f4", "FLOAT32"), ("zstandard", "i1", "INT8"), ("lz4", "<i4", "INT32")])
def test_round_trips(spark, tmp_path, layout, codec, kind, name):
    images = {(0, 0): image((37, 20, 11), kind), (0, 2): image((16, 33, 8), kind), (1, 0): image((37, 20, 11), kind, False)}
    path = f"file://{tmp_path}/c"
    arrays.write(ch.from_arrays(spark, images, (16, 16, 8), name), path, layout, (16, 16, 8), codec)
    shared = (37, 33, 11)
    for (t, s), a in images.items():
        got, n = back(arrays.read(spark, path, [(t, s, 0)], layout), a.shape if layout != "ngff" else shared)
        assert np.array_equal(got[tuple(slice(0, x) for x in a.shape)], a.astype(kind)) and got.sum() == a.astype(float).sum()
        assert n == np.prod([-(-x // b) for x, b in zip(a.shape, (16, 16, 8), strict=True)]) - (0 if (t, s) == (1, 0) else 1)
    both = arrays.read(spark, path, [(0, 0, 0), (1, 0, 0)], layout)
    assert {r.tp for r in both.select("tp").collect()} == {0, 1} and both.select("dtype").first()[0] == name
    assert not list(tmp_path.glob("c/.staging*"))


def test_n5_bytes(spark, tmp_path):
    a = image((5, 3, 2), holes=False)
    arrays.write(ch.from_arrays(spark, {(4, 7): a}, (4, 4, 4), "UINT16"), str(tmp_path / "a.n5"), "n5", (4, 4, 4), "gzip", level=5)
    folder = tmp_path / "a.n5/setup7/timepoint4/s0"
    assert json.loads((folder / "attributes.json").read_text()) == {"dimensions": [5, 3, 2], "blockSize": [4, 4, 4], "dataType": "uint16", "compression": {"type": "gzip", "level": 5, "useZlib": False}}
    data = (folder / "1/0/0").read_bytes()
    assert struct.unpack(">HHIII", data[:16]) == (0, 3, 1, 3, 2)  # the edge block is cut
    assert np.array_equal(np.frombuffer(gzip.decompress(data[16:]), ">u2"), a[4:].ravel(order="F"))
    (folder / "0/0/0").write_bytes(struct.pack(">HHIIII", 1, 3, 4, 3, 2, 24) + gzip.compress(a[:4].astype(">u2").tobytes(order="F")))  # with a count of elements
    assert np.array_equal(back(arrays.read(spark, str(tmp_path / "a.n5"), [(4, 7, 0)], "n5"), a.shape)[0], a)
    (folder / "0/0/0").write_bytes(struct.pack(">HHIII", 2, 3, 4, 3, 2))
    with pytest.raises(Exception, match="hold no voxels"):
        arrays.read(spark, str(tmp_path / "a.n5"), [(4, 7, 0)], "n5").collect()


@pytest.mark.parametrize("order", ["C", "F"])
def test_foreign_zarr(spark, tmp_path, order):
    """A three-dimensional image in z, y, x with big-endian numbers, a fill value and nested names."""
    a = RNG.integers(0, 9, (7, 6, 5)).astype(">i4")  # z, y, x
    folder = tmp_path / "s3-t0.zarr/0"
    folder.mkdir(parents=True)
    (tmp_path / "s3-t0.zarr/.zattrs").write_text("{}")
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [7, 6, 5], "chunks": [4, 4, 4], "dtype": ">i4", "compressor": {"id": "zlib", "level": 1}, "fill_value": 7, "order": order, "filters": None, "dimension_separator": "/"}))
    want = np.full(a.shape, 7.0)
    for g in np.ndindex(2, 2, 2):
        if g == (1, 0, 1):
            continue  # not stored
        part = np.full((4, 4, 4), 99, ">i4")
        at = tuple(slice(4 * i, 4 * i + 4) for i in g)
        part[tuple(slice(0, n) for n in a[at].shape)] = a[at]
        want[at] = a[at]
        (folder / f"{g[0]}/{g[1]}").mkdir(parents=True, exist_ok=True)
        (folder / f"{g[0]}/{g[1]}/{g[2]}").write_bytes(zlib.compress(part.tobytes(order=order)))
    assert arrays.layout_of(str(tmp_path)) == "ngff-views"
    got, _ = back(ch.read_zarr_arrays(spark, str(tmp_path), [(0, 3, 0)]), (5, 6, 7))
    assert np.array_equal(got, want.transpose(2, 1, 0))


def test_pruning(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p.n5")
    arrays.write(ch.from_arrays(spark, {(0, s): image((64, 64, 16), holes=False) for s in range(3)}, (16, 16, 8), "UINT16"), path, "n5", (16, 16, 8))
    everything = arrays.read(spark, path, [(0, s, 0) for s in range(3)], "n5")
    assert everything.count() == 3 * 32
    boxed = arrays.read(spark, path, [(0, 1, 0)], "n5", box=((10, 20, 3), (17, 31, 7)))
    assert {(r.gx, r.gy, r.gz) for r in boxed.collect()} == {(0, 1, 0), (1, 1, 0)}
    reader = arrays.Reader({"path": path, "layout": "n5", "arrays": json.dumps([(0, s, 0) for s in range(3)])})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    wanted = [EqualTo(("setup",), 2), GreaterThanOrEqual(("ox",), 17), LessThan(("oy",), 16), LessThan(("ox",), 48)]
    assert list(reader.pushFilters(wanted)) == wanted
    [p] = reader.partitions()
    assert (p.setup, p.low, p.high, p.start, p.stop) == (2, (2, 0, 0), (4, 2, 2), 0, 8)  # Spark drops what only borders
    found = everything.filter("setup = 2 and ox >= 17 and oy < 16 and ox < 48")
    assert {(r.gx, r.gy) for r in found.collect()} == {(2, 0)}
    assert everything.filter("setup = 9").count() == 0
    monkeypatch.setattr(arrays, "TASK_BYTES", 5000)
    assert [(p.start, p.stop) for p in arrays.Reader({"path": path, "layout": "n5", "arrays": "[[0, 0, 0]]"}).partitions()][:2] == [(0, 1), (1, 2)]


def test_commit(spark, tmp_path):
    """A failed task leaves no array; an array is not written twice; chunks off the grid are refused."""
    path, a = str(tmp_path / "f.n5"), image((64, 16, 8), holes=False)
    good = ch.from_arrays(spark, {(0, 0): a}, (16, 16, 8), "UINT16").repartition(4)
    broken = good.withColumn("payload", F.when(F.col("gx") == 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        arrays.write(broken, path, "n5", (16, 16, 8))
    with pytest.raises(Exception, match="no array"):
        arrays.read(spark, path, [(0, 0, 0)], "n5").collect()
    assert not list((tmp_path / "f.n5").rglob("attributes.json"))
    arrays.write(good, path, "n5", (16, 16, 8))
    with pytest.raises(Exception, match="there is an array"):
        arrays.write(good, path, "n5", (16, 16, 8))
    with pytest.raises(Exception, match="grid"):
        arrays.write(good, str(tmp_path / "g.n5"), "n5", (32, 16, 8))
    assert np.array_equal(back(arrays.read(spark, path, [(0, 0, 0)], "n5"), a.shape)[0], a)
    arrays.write(good.limit(0), str(tmp_path / "none.n5"), "n5", (16, 16, 8))
    assert arrays.read(spark, path, [], "n5").count() == 0


def test_blocks_where_chunks_are_missing(spark, tmp_path):
    """Blocks begin at the grid and are whole where the image goes on; an image that ends in zeros keeps its size."""
    a = np.zeros((40, 16, 8), "<u2")
    a[20:24] = 5
    parts = ch.from_arrays(spark, {(0, 0): a}, (4, 16, 8), "UINT16").filter("ox between 20 and 23")
    path = str(tmp_path / "m.n5")
    ch.write_container(ch.rechunked(parts, (16, 16, 8)), path, [(1, 1, 1), (2, 2, 2)], (16, 16, 8), layout="n5", sizes={(0, 0): a.shape})
    assert struct.unpack(">HHIII", (tmp_path / "m.n5/setup0/timepoint0/s0/1/0/0").read_bytes()[:16]) == (0, 3, 16, 16, 8)
    assert json.loads((tmp_path / "m.n5/setup0/timepoint0/s1/attributes.json").read_text())["dimensions"] == [20, 8, 4]
    for level, want in ((0, a), (1, a[::2, ::2, ::2])):
        got, n = back(arrays.read(spark, path, [(0, 0, level)], "n5"), want.shape)
        assert np.array_equal(got, want) and n == 1


def test_volumes_of_one_image_in_turn(spark, tmp_path):
    """Volumes of a five-dimensional image come one by one, and again; arrays stored in another way are left alone."""
    path, first, second = str(tmp_path / "v.zarr"), image((16, 16, 8)), image((16, 16, 8), holes=False)
    for volume, a in (((0, 0), first), ((1, 1), second), ((0, 0), second)):
        arrays.write(ch.from_arrays(spark, {volume: a}, (16, 16, 8), "UINT16"), path, "ngff", (16, 16, 8), counts=(3, 2))
    assert json.loads((tmp_path / "v.zarr/0/.zarray").read_text())["shape"] == [3, 2, 8, 16, 16]
    for volume, want in (((0, 0), second), ((1, 1), second), ((2, 0), 0 * second)):
        assert np.array_equal(back(arrays.read(spark, path, [(*volume, 0)], "ngff"), want.shape)[0], want)
    with pytest.raises(Exception, match="another way"):
        arrays.write(ch.from_arrays(spark, {(2, 0): first}, (8, 8, 8), "UINT16"), path, "ngff", (8, 8, 8), counts=(3, 2))


def multiscale_rules(attributes, folder):
    """What version 0.4 of the published schema asks of a multiscale image."""
    [m] = attributes["multiscales"]
    assert m["version"] == "0.4" and isinstance(m["name"], str) and 1 <= len(m["datasets"])
    assert [a["name"] for a in m["axes"]] == ["t", "c", "z", "y", "x"] and [a["type"] for a in m["axes"]] == ["time", "channel", "space", "space", "space"]
    before = None
    for d in m["datasets"]:
        kinds = [t["type"] for t in d["coordinateTransformations"]]
        assert kinds in (["scale"], ["scale", "translation"]) and all(len(t[t["type"]]) == 5 for t in d["coordinateTransformations"])
        z = json.loads((folder / d["path"] / ".zarray").read_text())
        assert {"zarr_format", "shape", "chunks", "dtype", "compressor", "fill_value", "order", "filters"} <= set(z) and z["zarr_format"] == 2
        assert len(z["shape"]) == len(z["chunks"]) == 5 and z["dimension_separator"] == "/" and z["chunks"][:2] == [1, 1]
        scale = d["coordinateTransformations"][0]["scale"]
        assert before is None or all(a >= b for a, b in zip(scale, before, strict=True))
        before = scale


def run(*args):
    cli.main([str(a) for a in args])


@pytest.mark.parametrize("ending", [".n5", ".zarr"])
def test_from_images_to_fusion_to_fusion(spark, tmp_path, ending):
    """Resaved, fused, and the fused image fused again from the output project: voxel by voxel the same."""
    a = image((40, 24, 12)).astype("f4")
    p = projects.Project(spark)
    p["views"] = spark.createDataFrame([(0, 5, 0, 0, 0, 0, True, *a.shape, 1.0, 1.0, 1.0)], projects.SCHEMAS["views"])
    p.save(str(tmp_path / "one"))
    ch.write(ch.from_arrays(spark, {(0, 5): a}, (32, 32, 16)), str(tmp_path / "images"))
    stored = tmp_path / f"one{ending}"
    run("resave", "-x", tmp_path / "one", "--images", tmp_path / "images", "--n5Path", f"file://{stored}", "--blockSize", "16,16,8", "-ds", "1,1,1;2,2,1", "-c", "gzip", "-cl", "2", "-xo", tmp_path / "one.xml")
    if ending == ".n5":
        assert json.loads((stored / "attributes.json").read_text()) == {"n5": "4.0.0"}
        assert json.loads((stored / "setup5/attributes.json").read_text()) == {"downsamplingFactors": [[1, 1, 1], [2, 2, 1]], "dataType": "float32"}
        assert json.loads((stored / "setup5/timepoint0/s1/attributes.json").read_text())["compression"]["level"] == 2
    else:
        multiscale_rules(json.loads((stored / "s5-t0.zarr/.zattrs").read_text()), stored / "s5-t0.zarr")
    loaded = projects.load(spark, str(tmp_path / "one.xml"))
    assert {r.key: json.loads(r.value) for r in loaded["properties"].collect()} == {"images": f"file://{stored}", "levels": [[1, 1, 1], [2, 2, 1]]}

    out, again = tmp_path / f"fused{ending}", tmp_path / f"again{ending}"
    run("create-fusion-container", "-x", tmp_path / "one.xml", "-o", f"file://{out}", "--blockSize", "16,16,8", "-ds", "1,1,1;2,2,2", "-xo", tmp_path / "fused.xml", "-c", "zstandard", "-cl", "7")
    run("affine-fusion", "-o", f"file://{out}", "-f", "AVG")
    made = projects.load(spark, str(tmp_path / "fused.xml"))
    assert [(r.tp, r.setup, r.nx, r.ny, r.nz) for r in made["views"].collect()] == [(0, 0, 40, 24, 12)]
    run("create-fusion-container", "-x", tmp_path / "fused.xml", "-o", f"file://{again}", "--blockSize", "16,16,8", "-ds", "1,1,1")
    run("affine-fusion", "-o", f"file://{again}", "-f", "AVG")
    for folder in (out, again):
        got, _ = back(ch.read_images(spark, f"file://{folder}/volumes{ending}", [(0, 0)]), a.shape)
        assert np.array_equal(got, a)
    if ending == ".zarr":
        multiscale_rules(json.loads((out / "volumes.zarr/.zattrs").read_text()), out / "volumes.zarr")
        assert json.loads((out / "volumes.zarr/.zgroup").read_text()) == {"zarr_format": 2}
        assert json.loads((out / "volumes.zarr/1/.zarray").read_text())["compressor"] == {"id": "zstd", "level": 7}
    level, _ = back(ch.read_images(spark, f"file://{out}/volumes{ending}", [(0, 0)], 1), (20, 12, 6))
    assert np.allclose(level, a.reshape(20, 2, 12, 2, 6, 2).mean(axis=(1, 3, 5)), rtol=1e-5)
