import pytest
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.functions import intensity, options
from volumetra.operators import blocks, points, pyramid
from volumetra.sources import points_csv
from volumetra.sources import project as projects


def test_parsing():
    assert options.ids(" ") is None and options.ids("1, 2") == [1, 2]
    assert options.vector("1,2.5,3", kind=float) == (1.0, 2.5, 3.0)
    assert options.view_ids(["0,1", "2,3"]) == [(0, 1), (2, 3)] and options.view_ids([]) is None
    assert options.pyramid("1,1,1;2,2,1") == [(1, 1, 1), (2, 2, 1)]
    assert options.pyramid("2,2,1", absolute=False) == [(2, 2, 1)]
    assert options.propose_pyramid((512, 512, 64), (1, 1, 2))[:3] == [(1, 1, 1), (2, 2, 1), (4, 4, 2)]
    assert options.relative_factors([(1, 1, 1), (2, 2, 1), (4, 4, 2)]) == [(1, 1, 1), (2, 2, 1), (2, 2, 2)]
    assert options.storage_format("s3://b/x.ZARR/") == "ZARR" and options.storage_format("a.h5") == "HDF5"
    assert options.parquet_codec("Zstandard") == "zstd" and options.exactly_one(keep=2, remove=None) == "keep"
    assert options.block_name((-1, 0, 2), (3, 4, 5)) == "m1_0_2_3_4_5"


@pytest.mark.parametrize(
    "wrong",
    [
        lambda: options.vector("1,2"),
        lambda: options.pyramid("2,2,2"),
        lambda: options.pyramid_levels(True, "1,1,1", (9, 9, 9)),
        lambda: options.one_selection([(0, 0)], tile=[1]),
        lambda: options.fusion_indices(1, None, False),
        lambda: options.fusion_indices(None, None, True),
        lambda: options.exactly_one(keep=None, remove=None),
        lambda: options.storage_format("x.tif"),
        lambda: options.parquet_codec("zip"),
        lambda: options.relative_factors([(1, 1, 1), (3, 1, 1)]),
        lambda: intensity.spark_type("UINT12"),
    ],
)
def test_wrong_options_are_refused(wrong):
    with pytest.raises(ValueError):
        wrong()


def test_geometry(spark):
    m = [2.0, 0.5, 0.0, 3.0, 0.0, 1.0, 0.25, -1.0, 0.0, 0.0, 4.0, 2.0]
    df = spark.createDataFrame([(m,)], "m array<double>")
    both = df.select(g.compose(F.col("m"), g.invert(F.col("m"))).alias("i"), F.struct(*[c.alias(f"s{i}") for i, c in enumerate(g.step_sizes(F.col("m")))]).alias("s")).first()
    assert both.i == pytest.approx(list(g.IDENTITY)) and both.s.s0 == 2.0
    flat = spark.createDataFrame([([0.0] * 12,)], "m array<double>")
    assert flat.select(g.invert(F.col("m")).alias("i")).first().i is None
    assert df.select(g.round_up(F.lit(13), 4).alias("r")).first().r == 16
    assert pyramid.mipmap((2, 2, 1)) == [2.0, 0, 0, 0.5, 0, 2.0, 0, 0.5, 0, 0, 1.0, 0]
    v = spark.createDataFrame([(-1,), (5,)], "v int")
    assert [r[0] for r in v.select(intensity.as_unsigned16(F.col("v"))).collect()] == [65535, 5]
    assert v.select(intensity.as_signed16(intensity.as_unsigned16(F.col("v"))).alias("v")).first().v == -1


def test_points_csv(spark, tmp_path):
    good, bad = points_csv.from_literals(spark, ["1,2,3", " 1.5 ,-2e1,.5", "1,2", "a,b,c", ""])
    assert sorted(tuple(r) for r in good.collect()) == [(1.0, 2.0, 3.0), (1.5, -20.0, 0.5)]
    assert bad.count() == 2
    points_csv.write(good, str(tmp_path / "p"))
    assert points_csv.read(spark, str(tmp_path / "p"))[0].count() == 2


def test_split_refuses_overlap_above_size(spark):
    box = spark.createDataFrame([(0, 9, 0, 9, 0, 9)], ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    with pytest.raises(ValueError):
        blocks.split_tiles(box, (4, 4, 4), (4, 1, 1))
    with pytest.raises(ValueError):
        points.keep_first(box, -1, ["x0"])


def test_dedupe_and_merge(spark):
    rows = [(0, 1, "a", 0.0, 0.0, 0.0), (0, 2, "a", 0.1, 0.0, 0.0), (0, 3, "b", 0.3, 0.0, 0.0), (0, 4, "b", 5.0, 0.0, 0.0), (0, 5, "c", 5.2, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "setup long, id long, label string, x double, y double, z double")
    assert sorted(r.id for r in points.dedupe_lists(p, 0.5, ["setup"], "label").collect()) == [1, 2, 4]
    merged = sorted((r.id, r.n, round(r.x, 3)) for r in points.merged(p, 0.5, ["setup"]).collect())
    assert merged == [(1, 3, 0.133), (4, 2, 5.1)]


def test_components(spark, monkeypatch):
    from volumetra.operators import graph

    edges = [(i, i + 1) for i in range(1, 60) if i % 20] + [(7, 70), (90, 80)]
    e = spark.createDataFrame(edges, "a long, b long").repartition(5)
    n = spark.range(100)
    want = {r.id: r.subset for r in graph.components(n, e).collect()}
    assert len(want) == 100 and want[20] == 1 and want[21] == 21 and want[70] == 1 and want[90] == 80 and want[0] == 0
    monkeypatch.setattr(graph, "TASK_EDGES", 15)
    assert {r.id: r.subset for r in graph.components(n, e).collect()} == want


XML = """<Any version="0.2"><SequenceDescription><ViewSetups>
<ViewSetup><id>0</id><name>a</name><size>10 20 5</size><voxelSize><unit>um</unit><size>1 1 2.5</size></voxelSize><attributes><illumination>0</illumination><channel>1</channel><tile>2</tile><angle>0</angle></attributes></ViewSetup>
<ViewSetup><id>1</id><size>10 20 5</size><attributes><tile>3</tile></attributes></ViewSetup></ViewSetups>
<Timepoints type="pattern"><integerpattern>0-1</integerpattern></Timepoints><MissingViews><MissingView timepoint="1" setup="1"/></MissingViews></SequenceDescription>
<ViewRegistrations><ViewRegistration timepoint="0" setup="0"><ViewTransform type="affine"><Name>move</Name><affine>1 0 0 5 0 1 0 0 0 0 1 0</affine></ViewTransform>
<ViewTransform type="affine"><Name>scale</Name><affine>2 0 0 0 0 1 0 0 0 0 1 0</affine></ViewTransform></ViewRegistration></ViewRegistrations></Any>"""


def test_project(spark, tmp_path):
    (tmp_path / "p.xml").write_text(XML)
    p = projects.load(spark, str(tmp_path / "p.xml"))
    assert p["views"].count() == 4 and p["views"].filter("present").count() == 3
    box = projects.view_boxes(p).filter("tp = 0 and setup = 0").first()
    assert (box.x0, box.x1, box.y1) == (5, 23, 19)
    p.save(str(tmp_path / "saved"))
    again = projects.load(spark, str(tmp_path / "saved"))
    assert again["transforms"].count() == 2 and projects.next_ids(again).first().tile == 4
    (tmp_path / "q.xml").write_text(projects.to_xml(again))
    assert projects.load(spark, str(tmp_path / "q.xml"))["transforms"].orderBy("seq").first().name == "move"
    assert p.save(str(tmp_path / "dry"), dry_run=True) is None and not (tmp_path / "dry").exists()
