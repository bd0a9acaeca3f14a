import itertools

from volumetra.operators import blocks, spatial
from volumetra.plans import fixtures, jobs

SF = "/root/testdata/sf0.001"
BOX = [f"i{x}{i}" for x in "xyz" for i in (0, 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_made_where_their_overlap_lies(spark):
    """No shuffle, and the points that a plain loop over the numbered candidates keeps."""
    boxes = spark.createDataFrame([(k, *b) for k, b in enumerate([(0, 15, 0, 63, 0, 31), (5, 5, 7, 7, 9, 9), (0, 99, 0, 99, 0, 9), (0, 400, 0, 90, 0, 90)])], "k_ long, " + ", ".join(f"{c} long" for c in BOX))
    every = {(r.k_, r.k): r for r in blocks.synthetic_points(boxes, high=60, error=0.0, exclusion=0.0).collect()}
    found = blocks.synthetic_points(boxes, high=60, error=0.0, exclusion=25.0)
    assert "Exchange" not in plan(found)
    want = set()
    for k_, rows in itertools.groupby(sorted(every), key=lambda x: x[0]):
        kept = []
        for key in rows:
            p = every[key]
            if all((p.x_a - q.x_a) ** 2 + (p.y_a - q.y_a) ** 2 + (p.z_a - q.z_a) ** 2 >= 625 for q in kept):
                kept.append(p)
                want.add(key)
    assert {(r.k_, r.k) for r in found.collect()} == want and len(want) < len(every)


def test_views_meet_views_by_a_shuffle(spark):
    """However small the file of the views is."""
    pairs = spatial.overlapping_pairs(fixtures.views(spark, SF), 150)
    assert "Broadcast" not in plan(pairs) and "SortMergeJoin" in plan(pairs)


def test_views_with_maps_meet_by_a_shuffle(spark):
    v = fixtures.views(spark, SF).selectExpr("*", "array(1D, 0D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 0D, 1D, 0D) as m", *[f"{x}1 - {x}0 + 1 as n{x}" for x in "xyz"])
    met = plan(spatial.local_overlaps(v, 150))
    assert "Broadcast" not in met and "SortMergeJoin" in met


def test_views_of_two_hops_meet_by_a_shuffle(spark, monkeypatch):
    """The join of views with views, without the one with blocks."""
    real, met = spatial.box_join, []
    monkeypatch.setattr(spatial, "box_join", lambda *a, **kw: (met.append(real(*a, **kw)), met[-1])[1])
    v = fixtures.views(spark, SF)
    spatial.two_hop(v.limit(5), v, 150, ["tile"])
    assert "Broadcast" not in plan(met[1]) and "SortMergeJoin" in plan(met[1])


def test_tiles_meet_in_the_row_of_their_image(spark):
    """All pairs of tiles that overlap, without a join; images are dealt over tasks however small their file is."""
    images = spark.createDataFrame([(0, 0, 149, 90, 200, 3, 52), (1, -7, 20, 5, 5, 0, 31), (2, 10, 73, 0, 64, 0, 16)], "setup long, " + ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    sides = [f"t{x}{i}" for x in "xyz" for i in (0, 1)]
    for size, overlap, step in [((64, 64, 32), (16, 16, 8), (1, 1, 1)), ((30, 50, 9), (20, 0, 5), (4, 4, 4))]:
        met = blocks.tile_pairs(images, size, overlap, step)
        assert "Join" not in plan(met) and "Exchange" not in plan(met)
        tiles = [(r.setup, *[r[c] for c in sides]) for r in blocks.split_tiles(images, size, overlap, step).collect()]
        want = [(a, b) for a, b in itertools.product(tiles, tiles) if a[0] == b[0] and all(a[i] <= b[i + 1] and b[i] <= a[i + 1] for i in (1, 3, 5))]
        assert sorted(((r.setup, *[r[c] for c in sides]), (r.setup, *[r[f"{c}_b"] for c in sides])) for r in met.collect()) == sorted(want)
    query = jobs.split_with_points(spark, SF)
    assert "Join" not in plan(query) and query.rdd.getNumPartitions() >= jobs.PAIR_TASKS
