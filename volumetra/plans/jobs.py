"""Queries with numpy kernels on the fixtures. Those with a whole-number form have SQL; of the others tests hold the kernels
against known truth."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.operators import blocks, consensus, points, pyramid, registration, rendered, spatial
from volumetra.operators.graph import shared, stored
from volumetra.plans import fixtures as fx
from volumetra.sources import arrays
from volumetra.sources import chunks as ch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: So many that few of the 28 pairs of views share a task.
PAIR_TASKS = 96
#: Views that one task cuts into tiles.
VIEWS_OF_TASK = 1 << 14


SQL: dict[str, str] = {}


def job(f: Query | None = None, sql: str = "") -> Query:
    if f is None:
        return lambda g: job(g, sql)
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


#: The images of ``_images``: every voxel of the four views, 0 where X has none.
_FULL = f"""WITH {fx.X},
I AS (SELECT s.setup, gx.x, gy.y, gz.z, coalesce(X.v, 0)::DOUBLE AS v FROM (SELECT unnest(range(4)) AS setup) s, (SELECT unnest(range(64)) AS x) gx,
  (SELECT unnest(range(64)) AS y) gy, (SELECT unnest(range(8)) AS z) gz LEFT JOIN X ON X.setup = s.setup AND X.x = gx.x AND X.y = gy.y AND X.z = gz.z)
"""


def _non_zero(chunks: DataFrame) -> DataFrame:
    """(level, x, y, z, v) of the voxels that are not 0."""
    return ch.to_voxels(chunks.withColumnsRenamed({"t_index": "tp", "c_index": "setup"})).filter("v <> 0")


def _images(spark: SparkSession, d: str) -> DataFrame:
    return ch.from_voxels(fx.voxels(spark, d), (32, 32, 8))


def _places(spark: SparkSession, d: str, step: int = 40) -> DataFrame:
    """The four views, each moved by (``step``, 30) against the one before."""
    s = F.col("id")
    v = spark.range(4).select(F.lit(0).alias("tp"), s.alias("setup"), F.lit(0).alias("t_index"), F.lit(0).alias("c_index"), *[F.lit(n).cast("long").alias(f"n{x}") for x, n in zip("xyz", (64, 64, 8), strict=True)])
    zero, one = F.lit(0.0), F.lit(1.0)
    v = v.withColumn("m", F.array(one, zero, zero, F.col("setup") * float(step), zero, one, zero, F.col("setup") * 30.0, zero, zero, one, zero))
    lo, hi = g.containing_box(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"n{x}") - 1).cast("double") for x in "xyz"])
    return v.withColumns({f"{x}{i}": c for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))})


def _blocks(spark: SparkSession) -> DataFrame:
    row = spark.createDataFrame([(0, 183, 0, 153, 0, 7)], ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    return blocks.block_boxes(blocks.grid(row, (64, 64, 8))).withColumns({"t_index": F.lit(0), "c_index": F.lit(0)})


@job
def detect_dog(spark: SparkSession, d: str) -> DataFrame:
    return registration.detect_points(_images(spark, d), 1.8, 0.02, 0.0, 200.0)


@job
def stitch_phase(spark: SparkSession, d: str) -> DataFrame:
    v = _places(spark, d)
    pairs = spatial.overlapping_pairs(v.select("tp", "setup", "m", *[f"{x}{i}" for x in "xyz" for i in (0, 1)]), 64)
    moved = {f"t{x}{s}": F.col(f"m{s}")[4 * i + 3].cast("long") for i, x in enumerate("xyz") for s in ("", "_b")}
    return registration.stitch_pairs(pairs.select("setup", "setup_b", *g.intersection(), *[c.alias(n) for n, c in moved.items()]), _images(spark, d))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    r = points.resolved(fx.correspondences(spark, d), fx.points_a(spark, d), fx.points_b(spark, d))
    xyz = [F.col(f"{x}{s}").cast("double").alias(f"{x}{s}") for s in ("", "_b") for x in "xyz"]
    return r.select(F.col("setup").cast("long"), F.col("setup_b").cast("long"), *xyz).distinct()


@job
def match_ransac(spark: SparkSession, d: str) -> DataFrame:
    return registration.robust_models(_candidates(spark, d), "TRANSLATION", iterations=500, max_error=10.0, min_ratio=0.01, min_inliers=5)


#: Places of lineitems, and where they are seen again: a third of them anywhere, the others moved.
_SEEN = """SELECT l_linenumber AS setup_b, l_partkey % 1009 AS x, l_suppkey % 97 AS y, l_orderkey % 499 AS z,
  CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 7 % 1013 ELSE l_partkey % 1009 + 300 END AS x_b, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey * 5 % 1019 ELSE l_suppkey % 97 - 200 END AS y_b,
  CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey * 3 % 499 ELSE l_orderkey % 499 + 50 END AS z_b FROM {lineitem}"""


@job(sql=f"""SELECT setup_b::BIGINT AS setup_b, count(*) AS n, 300.0::DOUBLE AS dx, -200.0::DOUBLE AS dy, 50.0::DOUBLE AS dz FROM ({_SEEN.format(lineitem="lineitem")})
WHERE x_b = x + 300 AND y_b = y - 200 AND z_b = z + 50 GROUP BY ALL""")
def large_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Seven pairs of views, each with a seventh of the table as candidates, solved by passes over all rows."""
    seen = spark.sql(_SEEN.format(lineitem=f"parquet.`{d}/lineitem.parquet`")).withColumn("setup", F.lit(0))
    found = consensus.large_models(seen, "TRANSLATION", iterations=200, max_error=0.5)
    return found.select("setup_b", "n", *[F.round(F.col("model")[i], 6).alias(c) for c, i in (("dx", 3), ("dy", 7), ("dz", 11))])


def _places_of_points(spark: SparkSession, d: str) -> DataFrame:
    """All points; of points at one place of a view the one with the smallest id."""
    return fx.points(spark, d).groupBy("setup", "x", "y", "z").agg(F.min("id").alias("id")).select("setup", "id", "x", "y", "z")


def _pairs(spark: SparkSession) -> DataFrame:
    """All pairs of the eight views: their points lie in the same box."""
    return spark.range(64).selectExpr("id div 8 as setup", "id % 8 as setup_b").filter("setup < setup_b")


@job
def match_icp(spark: SparkSession, d: str) -> DataFrame:
    return registration.match_points(_pairs(spark), _places_of_points(spark, d), "ICP", tasks=PAIR_TASKS, model="RIGID", max_error=5.0, iterations=50)


@job
def match_fast_rotation(spark: SparkSession, d: str) -> DataFrame:
    return registration.match_points(_pairs(spark), _places_of_points(spark, d), "FAST_ROTATION", tasks=PAIR_TASKS, significance=1.5, model="RIGID", min_inliers=5, iterations=500)


@job
def match_precise_translation(spark: SparkSession, d: str) -> DataFrame:
    return registration.match_points(_pairs(spark), _places_of_points(spark, d), "PRECISE_TRANSLATION", tasks=PAIR_TASKS, significance=1.5, model="TRANSLATION", min_inliers=3, iterations=500, search_radius=60.0)


#: Points of a view within 5 of each other reach the smallest id among all they are linked to.
_MERGED = f"""WITH RECURSIVE {fx.P},
E AS (SELECT a.setup, a.id AS a, b.id AS b FROM P a JOIN P b ON a.setup = b.setup AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 25),
R AS (SELECT DISTINCT m.a AS id, m.a AS root FROM E m WHERE NOT EXISTS (SELECT 1 FROM E q WHERE q.a = m.a AND q.b < m.a)
  UNION SELECT m.b AS id, R.root FROM R JOIN E m ON m.a = R.id),
G AS (SELECT id, min(root) AS g FROM R GROUP BY id)
SELECT setup, min(P.id) AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM P JOIN G ON G.id = P.id GROUP BY setup, g"""
_LISTS = 8
_NEAR = "t.setup = p.setup AND (t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2 <= 16"
#: One list after the other, against all that was taken before.
_DEDUPED = f"""WITH {fx.P}, N AS (SELECT *, dense_rank() OVER (ORDER BY label) AS k FROM P), T1 AS MATERIALIZED (SELECT * FROM N WHERE k = 1),
""" + ",\n".join(f"T{k} AS MATERIALIZED (SELECT * FROM T{k - 1} UNION ALL SELECT * FROM N p WHERE k = {k} AND NOT EXISTS (SELECT 1 FROM T{k - 1} t WHERE {_NEAR}))" for k in range(2, _LISTS + 1)) + f"""
SELECT setup, id, label FROM T{_LISTS}"""


@job(sql=_MERGED)
def merge_points(spark: SparkSession, d: str) -> DataFrame:
    out = points.merged(fx.points(spark, d).select("setup", "id", "x", "y", "z"), 5.0, ["setup"])
    return out.select("setup", "id", *[F.round(x, 6).alias(x) for x in "xyz"], "n")


@job(sql=_DEDUPED)
def dedupe_many_lists(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("setup", "id", "label", *[F.col(x).cast("double").alias(x) for x in "xyz"])
    return points.dedupe_lists(p, 4.0, ["setup"], "label").select("setup", "id", "label")


@job
def solve_global(spark: SparkSession, d: str) -> DataFrame:
    """Tile positions from the mean offsets of the stitched pairs."""
    links = stitch_phase(spark, d).select(F.col("setup").alias("a"), F.col("setup_b").alias("b"), F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("p"), F.array(F.array(-F.col("dx"), -F.col("dy"), -F.col("dz"))).alias("q"), F.lit(1.0).alias("weight"))
    m, error = registration.solve_links(links, [0, 1, 2, 3], {0}, "ONE_ROUND_ITERATIVE", model="TRANSLATION", iterations=500, plateau=50)
    return spark.createDataFrame([(k, [float(x) for x in v.ravel()], error) for k, v in m.items()], "setup long, affine array<double>, error double")


@job
def match_intensity_ransac(spark: SparkSession, d: str) -> DataFrame:
    return registration.match_intensities(points.cell_matches(fx.voxels(spark, d), (32, 32, 8)), "RANSAC", at_least=50, iterations=200, max_error=20.0)


@job(
    sql=_FULL
    + """, W AS (SELECT setup, (x + 40 * setup) // 2 AS wx, (y + 30 * setup) // 2 AS wy, z // 2 AS wz, (x // 32 * 4 + y // 32 * 2 + z // 4)::INTEGER AS cell, avg(v) AS v FROM I GROUP BY ALL HAVING avg(v) BETWEEN 1 AND 1000)
SELECT a.setup::BIGINT AS setup, b.setup::BIGINT AS setup_b, a.cell, b.cell AS cell_b, count(*) AS n, sum(a.v) AS v, sum(b.v) AS v_b FROM W a JOIN W b ON a.setup < b.setup AND a.wx = b.wx AND a.wy = b.wy AND a.wz = b.wz GROUP BY ALL"""
)
def rendered_cell_values(spark: SparkSession, d: str) -> DataFrame:
    """Sums of what two views show in the cells of a grid of half the resolution, by pair of coefficient cells."""
    v = _places(spark, d)
    both = v.select("tp", "setup", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    pairs = spatial.overlapping_pairs(both, 64)
    grid = v.withColumns({"m": F.transform("m", lambda c: c * 0.5), **{f"f{x}": F.lit(1.0) for x in "xyz"}})
    values = rendered.cell_values(pairs, grid, _images(spark, d), (2, 2, 2), 0.5, 1.0, 1000.0, 16)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            at = [rendered.unpacked([v]) for v in pdf["v"]]
            yield pdf.drop(columns="v").assign(v=[float(x.sum()) for x, _ in at], v_b=[float(y.sum()) for _, y in at])

    each = values.select("setup", "setup_b", "cell", "cell_b", "n", "v").mapInPandas(sums, "setup long, setup_b long, cell int, cell_b int, n long, v double, v_b double")
    return each.groupBy("setup", "setup_b", "cell", "cell_b").agg(*[F.sum(c).alias(c) for c in ("n", "v", "v_b")])


@job
def solve_intensity(spark: SparkSession, d: str) -> DataFrame:
    m = registration.match_intensities(points.cell_matches(fx.voxels(spark, d), (32, 32, 8)), "HISTOGRAM", at_least=50)
    return registration.solve_intensities(m, 0.1, 200)


@job(
    sql=_FULL
    + """, W AS (SELECT x + 40 * setup AS x, y + 30 * setup AS y, z, v, (1 - cos(pi() * least(1.0, (least(x, 63 - x) + 1) / 40.0))) / 2
  * (1 - cos(pi() * least(1.0, (least(y, 63 - y) + 1) / 40.0))) / 2 * (1 - cos(pi() * least(1.0, (least(z, 7 - z) + 1) / 40.0))) / 2 AS b FROM I),
B AS (SELECT x, y, z, floor(least(1.0, greatest(0.0, sum(b * v) / sum(b) / 400.0)) * 65535 + 0.5) AS v FROM W GROUP BY x, y, z)
SELECT x, y, z, v FROM B WHERE v <> 0"""
)
def fuse_affine_blocks(spark: SparkSession, d: str) -> DataFrame:
    fused = registration.fuse_views(_blocks(spark), _places(spark, d), _images(spark, d), "AVG_BLEND", "UINT16", 0.0, 400.0)
    return _non_zero(fused).select("x", "y", "z", "v")


@job(
    sql=f"""WITH {fx.X} SELECT DISTINCT x + step * s AS x, y + 30 * s AS y, z, 255.0::DOUBLE AS v FROM (SELECT DISTINCT setup AS s FROM X), (SELECT 30 + count(*) % 11 AS step FROM lineitem),
  (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(8)) AS z)"""
)
def fuse_masks(spark: SparkSession, d: str) -> DataFrame:
    """Where the views that have voxels lie, their step being of the table."""
    step = 30 + spark.read.parquet(f"{d}/lineitem.parquet").count() % 11
    views = _places(spark, d, step).join(fx.voxels(spark, d).select("setup").distinct(), "setup", "left_semi")
    return _non_zero(registration.fuse_views(_blocks(spark), views, _images(spark, d), dtype="UINT8", masks=True)).select("x", "y", "z", "v")


@job
def fuse_nonrigid(spark: SparkSession, d: str) -> DataFrame:
    p = spark.range(32).selectExpr("id % 4 as setup", "(id % 4) * 40 + (id div 4 % 2) * 60 as x", "(id % 4) * 30 + (id div 8 % 2) * 60 as y", "(id div 16) * 7 as z")
    p = p.select("setup", "x", "y", "z", (F.col("x") + F.col("setup")).alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return registration.fuse_nonrigid(_blocks(spark), _places(spark, d), _images(spark, d), p, spacing=16.0)


@job(
    sql=f"""WITH {fx.X}, L1 AS (SELECT setup, x // 2 AS x, y // 2 AS y, z, sum(v) / 4.0 AS v FROM X GROUP BY ALL),
L2 AS (SELECT setup, x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(v) / 8.0 AS v FROM L1 GROUP BY ALL)
SELECT setup, 0 AS level, x, y, z, v::DOUBLE AS v FROM X UNION ALL SELECT setup, 1, x, y, z, v::DOUBLE FROM L1 UNION ALL SELECT setup, 2, x, y, z, v::DOUBLE FROM L2"""
)
def resave_pyramid(spark: SparkSession, d: str) -> DataFrame:
    all_levels = ch.pyramid(ch.rechunked(_images(spark, d), (48, 48, 8)), [(1, 1, 1), (2, 2, 1), (2, 2, 2)], (32, 32, 8))
    return _non_zero(all_levels).select("setup", "level", "x", "y", "z", "v")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


@job(sql=SQL["resave_pyramid"])
def resave_n5(spark: SparkSession, d: str) -> DataFrame:
    """The images written as N5 with a pyramid, then read from there, all levels in one scan."""
    path = _folder(spark, "resaved") + ".n5"
    views = [(0, s) for s in range(4)]
    ch.write_container(ch.rechunked(_images(spark, d), (32, 32, 8)), path, [(1, 1, 1), (2, 2, 1), (4, 4, 2)], (32, 32, 8), "gzip", views=views, layout="n5", sizes=dict.fromkeys(views, (64, 64, 8)))
    return _non_zero(arrays.read(spark, path, [(*v, i) for v in views for i in range(3)], "n5")).select("setup", "level", "x", "y", "z", "v")


@job(sql=SQL["fuse_affine_blocks"])
def fuse_to_ngff(spark: SparkSession, d: str) -> DataFrame:
    """The four views fused into a five-dimensional OME-NGFF image with a coarser level, and its full resolution read from there."""
    path, block = _folder(spark, "fused") + ".zarr", (64, 64, 8)
    fused = registration.fuse_views(_blocks(spark), _places(spark, d), _images(spark, d), "AVG_BLEND", "UINT16", 0.0, 400.0)
    named = fused.withColumnsRenamed({"t_index": "tp", "c_index": "setup"}).select(*[F.col(c).cast(k) for c, k in (x.split() for x in ch.SCHEMA.split(", "))])
    ch.write_container(ch.rechunked(named, block), path, [(1, 1, 1), (2, 2, 2)], block, views=[(0, 0)], layout="ngff", counts=(1, 1), sizes={(0, 0): (184, 154, 8)})
    return _non_zero(arrays.read(spark, path, [(0, 0, 0)], "ngff")).select("x", "y", "z", "v")


@job
def split_with_points(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of all views, and made-up points where neighbours of one view overlap."""
    v = fx.views(spark, d)
    # A view is one short row and gives some 200 points; its file may be a single split.
    v = v.repartition(max(PAIR_TASKS, v.count() // VIEWS_OF_TASK), "setup")
    t = blocks.tile_pairs(v, (64, 64, 32), (16, 16, 8))
    name = lambda s: F.xxhash64("setup", *[f"t{x}0{s}" for x in "xyz"]).alias(f"setup{s}")
    t = t.select(name(""), name("_b"), *[F.col(f"t{x}{i}{s}").alias(f"{x}{i}{s}") for s in ("", "_b") for x in "xyz" for i in (0, 1)])
    pairs = t.filter("setup < setup_b").select("setup", "setup_b", *g.intersection())
    return blocks.synthetic_points(pairs, high=30)


@job(sql=f"WITH {fx.V} SELECT setup, l AS level, (2 ** l)::DOUBLE AS sx, ((2 ** l) - 1) / 2.0::DOUBLE AS ox, (2 ** greatest(0, l - 1))::DOUBLE AS sz, ((2 ** greatest(0, l - 1)) - 1) / 2.0::DOUBLE AS oz FROM V, (SELECT unnest(range(3)) AS l)")
def level_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps from each pyramid level of every view to full resolution: steps and origins along x and z."""
    maps = F.array(*[F.struct(F.lit(i).cast("long").alias("level"), g.affine(pyramid.mipmap(f)).alias("m")) for i, f in enumerate([(1, 1, 1), (2, 2, 1), (4, 4, 2)])])
    v = fx.views(spark, d).select("setup", F.explode(maps).alias("l")).select("setup", "l.*")
    return v.select("setup", "level", *[F.col("m")[i].alias(n) for n, i in (("sx", 0), ("ox", 3), ("sz", 10), ("oz", 11))])


def _cloud(spark: SparkSession, d: str, turned: bool) -> DataFrame:
    """The suppliers as points of view 0, and again in view 1: moved by (300, -200, 50), or turned by a right angle about z first."""
    k = F.col("s_suppkey")
    p = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), ((k * k * 31 + k * 17) % 1009).alias("x"), ((k * k * 57 + k * 91) % 997).alias("y"), ((k * k * 13 + k * 5) % 499).alias("z"))
    x, y = (-F.col("y"), F.col("x")) if turned else (F.col("x"), F.col("y"))
    q = p.select(F.lit(1).cast("long").alias("setup"), "id", (x + 300).alias("x"), (y - 200).alias("y"), (F.col("z") + 50).alias("z"))
    return p.select(F.lit(0).cast("long").alias("setup"), "id", "x", "y", "z").unionByName(q)


_SAME = "SELECT s_suppkey AS id, s_suppkey AS id_b FROM supplier"


@job(sql=_SAME)
def match_turned_copy(spark: SparkSession, d: str) -> DataFrame:
    """Geometric hashing of a cloud and its turned copy finds every point."""
    found = registration.match_points(_pairs(spark).filter("setup_b = 1"), _cloud(spark, d, True), "FAST_ROTATION", significance=1.5, model="RIGID", min_inliers=5, iterations=500, max_error=0.5)
    return found.select("id", "id_b")


@job(sql=_SAME)
def match_moved_copy(spark: SparkSession, d: str) -> DataFrame:
    found = registration.match_points(_pairs(spark).filter("setup_b = 1"), _cloud(spark, d, False), "FAST_TRANSLATION", significance=1.5, model="TRANSLATION", min_inliers=5, iterations=500, max_error=0.5)
    return found.select("id", "id_b")


@job(sql=_SAME)
def match_precise_copy(spark: SparkSession, d: str) -> DataFrame:
    """Redundant descriptors within a search radius find every point of a cloud and its moved copy."""
    found = registration.match_points(_pairs(spark).filter("setup_b = 1"), _cloud(spark, d, False), "PRECISE_TRANSLATION", significance=1.5, model="TRANSLATION", min_inliers=5, iterations=500, max_error=0.5, search_radius=400.0)
    return found.select("id", "id_b")


@job(sql="SELECT t AS tp, t AS tp_b, 0 AS setup, 1 AS setup_b, (CASE t WHEN 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * ((SELECT count(*) FROM lineitem) % 5 + 1)::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM (SELECT unnest(range(2)) AS t)")
def stitch_two_timepoints(spark: SparkSession, d: str) -> DataFrame:
    """One image seen twice, the second time moved by whole voxels, to the right at timepoint 0 and to the left at timepoint 1."""
    n = spark.read.parquet(f"{d}/lineitem.parquet").count() % 5 + 1
    all_views = fx.voxels(spark, d).groupBy("x", "y", "z").agg(F.sum("v").alias("v"))
    seen = F.array(*[F.struct(F.lit(t).alias("tp"), F.lit(s).cast("long").alias("setup"), F.lit(m).alias("m")) for t, s, m in ((0, 0, 0), (0, 1, -n), (1, 0, 0), (1, 1, n))])
    v = all_views.withColumn("s", F.explode(seen)).select("s.tp", "s.setup", (F.col("x") + F.col("s.m")).alias("x"), "y", "z", "v").filter("x between 0 and 63")
    chunks = ch.from_voxels(v, (32, 32, 8))
    box = {f"i{x}{i}": F.lit((0, top)[i]).cast("long") for x, top in zip("xyz", (63, 63, 7), strict=True) for i in (0, 1)}
    pairs = spark.range(2).select(F.col("id").cast("int").alias("tp"), F.lit(0).cast("long").alias("setup"), F.col("id").cast("int").alias("tp_b"), F.lit(1).cast("long").alias("setup_b"), *[c.alias(k) for k, c in box.items()], *[F.lit(0).alias(f"t{x}{s}") for x in "xyz" for s in ("", "_b")])
    found = registration.stitch_pairs(pairs, chunks, subpixel=False)
    return found.select("tp", "tp_b", "setup", "setup_b", F.round("dx").alias("dx"), F.abs(F.round("dy")).alias("dy"))


@job(sql=f"WITH {fx.X} SELECT setup, setup + 4 AS setup_b, -(2 + setup)::DOUBLE AS dx, 1.0::DOUBLE AS dy, 0.0::DOUBLE AS dz, 1.0::DOUBLE AS r FROM X GROUP BY setup")
def stitch_turned_copy(spark: SparkSession, d: str) -> DataFrame:
    """Each view and its copy, whose image is turned by a right angle and whose map turns it back, but (2 + setup, -1, 0) too far."""
    # Every view's voxels are few, the rows they are summed from many: these are read once.
    v = stored(fx.voxels(spark, d))
    whole = F.col("setup").cast("long")
    copy = v.select((whole + 4).alias("setup"), (63 - F.col("y")).alias("x"), F.col("x").alias("y"), "z", "v")
    chunks = ch.from_voxels(v.select(whole.alias("setup"), "x", "y", "z", "v").unionByName(copy), (32, 32, 8))
    zero, one, minus = F.lit(0.0), F.lit(1.0), F.lit(-1.0)
    back = F.array(zero, one, zero, whole + 2.0, minus, zero, zero, F.lit(62.0), zero, zero, one, zero)
    size = {f"n{x}{s}": F.lit(n).cast("long") for x, n in zip("xyz", (64, 64, 8), strict=True) for s in ("", "_b")}
    box = {f"i{x}{i}": F.lit(n).cast("long") for x, lo, hi in zip("xyz", (0, 0, 0), (63, 63, 7), strict=True) for i, n in ((0, lo), (1, hi))}
    pairs = v.select("setup").distinct().select(F.lit(0).alias("tp"), whole.alias("setup"), F.lit(0).alias("tp_b"), (whole + 4).alias("setup_b"), g.affine(g.IDENTITY).alias("m"), back.alias("m_b"), *[c.alias(n) for n, c in {**size, **box}.items()])
    found = registration.stitch_rendered(pairs, chunks, subpixel=False)
    return found.select("setup", "setup_b", *[(F.round(f"d{x}") + 0.0).alias(f"d{x}") for x in "xyz"], F.round("r", 6).alias("r"))
