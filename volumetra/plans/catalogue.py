"""One query per relational operator on the fixtures, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.functions import intensity
from volumetra.operators import blocks, fuse, graph, neighbours, points, pyramid, select, spatial
from volumetra.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CELL = 150
FACES = [f"{x}{i}" for x in "xyz" for i in (0, 1)]
OVERLAP = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND a.z0 <= b.z1 AND a.z1 >= b.z0"


def query(sql: str, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # SQL that begins with a comma goes on with the list of table expressions.
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# --- Selection ---------------------------------------------------------------------------------------------------


@query("SELECT setup, tp, channel, angle, tile FROM V WHERE channel IN (0, 2) AND angle IN (1) AND tp IN (0, 1)", fx.V)
def select_attributes(spark: SparkSession, d: str) -> DataFrame:
    v = select.by_attributes(fx.views(spark, d), channel=[0, 2], angle=[1], tile=None, tp=[0, 1])
    return v.select("setup", "tp", "channel", "angle", "tile")


@query("SELECT setup, tp, channel FROM V WHERE (tp, setup) IN ((1, 5), (2, 6), (3, 7), (3, 9))", fx.V)
def select_explicit_ids(spark: SparkSession, d: str) -> DataFrame:
    return select.by_ids(fx.views(spark, d), [(1, 5), (2, 6), (3, 7), (3, 7), (3, 9)]).select("setup", "tp", "channel")


@query("SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM V", fx.V)
def maximal_bbox(spark: SparkSession, d: str) -> DataFrame:
    return select.maximal_box(fx.views(spark, d))


@query("SELECT setup, (dense_rank() OVER (ORDER BY tp) - 1)::INTEGER AS t_index, (dense_rank() OVER (ORDER BY channel) - 1)::INTEGER AS c_index FROM V", fx.V)
def volume_assignment(spark: SparkSession, d: str) -> DataFrame:
    return select.volume_indices(fx.views(spark, d)).select("setup", "t_index", "c_index")


@query("SELECT tp, min(setup) AS setup FROM V GROUP BY tp", fx.V)
def fixed_views_per_tp(spark: SparkSession, d: str) -> DataFrame:
    return select.fixed_views(fx.views(spark, d), ["tp"])


@query("SELECT setup, (row_number() OVER (ORDER BY tile % 4, setup % 12 DESC, tile) - 1)::BIGINT AS new_setup FROM V", fx.V)
def setup_renumbering(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d).select("setup", F.col("tile").alias("row"), (F.col("setup") % 12).alias("col"))
    return select.renumbered(v).withColumn("new_setup", F.col("new_setup").cast("long"))


@query("SELECT max(setup) + 1 AS next_setup, max(tile) + 1 AS next_tile, max(channel) + 1 AS next_channel, max(angle) + 1 AS next_angle FROM V", fx.V)
def next_setup_ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.views(spark, d).agg(*[(F.max(c) + 1).alias(f"next_{c}") for c in ("setup", "tile", "channel", "angle")])


# --- Blocks and geometry -----------------------------------------------------------------------------------------


@query(
    """SELECT setup, ox, oy, oz, least(64, x1 - x0 + 1 - ox) AS sx, least(64, y1 - y0 + 1 - oy) AS sy, least(32, z1 - z0 + 1 - oz) AS sz,
  ox // 64 AS gx, oy // 64 AS gy, oz // 32 AS gz
FROM V, LATERAL (SELECT unnest(range(0, x1 - x0 + 1, 64)) AS ox), LATERAL (SELECT unnest(range(0, y1 - y0 + 1, 64)) AS oy),
  LATERAL (SELECT unnest(range(0, z1 - z0 + 1, 32)) AS oz)""",
    fx.V,
)
def grid_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.grid(fx.views(spark, d), (64, 64, 32))
    return b.select("setup", *[f"{k}{x}" for k in "osg" for x in "xyz"])


@query(
    """SELECT setup, ox, oy, oz, greatest(ox - 1, 0) AS hx0, least(ox + least(64, x1 - x0 + 1 - ox), x1 - x0) AS hx1,
  greatest(oy - 1, 0) AS hy0, least(oy + least(64, y1 - y0 + 1 - oy), y1 - y0) AS hy1,
  greatest(oz - 1, 0) AS hz0, least(oz + least(32, z1 - z0 + 1 - oz), z1 - z0) AS hz1
FROM V, LATERAL (SELECT unnest(range(0, x1 - x0 + 1, 64)) AS ox), LATERAL (SELECT unnest(range(0, y1 - y0 + 1, 64)) AS oy),
  LATERAL (SELECT unnest(range(0, z1 - z0 + 1, 32)) AS oz)""",
    fx.V,
)
def block_halo(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.halo(blocks.grid(fx.views(spark, d), (64, 64, 32)))
    return b.select("setup", "ox", "oy", "oz", *[f"h{x}{i}" for x in "xyz" for i in (0, 1)])


MAP = (1.5, -0.25, 0.0, 7.5, 0.5, 1.0, 0.125, -3.0, 0.0, 0.0, 2.0, 0.25)


@query(
    """SELECT setup, floor(1.5 * x0 - 0.25 * y1 + 7.5)::BIGINT AS bx0, ceil(1.5 * x1 - 0.25 * y0 + 7.5)::BIGINT AS bx1,
  floor(0.5 * x0 + y0 + 0.125 * z0 - 3.0)::BIGINT AS by0, ceil(0.5 * x1 + y1 + 0.125 * z1 - 3.0)::BIGINT AS by1,
  floor(2.0 * z0 + 0.25)::BIGINT AS bz0, ceil(2.0 * z1 + 0.25)::BIGINT AS bz1 FROM V""",
    fx.V,
)
def transformed_bbox(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d).withColumn("m", g.affine(MAP))
    lo, hi = g.containing_box(F.col("m"), [F.col(f"{x}0") for x in "xyz"], [F.col(f"{x}1") for x in "xyz"])
    return v.select("setup", *[c.alias(f"b{x}{i}") for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))])


@query("SELECT id, 1.5::DOUBLE * x - 0.25::DOUBLE * y + 7.5 AS px, 0.5::DOUBLE * x + y + 0.125::DOUBLE * z - 3.0 AS py, 2.0::DOUBLE * z + 0.25 AS pz FROM P", fx.P)
def transformed_points(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).withColumn("m", g.affine(MAP))
    return p.select("id", *[c.alias(f"p{x}") for x, c in zip("xyz", g.apply(F.col("m"), (F.col("x"), F.col("y"), F.col("z"))), strict=True)])


@query(
    """, G AS (SELECT view, count(*) AS n, sum(shift_x)::DOUBLE AS tx, sum(shift_y)::DOUBLE AS ty FROM R GROUP BY view) SELECT view, n, tx, ty, -tx AS inverse_tx FROM G""",
    fx.R,
)
def composed_transforms(spark: SparkSession, d: str) -> DataFrame:
    """The product of each view's ordered list of translations, and its inverse."""
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0)], F.col("shift_x").cast("double"), *[F.lit(v) for v in (0.0, 1.0, 0.0)], F.col("shift_y").cast("double"), *[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)])
    lists = fx.stacks(spark, d).groupBy("view").agg(F.sort_array(F.collect_list(F.struct("seq", one.alias("m")))).alias("l"))
    whole = lists.select("view", F.size("l").cast("long").alias("n"), g.compose_list(F.transform("l", lambda e: e["m"])).alias("m"))
    return whole.select("view", "n", F.col("m")[3].alias("tx"), F.col("m")[7].alias("ty"), g.invert(F.col("m"))[3].alias("inverse_tx"))


@query("SELECT setup, z0, z1, floor(z0 / 2.5)::BIGINT AS az0, ceil(z1 / 2.5)::BIGINT AS az1 FROM V", fx.V)
def anisotropy_boxes(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = g.anisotropy_box(F.col("z0"), F.col("z1"), 2.5)
    return fx.views(spark, d).select("setup", "z0", "z1", lo.alias("az0"), hi.alias("az1"))


@query(
    """SELECT setup, tx0, least(tx0 + 63, x1) AS tx1, ty0, least(ty0 + 63, y1) AS ty1, tz0, least(tz0 + 31, z1) AS tz1
FROM V, LATERAL (SELECT unnest(range(x0, greatest(x0, x1 - 16) + 1, 48)) AS tx0), LATERAL (SELECT unnest(range(y0, greatest(y0, y1 - 16) + 1, 48)) AS ty0),
  LATERAL (SELECT unnest(range(z0, greatest(z0, z1 - 8) + 1, 24)) AS tz0)""",
    fx.V,
)
def split_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = blocks.split_tiles(fx.views(spark, d), (62, 62, 30), (14, 14, 7), (4, 4, 4))
    return t.select("setup", *[f"t{x}{i}" for x in "xyz" for i in (0, 1)])


@query(
    """, B AS (SELECT setup, gx, gy FROM V, LATERAL (SELECT unnest(range(0, (x1 - x0) // 64 + 1)) AS gx), LATERAL (SELECT unnest(range(0, (y1 - y0) // 64 + 1)) AS gy))
SELECT setup, gx, gy FROM B WHERE NOT (setup % 5 = 0 OR (gx + gy + setup) % 3 = 0)""",
    fx.V,
)
def failed_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.grid(fx.views(spark, d), (64, 64, 64)).select("setup", "gx", "gy", "gz")
    done = b.filter((F.col("setup") % 5 == 0) | ((F.col("gx") + F.col("gy") + F.col("setup")) % 3 == 0))
    return blocks.missing(b, done, ["setup", "gx", "gy", "gz"]).select("setup", "gx", "gy")


# --- Range joins -------------------------------------------------------------------------------------------------

_I = "greatest(a.x0, b.x0) AS ix0, least(a.x1, b.x1) AS ix1, greatest(a.y0, b.y0) AS iy0, least(a.y1, b.y1) AS iy1"


@query(f"SELECT a.setup, b.setup AS setup_b, {_I} FROM V a JOIN V b ON (a.tp, a.setup) < (b.tp, b.setup) AND {OVERLAP}", fx.V)
def view_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = spatial.overlapping_pairs(fx.views(spark, d), CELL)
    return pairs.select("setup", "setup_b", *g.intersection(axes=("x", "y")))


@query(f"SELECT a.setup, b.setup AS setup_b FROM V a JOIN V b ON a.tp = b.tp AND a.angle = b.angle AND a.setup < b.setup AND {OVERLAP}", fx.V)
def view_overlap_same_channel(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within one timepoint that agree in a further attribute (here the angle: channels never meet in this fixture)."""
    return spatial.overlapping_pairs(fx.views(spark, d), CELL, ["tp", "angle"]).select("setup", "setup_b")


_BLOCKS = """, M AS (SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM V),
B AS (SELECT ox // 256 AS gx, oy // 256 AS gy, x0 + ox AS x0, least(x0 + ox + 255, x1) AS x1, y0 + oy AS y0, least(y0 + oy + 255, y1) AS y1, z0, z1
  FROM M, LATERAL (SELECT unnest(range(0, x1 - x0 + 1, 256)) AS ox), LATERAL (SELECT unnest(range(0, y1 - y0 + 1, 256)) AS oy))"""


def _blocks_of_all(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.grid(select.maximal_box(fx.views(spark, d)), (256, 256, 256))
    return blocks.block_boxes(b).select("gx", "gy", *FACES)


@query(
    _BLOCKS + """ SELECT a.gx, a.gy, b.setup FROM B a JOIN V b ON a.x0 - 2 <= b.x1 AND a.x1 + 2 >= b.x0 AND a.y0 - 2 <= b.y1 AND a.y1 + 2 >= b.y0
  AND a.z0 - 2 <= b.z1 AND a.z1 + 2 >= b.z0""",
    fx.V,
)
def block_view_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spatial.box_join(_blocks_of_all(spark, d), fx.views(spark, d), 256, expand=2).select("gx", "gy", F.col("setup_b").alias("setup"))


@query(
    _BLOCKS + """, H AS (SELECT a.gx, a.gy, b.* FROM B a JOIN V b ON a.x0 - 50 <= b.x1 AND a.x1 + 50 >= b.x0 AND a.y0 - 50 <= b.y1 AND a.y1 + 50 >= b.y0
  AND a.z0 - 50 <= b.z1 AND a.z1 + 50 >= b.z0)
SELECT gx, gy, tp, setup FROM H UNION
SELECT a.gx, a.gy, b.tp, b.setup FROM H a JOIN V b ON a.x0 - 50 <= b.x1 AND a.x1 + 50 >= b.x0 AND a.y0 - 50 <= b.y1 AND a.y1 + 50 >= b.y0
  AND a.z0 - 50 <= b.z1 AND a.z1 + 50 >= b.z0""",
    fx.V,
)
def two_hop_views(spark: SparkSession, d: str) -> DataFrame:
    return spatial.two_hop(_blocks_of_all(spark, d), fx.views(spark, d), 256, ["gx", "gy"])


@query(
    f""", G AS (SELECT tp, angle, tile, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1, count(*) AS n FROM V GROUP BY tp, angle, tile)
SELECT a.tp, a.angle, a.tile, b.tile AS tile_b, a.n, b.n AS n_b FROM G a JOIN G b ON a.tp = b.tp AND a.angle = b.angle AND a.tile < b.tile AND {OVERLAP}""",
    fx.V,
)
def grouped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Channels are grouped; tiles are compared within a timepoint and angle."""
    by = ["tp", "angle", "tile"]
    groups = fx.views(spark, d).groupBy(*by).agg(*[f(f"{x}{i}").alias(f"{x}{i}") for x in "xyz" for i, f in ((0, F.min), (1, F.max))], F.count("*").alias("n"))
    return spatial.box_join(groups, groups, 300, ["tp", "angle"], F.col("tile") < F.col("tile_b")).select("tp", "angle", "tile", "tile_b", "n", "n_b")


def _pairs_by_tile(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d).select("setup", "tp", "tile")
    return v.join(spatial.renamed(v), (F.col("tile") == F.col("tile_b")) & (F.col("setup") < F.col("setup_b")))


@query("SELECT a.setup, b.setup AS setup_b, a.tp, b.tp AS tp_b FROM V a JOIN V b ON a.tile = b.tile AND a.setup < b.setup AND abs(a.tp - b.tp) <= 1", fx.V)
def timepoint_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_by_tile(spark, d).filter(F.abs(F.col("tp") - F.col("tp_b")) <= 1).select("setup", "setup_b", "tp", "tp_b")


@query("SELECT a.setup, b.setup AS setup_b, a.tp, b.tp AS tp_b FROM V a JOIN V b ON a.tile = b.tile AND a.setup < b.setup AND (a.tp = 2 OR b.tp = 2)", fx.V)
def reference_tp_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_by_tile(spark, d).filter((F.col("tp") == 2) | (F.col("tp_b") == 2)).select("setup", "setup_b", "tp", "tp_b")


@query("SELECT a.setup, b.setup AS setup_b FROM V a JOIN V b ON a.tile = b.tile AND a.setup < b.setup AND a.tp = b.tp", fx.V)
def individual_tp_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_by_tile(spark, d).filter(F.col("tp") == F.col("tp_b")).select("setup", "setup_b")


@query(
    f""", E AS (SELECT a.setup AS a, b.setup AS b FROM V a JOIN V b ON a.tp = b.tp AND a.angle = b.angle AND a.setup < b.setup AND {OVERLAP}),
N AS (SELECT a, b FROM E UNION ALL SELECT b, a FROM E),
C AS (SELECT setup AS id, setup AS s FROM V UNION SELECT N.b, C.s FROM C JOIN N ON N.a = C.id AND C.s < N.b)
SELECT id AS setup, min(s) AS subset FROM C GROUP BY id""",
    fx.V,
)
def view_subsets(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d)
    e = spatial.overlapping_pairs(v, CELL, ["tp", "angle"])
    found = graph.components(v.select(F.col("setup").alias("id")), e.select(F.col("setup").alias("a"), F.col("setup_b").alias("b")))
    return found.select(F.col("id").alias("setup"), "subset")


@query(f"SELECT a.setup, b.setup AS setup_b FROM V a JOIN V b ON (a.tp, a.setup) < (b.tp, b.setup) AND {OVERLAP} WHERE NOT (a.setup % 50 = 0 AND b.setup % 50 = 0) AND a.tile <> b.tile AND NOT (a.setup < 8 AND b.setup < 8)", fx.V)
def exclude_fixed_or_grouped(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d)
    fixed = v.filter((F.col("setup") % 50 == 0) | (F.col("setup") < 8)).select("setup")
    pairs = spatial.overlapping_pairs(v, CELL)
    # Two sets of fixed views: both are applied.
    out = points.without_fixed(pairs, fixed.filter(F.col("setup") % 50 == 0), F.col("tile") == F.col("tile_b"))
    return points.without_fixed(out, fixed.filter("setup < 8"), F.lit(False)).select("setup", "setup_b")


# --- Fusion ------------------------------------------------------------------------------------------------------


@query("SELECT x, y, z, round(avg(v), 6) AS v FROM X GROUP BY x, y, z", fx.X)
def fuse_avg(spark: SparkSession, d: str) -> DataFrame:
    return fuse.average(fx.voxels(spark, d)).withColumn("v", F.round("v", 6))


@query(
    """, W AS (SELECT *, least(x + 1 + setup, 64 - x + 2 * setup) * least(y + 1 + setup, 64 - y + setup) AS w FROM X)
SELECT x, y, z, round(sum(w * v) / sum(w), 6) AS v FROM W GROUP BY x, y, z""",
    fx.X,
)
def fuse_avg_blend(spark: SparkSession, d: str) -> DataFrame:
    x, y, s = F.col("x"), F.col("y"), F.col("setup")
    w = F.least(x + 1 + s, 64 - x + 2 * s) * F.least(y + 1 + s, 64 - y + s)
    return fuse.average_blend(fx.voxels(spark, d), w).withColumn("v", F.round("v", 6))


@query("SELECT x, y, z, max(v) AS v FROM X GROUP BY x, y, z", fx.X)
def fuse_max(spark: SparkSession, d: str) -> DataFrame:
    return fuse.maximum(fx.voxels(spark, d))


@query("SELECT x, y, z, arg_min(v, setup) AS v FROM X GROUP BY x, y, z", fx.X)
def fuse_lowest_view(spark: SparkSession, d: str) -> DataFrame:
    return fuse.lowest_view(fx.voxels(spark, d))


@query("SELECT x, y, z, arg_max(v, setup) AS v FROM X GROUP BY x, y, z", fx.X)
def fuse_highest_view(spark: SparkSession, d: str) -> DataFrame:
    return fuse.highest_view(fx.voxels(spark, d))


@query(
    """, Q AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY (x - 10 - 12 * setup) ** 2 + (y - 50 + 11 * setup) ** 2, setup) AS n FROM X)
SELECT x, y, z, v FROM Q WHERE n = 1""",
    fx.X,
)
def fuse_closest_pixel(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = F.col("x") - 10 - 12 * F.col("setup"), F.col("y") - 50 + 11 * F.col("setup")
    return fuse.closest(fx.voxels(spark, d), dx * dx + dy * dy)


@query(
    """SELECT x, y, z, CASE WHEN bool_or(x BETWEEN s * 8 - 1 AND s * 8 + 31 AND y BETWEEN s * 5 - 1 AND s * 5 + 21 AND z BETWEEN s AND s + 2) THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM X, (SELECT unnest([0, 1, 2, 3]) AS s) GROUP BY x, y, z""",
    fx.X,
)
def fusion_mask(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("id")
    views = spark.range(4).select((s * 8).alias("x0"), (s * 8 + 30).alias("x1"), (s * 5).alias("y0"), (s * 5 + 20).alias("y1"), s.alias("z0"), (s + 2).alias("z1"))
    return fuse.mask(fx.voxels(spark, d), views, (1.0, 1.0, 0.0), intensity.mask_value("UINT8"))


@query(
    """SELECT setup, x, y, z, greatest(0, least(255, floor((v - 5.0) * 255.0 / 95.0 + 0.5)))::SMALLINT AS u8,
  greatest(0, least(65535, floor((v - 5.0) * 65535.0 / 95.0 + 0.5)))::INTEGER AS u16, v::FLOAT AS f32 FROM X""",
    fx.X,
)
def rescale_uint8(spark: SparkSession, d: str) -> DataFrame:
    r = lambda kind: intensity.rescale(F.col("v"), 5.0, 100.0, kind)
    return fx.voxels(spark, d).select("setup", "x", "y", "z", r("UINT8").alias("u8"), r("UINT16").alias("u16"), r("FLOAT32").alias("f32"))


@query(
    """SELECT x, y, z, round(avg(CASE WHEN setup = 0 THEN v ELSE 1.5 * v + setup - x // 16 END), 6) AS v FROM X GROUP BY x, y, z""",
    fx.X,
)
def fuse_with_coefficients(spark: SparkSession, d: str) -> DataFrame:
    c = spark.range(4 * 4 * 4 * 7).selectExpr("id % 4 as setup", "cast(id div 4 % 4 as int) as cx", "cast(id div 16 % 4 as int) as cy", "cast(id div 64 as int) as cz")
    c = c.filter("setup > 0").select("*", F.lit(1.5).alias("scale"), (F.col("setup") - F.col("cx")).cast("double").alias("offset"))
    return fuse.average(fuse.corrected(fx.voxels(spark, d), c, (16, 16, 1))).withColumn("v", F.round("v", 6))


@query(
    """, S AS (SELECT DISTINCT setup, x, y, z, x + 0.25 AS px, y + 0.5 AS py, z + 0.0 AS pz FROM X),
C AS (SELECT S.*, i, j, least(63, x + i) AS cx, least(63, y + j) AS cy, CASE WHEN i = 1 THEN 0.25 ELSE 0.75 END * 0.5 AS w
  FROM S, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT C.setup, px::DOUBLE AS px, py::DOUBLE AS py, pz::DOUBLE AS pz, round(sum(w * v)::DOUBLE, 6) AS v FROM C JOIN X ON X.setup = C.setup AND X.x = cx AND X.y = cy AND X.z = C.z GROUP BY ALL""",
    fx.X,
)
def trilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    v = fx.voxels(spark, d)
    at = v.select("setup", (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"), F.col("z").cast("double").alias("pz"))
    return fuse.trilinear(at, v, (0, 0, 0), (63, 63, 6)).withColumn("v", F.round("v", 6))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse.maximum(fx.voxels(spark, d))


_F = "F AS (SELECT x, y, z, max(v) AS v FROM X GROUP BY x, y, z)"
_F1 = "F1 AS (SELECT x // 2 AS x, y // 2 AS y, z AS z, avg(v) AS v FROM F GROUP BY ALL)"


@query("SELECT x, y, z, round(v, 6) AS v FROM F1", fx.X, _F, _F1)
def pyramid_level_1(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.half(_fused(spark, d), (2, 2, 1)).withColumn("v", F.round("v", 6))


@query("SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(v), 5) AS v FROM F1 GROUP BY ALL", fx.X, _F, _F1)
def pyramid_level_2(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.levels(_fused(spark, d), [(1, 1, 1), (2, 2, 1), (2, 2, 2)])[2].withColumn("v", F.round("v", 5))


_STEP = "SELECT a.x, a.y, a.z, a.v, b.x - a.x AS dx, b.v AS w FROM F a JOIN F b ON"


@query(
    f""", J AS ({_STEP} b.z = a.z AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1)
SELECT x, y, z, CASE WHEN median(w) > 0 THEN any_value(v) / median(w) ELSE 0 END AS v FROM J GROUP BY x, y, z""",
    fx.X, _F,
)
def median_ratio_2d(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.median_ratio(_fused(spark, d), 1)


@query(
    """SELECT a.x, a.y, a.z, a.v FROM F a WHERE NOT EXISTS (SELECT 1 FROM F b WHERE b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
  AND b.z BETWEEN a.z - 1 AND a.z + 1 AND (b.x, b.y, b.z) <> (a.x, a.y, a.z) AND b.v >= a.v)""",
    fx.X, _F,
)
def local_maxima_3d(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.extrema(_fused(spark, d))


@query(
    f""", J AS ({_STEP} b.z = a.z AND b.y = a.y AND abs(b.x - a.x) <= 2)
SELECT x, y, z, round(sum(w * (CASE abs(dx) WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 0 END - CASE abs(dx) WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 1 END) / 16.0)::DOUBLE, 6) AS v FROM J GROUP BY x, y, z""",
    fx.X, _F,
)
def dog_1d(spark: SparkSession, d: str) -> DataFrame:
    narrow, wide = {0: 8, 1: 4, 2: 0}, {0: 6, 1: 4, 2: 1}
    kernel = {(i, 0, 0): (narrow[abs(i)] - wide[abs(i)]) / 16 for i in range(-2, 3)}
    return neighbours.filtered(_fused(spark, d), kernel).withColumn("v", F.round("v", 6))


_CANDIDATES = "G AS (SELECT a.setup, b.setup AS setup_b, a.x, a.y, a.z, a.v, b.v AS v_b FROM X a JOIN X b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.setup < b.setup)"


@query("SELECT setup, setup_b, count(*) AS n, round(corr(v, v_b), 6) AS r FROM G GROUP BY setup, setup_b", fx.X, _CANDIDATES)
def ncc_of_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = points.cell_matches(fx.voxels(spark, d), (64, 64, 64))
    return m.groupBy("setup", "setup_b").agg(F.count("*").alias("n"), F.round(F.corr("v", "v_b"), 6).alias("r"))


@query(
    """SELECT setup, setup_b, x // 16 AS cx, y // 16 AS cy, z // 4 AS cz, count(*) AS n, round(regr_slope(v_b, v), 6) AS scale, round(regr_intercept(v_b, v), 6) AS "offset"
FROM G WHERE v BETWEEN 3 AND 400 AND v_b BETWEEN 3 AND 400 GROUP BY ALL HAVING count(*) >= 10""",
    fx.X, _CANDIDATES,
)
def intensity_linear_match(spark: SparkSession, d: str) -> DataFrame:
    fit = points.linear_fit(points.cell_matches(fx.voxels(spark, d), (16, 16, 4), 3, 400), 10)
    return fit.withColumn("scale", F.round("scale", 6)).withColumn("offset", F.round("offset", 6))


@query(
    """, H AS (SELECT *, x // 16 AS cx, y // 16 AS cy, z // 4 AS cz, row_number() OVER (PARTITION BY setup, setup_b, x // 16, y // 16, z // 4 ORDER BY v) AS n_a,
  row_number() OVER (PARTITION BY setup, setup_b, x // 16, y // 16, z // 4 ORDER BY v_b) AS n_b FROM G)
SELECT a.setup, a.setup_b, a.cx, a.cy, a.cz, a.n_a::INTEGER AS rank, a.v, b.v_b FROM H a JOIN H b
  ON a.setup = b.setup AND a.setup_b = b.setup_b AND a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.n_a = b.n_b""",
    fx.X, _CANDIDATES,
)
def intensity_histogram_match(spark: SparkSession, d: str) -> DataFrame:
    """Within a cell the n-th darkest voxel of one view goes with the n-th darkest of the other."""
    by = ["setup", "setup_b", "cx", "cy", "cz"]
    m = points.cell_matches(fx.voxels(spark, d), (16, 16, 4)).groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("a"), F.sort_array(F.collect_list("v_b")).alias("b"))
    out = m.select(*by, F.posexplode(F.arrays_zip("a", "b")).alias("n", "p"))
    return out.select(*by, (F.col("n") + 1).alias("rank"), F.col("p.a").alias("v"), F.col("p.b").alias("v_b"))


# --- Points and correspondences ----------------------------------------------------------------------------------


@query(
    """SELECT setup, label, id, intensity, new_id FROM (SELECT *, (row_number() OVER (PARTITION BY setup, label ORDER BY intensity DESC, id) - 1)::INTEGER AS new_id FROM P) WHERE new_id < 10""",
    fx.P,
)
def topn_brightest(spark: SparkSession, d: str) -> DataFrame:
    return points.brightest(fx.points(spark, d), 10, ["setup", "label"]).select("setup", "label", "id", "intensity", "new_id")


@query(
    """, I AS (SELECT s AS setup, i AS interval, i * 20 AS x0, i * 20 + 10 + 10 * i + s AS x1, 5 * s AS y0, 5 * s + 30 AS y1, 0 AS z0, 12 AS z1 FROM (SELECT unnest(range(8)) AS s), (SELECT unnest(range(4)) AS i)),
S AS (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1) AS size FROM I), N AS (SELECT *, round(2.0::DOUBLE * size / (SELECT max(size) FROM S)) AS spots FROM S),
Q AS (SELECT P.id, P.setup, N.interval, spots, row_number() OVER (PARTITION BY P.setup, N.interval ORDER BY intensity DESC, id) AS n FROM P JOIN N
  ON P.setup = N.setup AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)
SELECT id, setup, interval FROM Q WHERE n <= spots OR spots = 0""",
    fx.P,
)
def topn_per_overlap(spark: SparkSession, d: str) -> DataFrame:
    i = spark.range(32).selectExpr("id % 8 as setup", "id div 8 as interval").selectExpr(
        "setup", "interval", "interval * 20 as x0", "interval * 20 + 10 + 10 * interval + setup as x1", "5 * setup as y0", "5 * setup + 30 as y1", "0L as z0", "12L as z1"
    )
    return points.brightest_per_interval(fx.points(spark, d), i, 2, 40).select("id", "setup", "interval")


@query(
    """SELECT a.setup, a.id FROM P a WHERE a.label = 'click' AND NOT EXISTS (SELECT 1 FROM P b WHERE b.label = 'view' AND b.setup = a.setup
  AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 9)""",
    fx.P,
)
def dedupe_two_lists(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return points.far_from(p.filter("label = 'click'"), p.filter("label = 'view'"), 3, ["setup"]).select("setup", "id")


@query(
    """, I AS (SELECT s AS setup, s * 10 AS x0, s * 10 + 15 AS x1, s * 9 AS y0, s * 9 + 22 AS y1, 0 AS z0, 9 AS z1 FROM (SELECT unnest(range(8)) AS s))
SELECT setup, id FROM P WHERE EXISTS (SELECT 1 FROM I WHERE I.setup <> P.setup AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)""",
    fx.P,
)
def overlap_only_points(spark: SparkSession, d: str) -> DataFrame:
    v = spark.range(8).selectExpr("id as setup", "id * 10 as x0", "id * 10 + 15 as x1", "id * 9 as y0", "id * 9 + 22 as y1", "0L as z0", "9L as z1")
    return points.in_other_views(fx.points(spark, d), v, 20).select("setup", "id")


@query(
    """SELECT id_a, id_b, PA.setup AS setup_a, PB.setup AS setup_b, PA.x + 2 * PA.setup AS xa, PA.y - PA.setup AS ya, PB.x - 3 * PB.setup AS xb, PB.y + PB.setup AS yb
FROM K JOIN PA ON id_a = PA.id JOIN PB ON id_b = PB.id""",
    fx.K, fx.AB,
)
def resolve_correspondences(spark: SparkSession, d: str) -> DataFrame:
    r = points.resolved(fx.correspondences(spark, d), fx.points_a(spark, d), fx.points_b(spark, d))
    s, t = F.col("setup"), F.col("setup_b")
    return r.select(
        "id_a", "id_b", s.alias("setup_a"), t.alias("setup_b"),
        (F.col("x") + 2 * s).alias("xa"), (F.col("y") - s).alias("ya"), (F.col("x_b") - 3 * t).alias("xb"), (F.col("y_b") + t).alias("yb"),
    )


@query("SELECT PA.setup AS setup_a, PB.setup AS setup_b, count(*) AS n FROM K JOIN PA ON id_a = PA.id JOIN PB ON id_b = PB.id GROUP BY ALL HAVING count(*) >= 12", fx.K, fx.AB)
def correspondences_per_pair(spark: SparkSession, d: str) -> DataFrame:
    r = points.resolved(fx.correspondences(spark, d), fx.points_a(spark, d), fx.points_b(spark, d))
    return points.per_pair(r.withColumnRenamed("setup", "setup_a"), 12, ["setup_a", "setup_b"])


@query(
    """SELECT PA.setup AS setup_a, PB.setup AS setup_b, round(avg(PB.x - PA.x), 6) AS tx, round(avg(PB.y - PA.y), 6) AS ty, round(avg(PB.z - PA.z), 6) AS tz
FROM K JOIN PA ON id_a = PA.id JOIN PB ON id_b = PB.id GROUP BY ALL""",
    fx.K, fx.AB,
)
def fit_translation(spark: SparkSession, d: str) -> DataFrame:
    r = points.resolved(fx.correspondences(spark, d), fx.points_a(spark, d), fx.points_b(spark, d))
    shift = [F.round(F.avg(F.col(f"{x}_b") - F.col(x)), 6).alias(f"t{x}") for x in "xyz"]
    return r.groupBy(F.col("setup").alias("setup_a"), "setup_b").agg(*shift)


@query("SELECT V.setup, count(P.id) AS n FROM V LEFT JOIN P ON V.setup = P.setup GROUP BY V.setup", fx.V, fx.P)
def pad_missing_views(spark: SparkSession, d: str) -> DataFrame:
    return points.padded(fx.views(spark, d), fx.points(spark, d))


@query("SELECT setup, label, count(*) AS n, count(DISTINCT (x, y, z)) AS places FROM P GROUP BY setup, label", fx.P)
def point_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.points(spark, d).groupBy("setup", "label").agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("places"))


@query(
    """, T AS (SELECT a.id AS id_a, b.id AS id_b, list_sum(list_transform(list_zip(a.w, b.w), lambda p: (p[1] - p[2]) ** 2)) AS d FROM D a JOIN D b ON a.side = 0 AND b.side = 1),
Q AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d, id_b) AS n, lead(d) OVER (PARTITION BY id_a ORDER BY d, id_b) AS d2 FROM T)
SELECT id_a, id_b, d AS d1, d2 FROM Q WHERE n = 1 AND (d2 IS NULL OR d * 1.05 < d2)""",
    fx.D,
)
def descriptor_ratio_match(spark: SparkSession, d: str) -> DataFrame:
    w = fx.descriptors(spark, d)
    return points.ratio_test(points.best_two(w.filter("side = 0"), w.filter("side = 1"), "w"), 1.05)


# --- Links and transforms ----------------------------------------------------------------------------------------


@query("SELECT link, n, setup, setup_b, r, dx, dy, dz FROM L WHERE r BETWEEN 0.3 AND 0.9 AND abs(dx) <= 15 AND abs(dz) <= 5 AND sqrt(dx * dx + dy * dy + dz * dz) <= 14", fx.L)
def link_filters(spark: SparkSession, d: str) -> DataFrame:
    return points.link_filters(fx.links(spark, d), 0.3, 0.9, (15, None, 5), 14).select("link", "n", "setup", "setup_b", "r", "dx", "dy", "dz")


@query(
    """, S AS (SELECT *, (SELECT 1) AS one, CASE WHEN n % 3 <> 0 THEN setup * 31 + 7 ELSE setup * 31 + 8 END AS digest FROM L)
SELECT link, n, S.setup, S.setup_b FROM S JOIN V ON V.setup = S.setup WHERE digest = V.setup * 31 + 7""",
    fx.L, fx.V,
)
def stale_link_filter(spark: SparkSession, d: str) -> DataFrame:
    links = fx.links(spark, d).withColumn("reg_hash", F.col("setup") * 31 + F.when(F.col("n") % 3 != 0, 7).otherwise(8))
    now = fx.views(spark, d).select("setup", (F.col("setup") * 31 + 7).alias("reg_hash"))
    return points.current_links(links, now, ["setup"]).select("link", "n", "setup", "setup_b")


@query(
    """, O AS (SELECT DISTINCT setup, setup_b FROM L WHERE setup <> setup_b), N AS (SELECT setup_b AS setup, setup AS setup_b FROM O WHERE (setup + setup_b) % 2 = 0)
SELECT setup, setup_b, 'old' AS origin FROM O a WHERE NOT EXISTS (SELECT 1 FROM N WHERE (N.setup = a.setup AND N.setup_b = a.setup_b) OR (N.setup = a.setup_b AND N.setup_b = a.setup))
UNION ALL SELECT setup, setup_b, 'new' FROM N""",
    fx.L,
)
def upsert_links(spark: SparkSession, d: str) -> DataFrame:
    old = fx.links(spark, d).filter("setup <> setup_b").select("setup", "setup_b").distinct()
    new = old.filter((F.col("setup") + F.col("setup_b")) % 2 == 0).select(F.col("setup_b").alias("setup"), F.col("setup").alias("setup_b"))
    return points.upserted(old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), (["setup"], ["setup_b"]))


@query("SELECT view, seq, shift_x, shift_y FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY seq DESC) AS n FROM R) WHERE n <= 2", fx.R)
def keep_first_n(spark: SparkSession, d: str) -> DataFrame:
    return points.keep_first(fx.stacks(spark, d), 2, ["view"]).select("view", "seq", "shift_x", "shift_y")


@query("SELECT view, seq, shift_x, shift_y FROM R WHERE seq >= 2", fx.R)
def remove_last_n(spark: SparkSession, d: str) -> DataFrame:
    return points.remove_last(fx.stacks(spark, d), 2, ["view"]).select("view", "seq", "shift_x", "shift_y")


@query("SELECT view, seq + 1 AS seq, shift_x, shift_y, scale FROM R WHERE view % 2 = 0 UNION ALL SELECT view, seq, shift_x, shift_y, scale FROM R WHERE view % 2 <> 0 UNION ALL SELECT DISTINCT view, 0, 1, 2, 3 FROM R WHERE view % 2 = 0", fx.R)
def prepend_transform(spark: SparkSession, d: str) -> DataFrame:
    r = fx.stacks(spark, d)
    new = r.filter("view % 2 = 0").select("view").distinct().selectExpr("view", "1L as shift_x", "2L as shift_y", "3L as scale")
    return points.prepended(r, new, ["view"])


# --- Levels, counts ----------------------------------------------------------------------------------------------

_LV = """LV AS (SELECT setup, level, (2 ** level)::DOUBLE AS fx, (2 ** level)::DOUBLE AS fy, (2 ** greatest(0, level - setup % 2))::DOUBLE AS fz,
  1.0 / (2 ** (setup % 3)) AS s FROM V, (SELECT unnest(range(5)) AS level))"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d).select("setup", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("level"))
    two = lambda e: F.pow(F.lit(2.0), e)
    return v.select("setup", "level", two(F.col("level")).alias("fx"), two(F.col("level")).alias("fy"), two(F.greatest(F.lit(0), F.col("level") - F.col("setup") % 2)).alias("fz"), (1.0 / two(F.col("setup") % 3)).alias("s"))


@query(
    """, Q AS (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY fx * fy * fz DESC, level DESC) AS n FROM LV
  WHERE (s * fx < 1.02 OR abs(s * fx - s) < 0.02) AND (s * fy < 1.02 OR abs(s * fy - s) < 0.02) AND (s * fz < 1.02 OR abs(s * fz - s) < 0.02))
SELECT V.setup, coalesce(level, 0) AS level FROM V LEFT JOIN Q ON Q.setup = V.setup AND n = 1""",
    fx.V, _LV,
)
def best_level(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return pyramid.level_for_fusion(_levels(spark, d), (s, s, s))


@query("SELECT setup, max(level) FILTER (fx <= 4 AND fy <= 4 AND fz <= 2) AS level FROM LV GROUP BY setup", fx.V, _LV)
def best_level_detection(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.level_for_detection(_levels(spark, d), (4, 4, 2))


@query("SELECT setup, level, (4 / fx)::INTEGER AS rx, (4 / fy)::INTEGER AS ry, (4 / fz)::INTEGER AS rz FROM LV WHERE level <= 2", fx.V, _LV)
def residual_downsampling(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("level <= 2").select("setup", "level", *pyramid.residual_factors((4, 4, 4)))


@query("SELECT " + ", ".join(f"list_reduce(array_agg(DISTINCT f{x}::BIGINT), lambda a, b: lcm(a, b)) AS s{x}" for x in "xyz") + " FROM LV", fx.V, _LV)
def minimal_step(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.common_step(_levels(spark, d))


@query("SELECT round(avg((z1 - z0 + 1)::DOUBLE / (x1 - x0 + 1)), 9) AS anisotropy, count(*) AS n FROM V WHERE channel = 1", fx.V)
def average_anisotropy(spark: SparkSession, d: str) -> DataFrame:
    v = fx.views(spark, d).filter("channel = 1")
    return v.agg(F.round(F.avg((F.col("z1") - F.col("z0") + 1) / (F.col("x1") - F.col("x0") + 1)), 9).alias("anisotropy"), F.count("*").alias("n"))


@query("SELECT x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny, z1 - z0 + 1 AS nz, count(*) AS n FROM V GROUP BY ALL", fx.V)
def image_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    size = [(F.col(f"{x}1") - F.col(f"{x}0") + 1).alias(f"n{x}") for x in "xyz"]
    return fx.views(spark, d).groupBy(*size).agg(F.count("*").alias("n"))


@query(
    """, W AS (SELECT x, y, z, setup % 2 AS grp, arg_max(v, (s, -setup)) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY setup) AS s FROM X) GROUP BY ALL)
SELECT x, y, z, round(avg(v), 6) AS v FROM W GROUP BY x, y, z""",
    fx.X,
)
def group_combine(spark: SparkSession, d: str) -> DataFrame:
    """Of the views of a group (here: illuminations) the brightest on average counts, then groups (channels) are averaged."""
    v = fx.voxels(spark, d)
    # One row per view.
    mean = v.groupBy("setup").agg(F.avg("v").alias("s"))
    picked = v.join(F.broadcast(mean), "setup").groupBy("x", "y", "z", (F.col("setup") % 2).alias("grp")).agg(F.max_by("v", F.struct("s", -F.col("setup"))).alias("v"))
    return fuse.average(picked).withColumn("v", F.round("v", 6))
