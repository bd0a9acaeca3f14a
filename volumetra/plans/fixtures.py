"""Views, voxels, points, transforms and correspondences derived from the supplied tables by whole-number formulas.

Each has a Spark form and the same as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def views(spark: SparkSession, d: str) -> DataFrame:
    """Views with their boxes."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    x0, y0 = p % 20 * 90, F.expr("p_partkey div 20") * 90
    return _read(spark, d, "part").select(
        p.alias("setup"), (p % 4).alias("tp"), (p % 3).alias("channel"), (size % 2).alias("angle"), F.expr("p_partkey div 12").alias("tile"),
        x0.alias("x0"), (x0 + 99 + size).alias("x1"), y0.alias("y0"), (y0 + 99 + size).alias("y1"), (size % 10).alias("z0"), (size % 10 + 49).alias("z1"),
    )


V = """V AS (SELECT p_partkey AS setup, p_partkey % 4 AS tp, p_partkey % 3 AS channel, (p_size % 2)::BIGINT AS angle, p_partkey // 12 AS tile,
  p_partkey % 20 * 90 AS x0, p_partkey % 20 * 90 + 99 + p_size AS x1, p_partkey // 20 * 90 AS y0, p_partkey // 20 * 90 + 99 + p_size AS y1,
  (p_size % 10)::BIGINT AS z0, (p_size % 10 + 49)::BIGINT AS z1 FROM part)"""


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of four views that overlap."""
    rows = _read(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 4).alias("setup"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"),
        (F.col("l_linenumber") - 1).cast("long").alias("z"), "l_quantity",
    )
    return rows.groupBy("setup", "x", "y", "z").agg(F.sum("l_quantity").alias("v"))


X = """X AS (SELECT l_orderkey % 4 AS setup, l_partkey % 64 AS x, l_suppkey % 64 AS y, (l_linenumber - 1)::BIGINT AS z, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Interest points."""
    e = F.col("event_id")
    return _read(spark, d, "events").select(
        (F.col("user_id") % 8).alias("setup"), e.alias("id"), F.col("event_type").alias("label"), (e % 97).alias("x"), (F.expr("event_id div 97") % 97).alias("y"),
        (e % 13).alias("z"), F.col("value").alias("intensity"),
    )


P = """P AS (SELECT user_id % 8 AS setup, event_id AS id, event_type AS label, event_id % 97 AS x, event_id // 97 % 97 AS y, event_id % 13 AS z,
  value AS intensity FROM events)"""


def stacks(spark: SparkSession, d: str) -> DataFrame:
    """Transform stacks: seq 0 is applied last."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return _read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("view"), (F.row_number().over(order) - 1).alias("seq"), F.col("l_partkey").alias("shift_x"), F.col("l_suppkey").alias("shift_y"), F.col("l_quantity").cast("long").alias("scale"),
    )


R = """R AS (SELECT l_orderkey AS view,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1)::INTEGER AS seq,
  l_partkey AS shift_x, l_suppkey AS shift_y, l_quantity::BIGINT AS scale FROM lineitem)"""


def correspondences(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b"))


K = "K AS (SELECT l_partkey AS id_a, l_suppkey AS id_b FROM lineitem)"


def points_a(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return _read(spark, d, "part").select(p.alias("id"), (p % 7).alias("setup"), (p % 101).alias("x"), (p % 89).alias("y"), (p % 23).alias("z"))


def points_b(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return _read(spark, d, "supplier").select(s.alias("id"), (s % 5).alias("setup"), (s % 103).alias("x"), (s % 83).alias("y"), (s % 29).alias("z"))


AB = """PA AS (SELECT p_partkey AS id, p_partkey % 7 AS setup, p_partkey % 101 AS x, p_partkey % 89 AS y, p_partkey % 23 AS z FROM part),
PB AS (SELECT s_suppkey AS id, s_suppkey % 5 AS setup, s_suppkey % 103 AS x, s_suppkey % 83 AS y, s_suppkey % 29 AS z FROM supplier)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """Stitching links between views, with shift and correlation."""
    n = F.col("l_linenumber").cast("long")
    return _read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("setup"), F.col("l_suppkey").alias("setup_b"), F.col("l_orderkey").alias("link"), n.alias("n"),
        (F.round(F.col("l_discount") * 100) / 10).alias("r"), (F.col("l_quantity") - 25).alias("dx"), (n * 3 - 10).cast("double").alias("dy"), F.round(F.col("l_tax") * 100).alias("dz"),
    )


L = """L AS (SELECT l_partkey AS setup, l_suppkey AS setup_b, l_orderkey AS link, l_linenumber::BIGINT AS n, round(l_discount * 100) / 10 AS r,
  l_quantity - 25 AS dx, (l_linenumber::BIGINT * 3 - 10)::DOUBLE AS dy, round(l_tax * 100) AS dz FROM lineitem)"""


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Whole-number descriptors: even ids are side 0, odd ids side 1."""
    w = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), w.alias("w"), (F.col("vec_id") % 2).alias("side"))


D = "D AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)) AS w, vec_id % 2 AS side FROM embeddings)"
