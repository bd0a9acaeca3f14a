"""Fusion: what one output voxel gets of the views that cover it. One row per (voxel, view) goes in.

All are partial aggregates by voxel: each task sends one row per voxel it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators import spatial

VOXEL = ("x", "y", "z")


def blend_weight(point: tuple[str, ...] = VOXEL, low: tuple[str, ...] = ("x0", "y0", "z0"), high: tuple[str, ...] = ("x1", "y1", "z1"), border: float = 0.0, width: float = 40.0) -> Column:
    """Own definition: per axis the cosine ramp of the distance to the nearer face over ``width`` voxels; their product."""
    out = F.lit(1.0)
    for p, a, b in zip(point, low, high, strict=True):
        d = F.least(F.col(p) - F.col(a), F.col(b) - F.col(p)) - border
        ramp = (F.lit(1.0) - F.cos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d + 1) / F.lit(width))) * F.lit(3.141592653589793))) / 2
        out = out * ramp
    return out


def average(rows: DataFrame, v: str = "v", by=VOXEL) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(v).alias("v"))


def average_blend(rows: DataFrame, weight: Column, v: str = "v", by=VOXEL) -> DataFrame:
    """Weighted mean; voxels of no weight are 0."""
    rows = rows.withColumn("__w", weight)
    total = F.sum("__w")
    return rows.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("__w") * F.col(v)) / total).otherwise(F.lit(0.0)).alias("v"))


def maximum(rows: DataFrame, v: str = "v", by=VOXEL) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(v).alias("v"))


def lowest_view(rows: DataFrame, key: tuple[str, ...] = ("setup",), v: str = "v", by=VOXEL) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(v, F.struct(*key)).alias("v"))


def highest_view(rows: DataFrame, key: tuple[str, ...] = ("setup",), v: str = "v", by=VOXEL) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(v, F.struct(*key)).alias("v"))


def closest(rows: DataFrame, distance: Column, key: tuple[str, ...] = ("setup",), v: str = "v", by=VOXEL) -> DataFrame:
    """The view whose centre (own metric: squared distance to it) is the nearest, ties to the lowest view."""
    return rows.withColumn("__d", distance).groupBy(*by).agg(F.min_by(v, F.struct("__d", *key)).alias("v"))


def mask(voxels: DataFrame, views: DataFrame, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), value: float = 255.0, cell: int = 64) -> DataFrame:
    """``value`` where some view's box, extended by the offset, holds the voxel, else 0."""
    places = voxels.select(*VOXEL).distinct()
    boxes = views.select(*[(F.col(f"{x}{i}") + (o if i else -o)).alias(f"{x}{i}") for x, o in zip("xyz", offset, strict=True) for i in (0, 1)])
    hit = spatial.points_in_boxes(places, boxes, cell).select(*VOXEL).distinct()
    return places.join(hit.withColumn("__hit", F.lit(True)), list(VOXEL), "left").select(*VOXEL, F.when(F.col("__hit"), F.lit(value)).otherwise(F.lit(0.0)).alias("v"))


def corrected(rows: DataFrame, coefficients: DataFrame, cell: tuple[int, int, int]) -> DataFrame:
    """Intensities with their view's linear coefficients (scale, offset) of the coefficient cell; 1 and 0 where there is none."""
    cells = {f"c{x}": F.floor(F.col(x) / F.lit(s)).cast("int") for x, s in zip("xyz", cell, strict=True)}
    joined = rows.withColumns(cells).join(coefficients, [*spatial.view_key(rows, coefficients), "cx", "cy", "cz"], "left")
    return joined.withColumn("v", F.coalesce("scale", F.lit(1.0)) * F.col("v") + F.coalesce("offset", F.lit(0.0))).drop("scale", "offset", "cx", "cy", "cz")


def trilinear(samples: DataFrame, voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Linear interpolation at real points (px, py, pz of samples): eight corners, those outside moved to the border.

    Both sides carry ``setup``; columns of samples stay and ``v`` is added.
    """
    corners = samples.withColumn("__k", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    weight = F.lit(1.0)
    for bit, (x, lo, hi) in enumerate(zip("xyz", low, high, strict=True)):
        up = F.shiftrightunsigned("__k", bit).bitwiseAND(F.lit(1))
        base = F.floor(f"p{x}")
        frac = F.col(f"p{x}") - base
        corners = corners.withColumn(x, F.greatest(F.lit(lo), F.least(F.lit(hi), base + up)).cast("long"))
        weight = weight * F.when(up == 1, frac).otherwise(F.lit(1.0) - frac)
    joined = corners.withColumn("__w", weight).join(voxels.select("setup", *[F.col(x).cast("long").alias(x) for x in "xyz"], "v"), ["setup", "x", "y", "z"])
    return joined.groupBy(*samples.columns).agg(F.sum(F.col("__w") * F.col("v")).alias("v"))
