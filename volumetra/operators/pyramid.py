"""Resolution pyramids and the choice of a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half(voxels: DataFrame, factors: tuple[int, int, int] = (2, 2, 2), by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each cell of ``factors`` (1 or 2 along each axis) voxels; ``by`` names further keys."""
    if any(f not in (1, 2) for f in factors):
        raise ValueError("a level halves an axis or leaves it")
    cell = [F.expr(f"{x} div {f}").alias(x) for x, f in zip("xyz", factors, strict=True)]
    return voxels.groupBy(*by, *cell).agg(F.avg("v").alias("v"))


def levels(voxels: DataFrame, relative: list[tuple[int, int, int]], by: tuple[str, ...] = ()) -> list[DataFrame]:
    """All levels, each from the one before."""
    out = [voxels]
    for f in relative[1:]:
        out.append(half(out[-1], f, by))
    return out


def mipmap(factors: tuple[int, int, int]) -> list[float]:
    """The map from a level's coordinates to full resolution: cells average their voxels, so centres move by (f-1)/2."""
    m = [0.0] * 12
    for i, f in enumerate(factors):
        m[5 * i], m[4 * i + 3] = float(f), (f - 1) / 2
    return m


def level_for_fusion(levels: DataFrame, steps: tuple[Column, Column, Column], slack: float = 0.02, by: tuple[str, ...] = ("setup",)) -> DataFrame:
    """(by, level): the coarsest level whose steps in the output are below 1 + slack or within slack of level 0's.

    ``levels`` has setup, level, fx, fy, fz; ``steps`` are the output steps of full resolution. Level 0 if none fits.
    """
    ok = F.lit(True)
    for x, s in zip("xyz", steps, strict=True):
        ok = ok & ((s * F.col(f"f{x}") < 1 + slack) | (F.abs(s * F.col(f"f{x}") - s) < slack))
    best = F.max_by(F.when(ok, F.col("level")), F.when(ok, F.struct(F.col("fx") * F.col("fy") * F.col("fz"), "level")))
    return levels.groupBy(*by).agg(F.coalesce(best, F.lit(0)).alias("level"))


def level_for_detection(levels: DataFrame, wanted: tuple[int, int, int]) -> DataFrame:
    """(setup, level): the last level whose rounded factors are powers of two up to 128 and not above the wanted ones."""
    ok = F.lit(True)
    for x, w in zip("xyz", wanted, strict=True):
        f = F.round(F.col(f"f{x}")).cast("int")
        ok = ok & (f <= w) & f.isin(1, 2, 4, 8, 16, 32, 64, 128)
    return levels.groupBy("setup").agg(F.max(F.when(ok, F.col("level"))).alias("level"))


def residual_factors(wanted: tuple[int, int, int]) -> list[Column]:
    """What is left to downsample after the level's own factors."""
    return [(F.lit(w) / F.round(F.col(f"f{x}"))).cast("int").alias(f"r{x}") for x, w in zip("xyz", wanted, strict=True)]


def common_step(levels: DataFrame) -> DataFrame:
    """(sx, sy, sz): the least common multiple of the levels' factors, which tile sizes have to be multiples of."""
    gcd = "aggregate(sequence(1, 64), struct(a as a, b as b), (s, i) -> if(s.b = 0, s, struct(s.b as a, s.a % s.b as b))).a"
    cols = []
    for x in "xyz":
        pair = gcd.replace("(a as a, b as b)", "(acc as a, e as b)")
        cols.append(F.expr(f"aggregate(collect_set(cast(f{x} as bigint)), 1L, (acc, e) -> acc * e div {pair})").alias(f"s{x}"))
    return levels.agg(*cols)
