"""Neighbourhoods of voxels, block by block: a voxel goes to its own block of a grid, and to those it borders on within the
neighbourhood's reach. One shuffle of the voxels and their border slabs, no join; a block is a dense array in its task.

Blocks are of a fixed size, so that a task holds (block + 2 reach) cubed voxels whatever the image. Voxels that are not there
are no neighbours (0 in filters).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def box_offsets(rx: int, ry: int, rz: int) -> list[tuple[int, int, int]]:
    return list(itertools.product(range(-rx, rx + 1), range(-ry, ry + 1), range(-rz, rz + 1)))


def disk_offsets(radius: int) -> list[tuple[int, int, int]]:
    return [(x, y, 0) for x, y, _ in box_offsets(radius, radius, 0) if x * x + y * y <= radius * radius]


def with_borders(voxels: DataFrame, reach: tuple[int, int, int], by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(by, x, y, z, v, block_x, block_y, block_z): each voxel once for every block that it lies in or borders on."""
    out = voxels.select(*by, *[F.col(x).cast("long").alias(x) for x in "xyz"], F.col("v").cast("double").alias("v"))
    for x, r in zip("xyz", reach, strict=True):
        if 2 * r > block:
            raise ValueError("a neighbourhood has to fit into a block")
        places = [F.floor((F.col(x) + d) / block) for d in ((-r, r) if r else (0,))]
        out = out.withColumn(f"block_{x}", F.explode(F.array_distinct(F.array(*places))) if r else places[0])
    return out


def _by_block(voxels: DataFrame, reach: tuple[int, int, int], by: tuple[str, ...], compute: Callable[[np.ndarray, Callable], tuple[np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """(by, x, y, z, v) of the voxels that ``compute`` keeps. It gets the block's voxels with NaN where none is, and a function that
    gives them shifted; it returns what is kept and its values, both for the whole block."""
    names = [*by, "x", "y", "z", "v"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        low = at.min(axis=0) - reach
        wide = np.full(at.max(axis=0) + np.array(reach) - low + 1, np.nan)
        wide[tuple((at - low).T)] = pdf["v"].to_numpy()
        inner = tuple(slice(r, n - r) for r, n in zip(reach, wide.shape, strict=True))

        def shifted(d: tuple[int, int, int]) -> np.ndarray:
            return wide[tuple(slice(s.start + o, s.stop + o) for s, o in zip(inner, d, strict=True))]

        kept, values = compute(wide[inner], shifted)
        mine = tuple((at - low - reach).T)
        own = (at // block == np.array(key[len(by) :], np.int64)).all(axis=1) & kept[mine]
        out = pdf.loc[own, names[:-1]].copy()
        out["v"] = values[mine][own]
        return out

    kinds = dict(voxels.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "x long, y long, z long, v double"])
    return with_borders(voxels, reach, by, block).groupBy(*by, "block_x", "block_y", "block_z").applyInPandas(run, schema)


def _reach(offsets) -> tuple[int, int, int]:
    return tuple(max(abs(o[i]) for o in offsets) for i in range(3))


def median_ratio(voxels: DataFrame, radius: int, by: tuple[str, ...] = (), disk: bool = False, block: int = BLOCK) -> DataFrame:
    """Background correction: v divided by the median around it in its slice; 0 where the median is not above 0."""
    offsets = disk_offsets(radius) if disk else box_offsets(radius, radius, 0)

    def compute(own: np.ndarray, shifted: Callable) -> tuple[np.ndarray, np.ndarray]:
        out, there = np.zeros(own.shape), ~np.isnan(own)
        for z in range(own.shape[2]):  # a slice at a time bounds the copies
            at = np.nonzero(there[:, :, z])
            around = np.stack([shifted(o)[:, :, z][at] for o in offsets])
            middle = np.nanmedian(around, axis=0) if around.size else np.zeros(0)
            out[(*at, z)] = np.where(middle > 0, own[(*at, z)] / np.where(middle > 0, middle, 1), 0.0)
        return there, out

    return _by_block(voxels, _reach(offsets), by, compute, block)


def extrema(voxels: DataFrame, by: tuple[str, ...] = (), maxima: bool = True, block: int = BLOCK) -> DataFrame:
    """Voxels strictly above (below) all of their up to 26 neighbours; those without neighbours too. The extreme of the
    neighbours is put together from running ones: of the planes before and behind, the rows beside, and the two next to it."""

    def compute(own: np.ndarray, shifted: Callable) -> tuple[np.ndarray, np.ndarray]:
        best, worst = (np.fmax, -np.inf) if maxima else (np.fmin, np.inf)
        row = lambda dy, dz: best(best(shifted((-1, dy, dz)), shifted((0, dy, dz))), shifted((1, dy, dz)))
        plane = lambda dz: best(best(row(-1, dz), row(0, dz)), row(1, dz))
        near = best(shifted((-1, 0, 0)), shifted((1, 0, 0)))
        for more in (row(-1, 0), row(1, 0), plane(-1), plane(1)):
            near = best(near, more)
        near = np.where(np.isnan(near), worst, near)
        return (own > near if maxima else own < near), own

    return _by_block(voxels, (1, 1, 1), by, compute, block)


def filtered(voxels: DataFrame, kernel: dict[tuple[int, int, int], float], by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Sum of kernel weight times neighbour, a neighbour being at x - dx; neighbours that are not there count as 0."""

    def compute(own: np.ndarray, shifted: Callable) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(own.shape)
        for (dx, dy, dz), w in kernel.items():
            total += w * np.nan_to_num(shifted((-dx, -dy, -dz)))
        return ~np.isnan(own), total

    return _by_block(voxels, _reach(kernel), by, compute, block)
