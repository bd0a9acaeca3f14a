"""Values of overlapping views compared on one grid of the world, block by block.

A chunk is binned where it lies: the sum and number of its voxels in each cell of the grid, told apart by the coefficient
cell of the view, cut into blocks of the grid and packed, one row for each block. A pair of views meets in the blocks of its
intersection alone; there both sides' means are compared in numpy, and each pair of coefficient cells gives one packed row
of values. No voxel becomes a row, a group holds two views' part of one block, and a fit gets the values of one pair of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators.kernels import intensities, models
from volumetra.sources import chunks as ch

#: Grid cells of a block along each axis.
BLOCK = 64
#: Voxels whose places are computed at a time.
STEP = 1 << 18
#: A cell of a block: where it is, the coefficient cell, and the sum and number of voxels.
BINNED = np.dtype([("at", "<i4"), ("cell", "<i4"), ("total", "<f8"), ("n", "<i4")])
PAIR = {"tp": "int", "setup": "long", "tp_b": "int", "setup_b": "long"}
AXES = ("x", "y", "z")


def _binned(a: np.ndarray, origin, m: np.ndarray, factors, size, cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grid cells, coefficient cells, sums, numbers) of the voxels of a chunk. ``m`` takes its image's voxels to the grid;
    coefficient cells are of the full resolution, ``factors`` finer and of ``size`` voxels."""
    origin, shape, factors, cells = np.array(origin), np.array(a.shape), np.array(factors, float), np.array(cells)
    corners = np.stack(np.meshgrid(*[(o, o + n - 1) for o, n in zip(origin, shape, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
    ends = models.apply(m, corners.astype(float))
    low = np.floor(ends.min(axis=0)).astype(np.int64) - 1
    extent = np.floor(ends.max(axis=0)).astype(np.int64) + 2 - low
    values, found = a.reshape(-1), []
    for begin in range(0, values.size, STEP):
        v = values[begin : begin + STEP].astype(float)
        p = np.column_stack(np.unravel_index(np.arange(begin, begin + len(v)), a.shape)) + origin
        w = np.floor(models.apply(m, p.astype(float))).astype(np.int64) - low
        c = np.clip(np.floor((p * factors + (factors - 1) / 2) * cells / np.array(size)).astype(np.int64), 0, cells - 1)
        code, place = np.unique(np.ravel_multi_index(w.T, extent) * cells.prod() + np.ravel_multi_index(c.T, cells), return_inverse=True)
        found.append((code, np.bincount(place, v), np.bincount(place)))
    code, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    total, n = (np.bincount(place, np.concatenate([f[i] for f in found])) for i in (1, 2))
    return np.column_stack(np.unravel_index(code // cells.prod(), extent)) + low, code % cells.prod(), total, n.astype(np.int64)


def binned_blocks(views: DataFrame, chunks: DataFrame, cells: tuple[int, int, int], block: int = BLOCK) -> DataFrame:
    """(tp, setup, bx, by, bz, payload): what each chunk shows of each block of the grid, as a packed array of ``BINNED``.

    ``views``: tp, setup, m from voxels of the stored level to the grid, the level's factors f{x} and the size n{x} at full
    resolution; metadata, so they are broadcast. Missing chunks show nothing.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                a = ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
                w, cell, total, n = _binned(a, (r.ox, r.oy, r.oz), np.array(r.m, float).reshape(3, 4), (r.fx, r.fy, r.fz), (r.nx, r.ny, r.nz), cells)
                of, place = np.unique(w // block, axis=0, return_inverse=True)
                packed = np.zeros(len(w), BINNED)
                packed["at"] = np.ravel_multi_index((w % block).T, (block,) * 3)
                packed["cell"], packed["total"], packed["n"] = cell, total, n
                order = np.argsort(place.reshape(-1), kind="stable")
                for b, own in zip(of, np.split(packed[order], np.cumsum(np.bincount(place.reshape(-1)))[:-1]), strict=True):
                    rows.append((r.tp, r.setup, *b.tolist(), own.tobytes()))
            yield pd.DataFrame(rows, columns=["tp", "setup", "bx", "by", "bz", "payload"])

    v = views.select("tp", "setup", "m", *[F.col(f"f{x}").cast("double").alias(f"f{x}") for x in AXES], *[f"n{x}" for x in AXES])
    named = chunks.select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload").join(F.broadcast(v), ["tp", "setup"])
    return named.mapInPandas(run, "tp int, setup long, bx long, by long, bz long, payload binary")


def _means(payloads, low: float, high: float | None) -> np.ndarray:
    """The cells of one view in one block with their means in ``total``, those outside of low..high left out; by place."""
    rows = np.concatenate([np.frombuffer(p, BINNED) for p in payloads])
    code, first, place = np.unique(rows["at"].astype(np.int64) << 32 | rows["cell"], return_index=True, return_inverse=True)
    out = rows[first]
    out["total"] = np.bincount(place, rows["total"]) / np.bincount(place, rows["n"])
    return out[(out["total"] >= low) & (out["total"] <= (np.inf if high is None else high))]


def cell_values(pairs: DataFrame, views: DataFrame, chunks: DataFrame, cells: tuple[int, int, int] = (8, 8, 8), scale: float = 1.0, low: float = 0.0, high: float | None = None, block: int = BLOCK) -> DataFrame:
    """(tp, setup, tp_b, setup_b, cell, cell_b, n, v): of each pair of coefficient cells the packed values (float64, those of
    the first view, then those of the second) where both views show something between ``low`` and ``high``; a row for each block.

    ``pairs``: tp, setup, tp_b, setup_b and both world boxes {x}0..{x}1, {x}0_b..{x}1_b; the grid has ``scale`` cells a world
    unit. ``views`` and ``chunks`` as of ``binned_blocks``. ``cell`` counts coefficient cells with z fastest.
    """
    met = pairs.select(*[F.col(c).cast(k).alias(f"p_{c}") for c, k in PAIR.items()], *[c.alias(f"i{x}{i}") for x in AXES for i, c in ((0, F.greatest(f"{x}0", f"{x}0_b")), (1, F.least(f"{x}1", f"{x}1_b")))])
    for x in AXES:
        # A cell more on both sides: boxes are of voxel centres, rounded.
        first, last = [F.floor((F.floor(F.col(f"i{x}{i}") * scale) + d) / block) for i, d in ((0, -1), (1, 1))]
        met = met.withColumn(f"b{x}", F.explode(F.sequence(first, last)))
    sides = [met.select(*[f"p_{c}" for c in PAIR], *[f"b{x}" for x in AXES], F.lit(i).alias("side"), F.col(f"p_tp{s}").alias("tp"), F.col(f"p_setup{s}").alias("setup")) for i, s in ((0, ""), (1, "_b"))]
    parts = sides[0].unionByName(sides[1]).join(binned_blocks(views, chunks, cells, block), ["tp", "setup", "bx", "by", "bz"])
    columns = [*PAIR, "cell", "cell_b", "n", "v"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["side"].nunique() < 2:
            return pd.DataFrame([], columns=columns)
        a, b = (_means(pdf.loc[pdf["side"] == s, "payload"], low, high) for s in (0, 1))
        # Cells of b are ranges of equal places, as they are sorted.
        begin, end = np.searchsorted(b["at"], a["at"], "left"), np.searchsorted(b["at"], a["at"], "right")
        times = end - begin
        i = np.repeat(np.arange(len(a)), times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
        both = a["cell"][i].astype(np.int64) << 32 | b["cell"][j]
        order = np.argsort(both, kind="stable")
        codes, starts = np.unique(both[order], return_index=True)
        rows = []
        for code, at in zip(codes.tolist(), np.split(order, starts[1:]), strict=False):
            v = np.concatenate([a["total"][i[at]], b["total"][j[at]]])
            rows.append((*key[:4], code >> 32, code & 0xFFFFFFFF, len(at), v.tobytes()))
        return pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{c} {k}" for c, k in PAIR.items()) + ", cell int, cell_b int, n long, v binary"
    return parts.groupBy(*[f"p_{c}" for c in PAIR], "bx", "by", "bz").applyInPandas(run, schema)


def unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """The values of the first view and those of the second, of packed rows."""
    halves = [np.frombuffer(v, "<f8").reshape(2, -1) for v in rows]
    return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])


def match_cells(values: DataFrame, cells: tuple[int, int, int] = (8, 8, 8), method: str = "RANSAC", at_least: int = 1000, **options) -> DataFrame:
    """(tp, setup, tp_b, setup_b, cx.., cx_b.., n, scale, offset): the linear relation v_b = scale v + offset of each pair of
    cells of ``cell_values`` with at least ``at_least`` values."""
    by = [*PAIR, "cell", "cell_b"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = intensities.relation(*unpacked(pdf["v"]), method, **options) if pdf["n"].sum() >= at_least else None
        return pd.DataFrame([(*key, *found)] if found else [], columns=[*by, "n", "scale", "offset"])

    schema = ", ".join(f"{c} {k}" for c, k in PAIR.items()) + ", cell int, cell_b int, n long, scale double, offset double"
    fit = values.groupBy(*by).applyInPandas(run, schema)
    nx, ny, nz = cells
    split = {f"c{x}{s}": c.cast("long") for s, k in (("", F.col("cell")), ("_b", F.col("cell_b"))) for x, c in zip(AXES, (F.floor(k / (ny * nz)), F.floor(k / nz) % ny, k % nz), strict=True)}
    return fit.select(*PAIR, *[c.alias(n) for n, c in split.items()], "n", "scale", "offset")
