"""Intensity coefficients (scale, offset) of cells that reconcile their matches, by conjugate gradients on stored tables.

A match says v_b = k v + d for a cell of each of two views. The coefficients minimize, over all matches with their weights and
at the two ends of the range, the squared difference of what both cells make of the same intensity, drawn towards scale 1
and offset 0. The normal equations are sparse: a block of 2 x 2 numbers for each cell and for each matched pair of cells.

Scale: the pairs of cells lie in a table, once for each direction; a round multiplies it with the current direction of all
cells (one join, sums by cell with partial aggregation) and writes the cells' state. The driver gets one row of sums a
round. The direction is broadcast while it has at most ``BROADCAST_CELLS`` cells, joined by shuffle beyond. Up to ``LOCAL``
pairs, which is counted, the same steps are taken by numpy on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators.graph import stored

BROADCAST_CELLS, LOCAL, RANGE, TOLERANCE = 1_000_000, 100_000, 255.0, 1e-9


def pair_blocks(matches: DataFrame) -> DataFrame:
    """(cell, other, o00..o11, s00, s01, s11): what a match (a, b, k, d, w) adds to the block of its two cells and to a cell's own,
    for both directions; offsets count in units of the range."""
    low, high, w = F.col("d") / RANGE, F.col("k") + F.col("d") / RANGE, F.col("w")
    both, squares = low + high, low * low + high * high
    rows = [("a", "b", -w * high, -w, -w * both, -2 * w, w, w, 2 * w), ("b", "a", -w * high, -w * both, -w, -2 * w, w * squares, w * both, 2 * w)]
    names = ("o00", "o01", "o10", "o11", "s00", "s01", "s11")
    parts = [matches.select(F.col(c).alias("cell"), F.col(o).alias("other"), *[v.alias(n) for n, v in zip(names, values, strict=True)]) for c, o, *values in rows]
    return parts[0].unionAll(parts[1])


def solve(matches: DataFrame, blend: float = 0.1, iterations: int = 1000, store: Callable[[DataFrame], DataFrame] = stored, local: int = LOCAL, rounds: list[int] | None = None) -> DataFrame:
    """(cell, scale, offset) for every cell of matches (a, b, k, d, w). ``rounds`` gets the number of rounds."""
    pairs = store(pair_blocks(matches))
    if pairs.count() <= 2 * local:
        return _solve_here(pairs, blend, iterations)
    own = pairs.groupBy("cell").agg(*[(F.sum(c) + (blend if c != "s01" else 0.0)).alias(c) for c in ("s00", "s01", "s11")])
    state = store(own.select("*", F.lit(1.0).alias("p0"), F.lit(0.0).alias("p1")))
    few = state.count() <= BROADCAST_CELLS

    def times(state: DataFrame) -> DataFrame:
        """``state`` with (q0, q1), the matrix times (p0, p1)."""
        p = state.select(F.col("cell").alias("other"), "p0", "p1")
        off = pairs.join(F.broadcast(p) if few else p, "other").groupBy("cell").agg(F.sum(F.expr("o00 * p0 + o01 * p1")).alias("f0"), F.sum(F.expr("o10 * p0 + o11 * p1")).alias("f1"))
        return state.join(off, "cell").withColumns({"q0": F.expr("s00 * p0 + s01 * p1 + f0"), "q1": F.expr("s01 * p0 + s11 * p1 + f1")}).drop("f0", "f1")

    det = "(s00 * s11 - s01 * s01)"
    eased = {"z0": F.expr(f"(s11 * r0 - s01 * r1) / {det}"), "z1": F.expr(f"(s00 * r1 - s01 * r0) / {det}")}
    total = lambda df, e: float(df.agg(F.sum(F.expr(e))).first()[0] or 0.0)
    # The start is scale 1 and offset 0, so that p is x.
    state = times(state).select("cell", "s00", "s01", "s11", F.col("p0").alias("x0"), F.col("p1").alias("x1"), (F.lit(blend) - F.col("q0")).alias("r0"), (-F.col("q1")).alias("r1"))
    state = store(state.withColumns(eased).withColumns({"p0": F.col("z0"), "p1": F.col("z1")}))
    size = first = total(state, "r0 * z0 + r1 * z1")
    n = 0
    while n < iterations and size > TOLERANCE**2 * max(first, 1e-30):
        state, n = store(times(state.drop("z0", "z1"))), n + 1
        step = size / total(state, "p0 * q0 + p1 * q1")
        moved = state.withColumns({**{f"x{i}": F.col(f"x{i}") + step * F.col(f"p{i}") for i in (0, 1)}, **{f"r{i}": F.col(f"r{i}") - step * F.col(f"q{i}") for i in (0, 1)}}).drop("q0", "q1").withColumns(eased)
        before, size = size, total(moved, "r0 * z0 + r1 * z1")
        state = moved.withColumns({f"p{i}": F.col(f"z{i}") + size / before * F.col(f"p{i}") for i in (0, 1)})
    if rounds is not None:
        rounds.append(n)
    return state.select("cell", F.col("x0").alias("scale"), (F.col("x1") * RANGE).alias("offset"))


def _solve_here(pairs: DataFrame, blend: float, iterations: int) -> DataFrame:
    """The same steps for a counted number of pairs."""
    rows = pairs.collect()
    cells = sorted({r["cell"] for r in rows})
    at = {c: i for i, c in enumerate(cells)}
    i, j = (np.array([at[r[c]] for r in rows], int) for c in ("cell", "other"))
    off = np.array([[[r["o00"], r["o01"]], [r["o10"], r["o11"]]] for r in rows]).reshape(-1, 2, 2)
    own = np.tile(blend * np.eye(2), (len(cells), 1, 1))
    np.add.at(own, i, np.array([[[r["s00"], r["s01"]], [r["s01"], r["s11"]]] for r in rows]).reshape(-1, 2, 2))

    def times(p: np.ndarray) -> np.ndarray:
        out = np.einsum("nij,nj->ni", own, p)
        np.add.at(out, i, np.einsum("nij,nj->ni", off, p[j]))
        return out

    x = np.tile([1.0, 0.0], (len(cells), 1))
    r = np.array([blend, 0.0]) - times(x)
    inverse = np.linalg.inv(own)
    z = np.einsum("nij,nj->ni", inverse, r)
    p, size = z.copy(), float((r * z).sum())
    first = max(size, 1e-30)
    for _ in range(iterations):
        if size <= TOLERANCE**2 * first:
            break
        q = times(p)
        step = size / float((p * q).sum())
        x, r = x + step * p, r - step * q
        z = np.einsum("nij,nj->ni", inverse, r)
        before, size = size, float((r * z).sum())
        p = z + size / before * p
    kind = dict(pairs.dtypes)["cell"]
    return pairs.sparkSession.createDataFrame([(c, float(s), float(o) * RANGE) for c, (s, o) in zip(cells, x, strict=True) if math.isfinite(s)], f"cell {kind}, scale double, offset double")
