"""The two nearest descriptors of another set, exactly, without comparing all with all.

A join by pivots (after Lu, Shen, Chen and Ooi, "Efficient processing of k nearest neighbor joins using MapReduce", 2012).
Some of ``b`` are pivots; every row of ``b`` belongs to the cell of its nearest one. From a cell's smallest and largest
distance to its pivot, and from the plane half-way between two pivots, a row of ``a`` knows how near a cell's rows can be at
best, and how far its second nearest can be at most. It visits cells in the order of the former, in waves of 1, 4, 16, ... ;
the second-best distance found so far decides whether the next ones are visited at all.

Scale: ``PIVOTS`` bounds the pivots and with them all that reaches the driver or every task. A cell is met in parts of about
``BLOCK`` rows on either side, so that a cell that many rows share is no single task. Waves lie in stored tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.operators.graph import stored

PIVOTS, BLOCK, GROWTH = 2048, 4096, 4
FOUND = "id_a long, id_b long, d double"


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances as sums of squares, in parts of bounded size.

    Of whole numbers whose squares add up exactly, products give the same numbers faster.
    """
    most = max((np.abs(v).max(initial=0.0) for v in (p, q)))
    if 4 * most * most * max(1, p.shape[1]) < 2**53 and all((v == np.rint(v)).all() for v in (p, q)):
        return ((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)) - 2 * (p @ q.T)
    out = np.empty((len(p), len(q)))
    step = max(1, 2**22 // max(1, q.size))
    for i in range(0, len(p), step):
        out[i : i + step] = ((p[i : i + step, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    return out


class Cells:
    """Pivots with members, and how far these are from them."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.of = np.array([r["cell"] for r in rows], int)
        self.pivots = pivots[self.of]
        self.low, self.high, self.n = (np.array([r[c] for r in rows], float) for c in ("low", "high", "n"))
        self.apart = np.sqrt(squared(self.pivots, self.pivots))

    def plan(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each row an upper bound of its second-best distance, and the cells that can hold one, nearest first, with the
        lower bounds of their distances."""
        d = np.sqrt(squared(x, self.pivots))
        upper = np.concatenate([d + self.low, np.where(self.n > 1, d + self.high, np.inf)], axis=1)
        most = np.partition(upper, 1, axis=1)[:, 1]
        own = d.argmin(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - np.take_along_axis(d, own[:, None], 1) ** 2) / (2 * self.apart[own])
        least = np.maximum.reduce([d - self.high, self.low - d, np.where(np.isfinite(plane), plane, 0.0), np.zeros_like(d)])
        order = np.lexsort((d, least)) if len(x) == 0 else np.stack([np.lexsort((d[i], least[i])) for i in range(len(x))])
        bounds = [least[i][o] for i, o in enumerate(order)]
        kept = [int((b <= slack(m)).sum()) for b, m in zip(bounds, most, strict=True)]
        return most, [self.of[o[:k]] for o, k in zip(order, kept, strict=True)], [b[:k] for b, k in zip(bounds, kept, strict=True)]


def slack(x: float) -> float:
    """A distance with room for rounding."""
    return x * (1 + 1e-9) + 1e-9


def nearest_two(a: DataFrame, b: DataFrame, vector: str, pivots: int = PIVOTS, block: int = BLOCK, store: Callable[[DataFrame], DataFrame] = stored, meetings: list[int] | None = None) -> DataFrame:
    """(id_a, id_b, d1, d2): each descriptor of ``a`` with the nearest of ``b`` and the squared distances of the two nearest (d2
    is null if ``b`` has one row). Ties go to the smaller id; rows without a descriptor take no part. The number of rows compared
    in each wave is added to ``meetings``."""
    rows = lambda t: t.filter(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("w"))
    right = store(rows(b))
    n = right.count()
    best = a.sparkSession.createDataFrame([], FOUND)
    if n:
        some = right.orderBy(F.xxhash64("id"), "id").limit(min(pivots, math.isqrt(n - 1) + 1)).collect()
        places = np.unique(np.array([r["w"] for r in some], float), axis=0)

        def home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                d = squared(np.array(pdf["w"].to_list(), float).reshape(len(pdf), -1), places) if len(pdf) else np.zeros((0, 1))
                yield pdf.assign(cell=d.argmin(axis=1), r=np.sqrt(d.min(axis=1)))

        members = store(right.mapInPandas(home, "id long, w array<double>, cell int, r double"))
        sizes = members.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect()  # a row for each pivot
        best = _waves(rows(a), members, Cells(places, sizes), block, store, meetings)
    first = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    return best.withColumn("rank", _rank()).groupBy("id_a").agg(first("id_b", 1).alias("id_b"), first("d", 1).alias("d1"), first("d", 2).alias("d2"))


def _rank():
    return F.row_number().over(Window.partitionBy("id_a").orderBy("d", "id_b"))


def _waves(left: DataFrame, members: DataFrame, cells: Cells, block: int, store: Callable[[DataFrame], DataFrame], meetings: list[int] | None) -> DataFrame:
    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                most, of, bounds = cells.plan(np.array(pdf["w"].to_list(), float))
                yield pdf.assign(most=most, cells=[c.tolist() for c in of], bounds=[x.tolist() for x in bounds])

    def meet(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id_a": [], "id_b": [], "d": []})
        y = y.sort_values("id")
        p, q, ids = np.array(x["w"].to_list(), float), np.array(y["w"].to_list(), float), y["id"].to_numpy()
        out = []
        for i in range(0, len(p), 512):
            d = squared(p[i : i + 512], q)
            two = np.argsort(d, axis=1, kind="stable")[:, :2]
            for k in range(two.shape[1]):
                out.append(pd.DataFrame({"id_a": x["id"].to_numpy()[i : i + 512], "id_b": ids[two[:, k]], "d": np.take_along_axis(d, two[:, k : k + 1], 1)[:, 0]}))
        return pd.concat(out)

    spark, count = left.sparkSession, dict(zip(cells.of.tolist(), cells.n.astype(int).tolist(), strict=True))
    state = store(left.mapInPandas(plan, "id long, w array<double>, most double, cells array<int>, bounds array<double>"))
    best, at, wave = None, 0, 1
    while True:
        known = state
        if best is not None:
            second = best.groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("k"), F.sqrt(F.max("d")).alias("d")).filter("k = 2").select("id", "d")
            known = state.join(second, "id", "left").withColumn("most", F.least("most", F.coalesce("d", "most")))
        visit = F.explode(F.slice(F.arrays_zip("cells", "bounds"), at + 1, wave)).alias("v")
        visits = store(known.select("id", "w", "most", visit).filter(F.col("v.bounds") <= F.col("most") * (1 + 1e-9) + 1e-9).select("id", "w", F.col("v.cells").alias("cell")))
        met = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row for each pivot
        if not met:
            return best if best is not None else spark.createDataFrame([], FOUND)
        if meetings is not None:
            meetings.append(sum(k * count[c] for c, k in met.items()))
        shares = F.broadcast(spark.createDataFrame([(c, -(-count[c] // block), -(-k // block)) for c, k in met.items()], "cell int, subs int, parts int"))
        deal = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        x = visits.join(shares, "cell").select("id", "w", "cell", deal("parts").alias("part"), every("subs").alias("sub"))
        y = members.join(shares, "cell").select("id", "w", "cell", deal("subs").alias("sub"), every("parts").alias("part"))
        new = x.groupBy("cell", "part", "sub").cogroup(y.groupBy("cell", "part", "sub")).applyInPandas(meet, FOUND)
        best = store((new if best is None else best.unionByName(new)).withColumn("rank", _rank()).filter("rank <= 2").drop("rank"))
        at, wave = at + wave, wave * GROWTH
