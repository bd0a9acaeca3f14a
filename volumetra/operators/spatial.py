"""Range joins of boxes without nested loops.

Both sides are exploded to the cells of a coarse grid they touch and joined on the cell; a pair that shares several cells
is kept in one of them only: the cell of the lower corner of its intersection. The plan is an equi-join, which shuffles
by cell, and whose skewed cells adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.functions import geometry as g


def renamed(df: DataFrame, suffix: str = "_b") -> DataFrame:
    """Every column with the suffix."""
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def _celled(df: DataFrame, cell: int, axes: tuple[str, ...], suffix: str, out: str, expand: int = 0) -> DataFrame:
    for x in axes:
        lo, hi = F.col(f"{x}0{suffix}") - expand, F.col(f"{x}1{suffix}") + expand
        df = df.withColumn(f"__{out}{x}", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    return df


def box_join(a: DataFrame, b: DataFrame, cell: int, on: list[str] = (), where: Column | None = None, expand: int = 0, axes: tuple[str, ...] = g.AXES, grid: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pairs of rows whose boxes overlap along ``axes``, the boxes of ``a`` expanded by ``expand`` on every side.

    ``on`` names columns that have to be equal too; columns of ``b`` get the suffix _b; ``where`` filters the pairs.
    """
    left, right = _celled(a, cell, grid, "", "l", expand), _celled(renamed(b), cell, grid, "_b", "r")
    test = g.overlap(axes=axes, expand=expand)
    for c in on:
        test = test & (F.col(c) == F.col(f"{c}_b"))
    for x in grid:
        here = F.floor(F.greatest(F.col(f"{x}0") - expand, F.col(f"{x}0_b")) / cell)
        test = test & (F.col(f"__l{x}") == F.col(f"__r{x}")) & (F.col(f"__l{x}") == here)
    if where is not None:
        test = test & where
    out = left.join(right, test)
    return out.drop(*[f"__{s}{x}" for s in "lr" for x in grid])


def overlapping_pairs(views: DataFrame, cell: int, on: list[str] = (), axes: tuple[str, ...] = g.AXES) -> DataFrame:
    """Each unordered pair of views with overlapping boxes once.

    Both sides are shuffled: by the size of its file a table of views would be broadcast with all its cells, and one task for
    each file would meet all pairs.
    """
    return box_join(views, views.hint("merge"), cell, on, F.struct("tp", "setup") < F.struct("tp_b", "setup_b"), axes=axes)


def overlapping_some(a: DataFrame, b: DataFrame, cell: int, key: list[str], expand: int = 0) -> DataFrame:
    """Rows of ``a`` (distinct by ``key``) whose box overlaps some box of ``b``."""
    hits = box_join(a, b, cell, expand=expand).select(*key).distinct()
    return a.join(hits, key, "left_semi")


def as_boxes(points: DataFrame) -> DataFrame:
    """Points (x, y, z) with their boxes of one cell."""
    return points.withColumns({f"{x}{i}": F.col(x) for x in "xyz" for i in (0, 1)})


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int, where: Column | None = None) -> DataFrame:
    """Pairs of point and box that holds it; columns of the box get the suffix _b."""
    return box_join(as_boxes(points), boxes, cell, where=where).drop(*[f"{x}{i}" for x in "xyz" for i in (0, 1)])


def two_hop(blocks: DataFrame, views: DataFrame, cell: int, key: list[str], near: int = 50, further: int = 25) -> DataFrame:
    """(key, tp, setup): per block the views within ``near``, and every view that, both expanded by ``further``, overlaps one.

    Views meet views once, by a shuffle, whatever the number of blocks; a view meets itself too, so the second hop holds the first.
    """
    first = box_join(blocks, views, cell, expand=near).select(*key, F.col("tp_b").alias("tp"), F.col("setup_b").alias("setup"))
    second = box_join(views, views.hint("merge"), cell, expand=2 * further).select("tp", "setup", "tp_b", "setup_b")
    return first.join(second, ["tp", "setup"]).select(*key, F.col("tp_b").alias("tp"), F.col("setup_b").alias("setup")).distinct()


def view_key(*tables: DataFrame) -> list[str]:
    """What names a view in all of the tables: timepoint and setup, or the setup alone where one has no timepoints."""
    return [c for c in ("tp", "setup") if all(c in t.columns for t in tables)]


def local_overlaps(views: DataFrame, cell: int, where: Column | None = None) -> DataFrame:
    """(tp, setup, interval, x0..z1): for each view (m, n.., world box) and every other view that overlaps it, both ways, the
    part of the view's own image that the other one's image covers, in the view's own coordinates.

    The other image is mapped by its own map and the inverse of the view's.
    """
    v = views.withColumn("back", g.invert(F.col("m")))
    other = F.struct("tp", "setup") != F.struct("tp_b", "setup_b")
    met = box_join(v, v.hint("merge"), cell, where=other if where is None else other & where)
    lo, hi = g.containing_box(g.compose(F.col("back"), F.col("m_b")), [F.lit(0.0)] * 3, [(F.col(f"n{x}_b") - 1).cast("double") for x in g.AXES])
    box = {f"{x}{i}": c for x, a, b in zip(g.AXES, lo, hi, strict=True) for i, c in ((0, F.greatest(a, F.lit(0))), (1, F.least(b, F.col(f"n{x}") - 1)))}
    out = met.select("tp", "setup", F.concat_ws(",", "tp_b", "setup_b").alias("interval"), *[c.alias(n) for n, c in box.items()])
    return out.filter(F.expr(" and ".join(f"{x}0 <= {x}1" for x in g.AXES)))
