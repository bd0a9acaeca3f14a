"""Selection of views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(views: DataFrame) -> DataFrame:
    """Views that exist."""
    return views.filter("present") if "present" in views.columns else views


def by_attributes(views: DataFrame, **lists: list[int] | None) -> DataFrame:
    """Conjunction of IN lists; None means all."""
    for column, allowed in lists.items():
        if allowed is not None:
            views = views.filter(F.col(column).isin(allowed))
    return views


def by_ids(views: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """Views named by (tp, setup). The list comes from a command line; ids without view are ignored, repeats count once."""
    if not wanted:
        return views.limit(0)
    keys = views.sparkSession.createDataFrame(list(wanted), "tp long, setup long")
    return views.join(F.broadcast(keys), ["tp", "setup"], "left_semi")


def unmatched_ids(views: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """Wanted ids without a view, for a warning."""
    keys = views.sparkSession.createDataFrame(list(wanted), "tp long, setup long").distinct()
    return keys.join(views.select("tp", "setup"), ["tp", "setup"], "left_anti")


def require_some(views: DataFrame) -> DataFrame:
    if views.isEmpty():
        raise ValueError("no views are selected")
    return views


def maximal_box(boxes: DataFrame) -> DataFrame:
    """One row: the union of all boxes."""
    return boxes.agg(*[f(f"{x}{i}").alias(f"{x}{i}") for x in "xyz" for i, f in ((0, F.min), (1, F.max))])


def named_box(boxes: DataFrame, title: str) -> DataFrame:
    """The box of that title; of several the last by position."""
    found = boxes.filter(F.col("title") == title)
    if found.isEmpty():
        raise ValueError(f"no bounding box is titled {title!r}")
    return found.orderBy(F.desc("seq")).limit(1) if "seq" in boxes.columns else found.limit(1)


def index_of(views: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 0-based place of each value among the distinct values: only those are ranked in one task."""
    from pyspark.sql import Window

    values = views.select(column).distinct()
    ranked = values.select(F.col(column), (F.row_number().over(Window.orderBy(column)) - 1).alias(name))
    return views.join(ranked, column)


def volume_indices(views: DataFrame) -> DataFrame:
    """Each view's timepoint and channel index."""
    return index_of(index_of(views, "tp", "t_index"), "channel", "c_index")


def fixed_views(views: DataFrame, by: list[str]) -> DataFrame:
    """The first view of each group (of all views if ``by`` is empty)."""
    first = F.min(F.struct("tp", "setup")).alias("v")
    return (views.groupBy(*by) if by else views).agg(first).select("v.tp", "v.setup")


def renumbered(setups: DataFrame, row_period: int = 4) -> DataFrame:
    """Acquisition order from (setup, row, col): rows in ``row_period`` interleaved passes, columns from right to left.

    Each pass is numbered on its own and starts where the passes before it end.
    """
    from pyspark.sql import Window

    passes = setups.groupBy((F.col("row") % row_period).alias("pass")).agg(F.count("*").alias("n"))
    start = passes.select("pass", F.coalesce(F.sum("n").over(Window.orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("pass").orderBy(F.desc("col"), "row"))
    return setups.withColumn("pass", F.col("row") % row_period).join(F.broadcast(start), "pass").select("setup", (F.col("start") + place - 1).alias("new_setup"))
