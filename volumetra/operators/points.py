"""Interest points, correspondences, transform stacks, links."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.operators import graph, knn, spatial
from volumetra.operators.graph import stored


def brightest(points: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The n brightest points of each group, ties to the smaller id, numbered from 0 in that order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("intensity"), "id"))
    return points.withColumn("new_id", rank - 1).filter(F.col("new_id") < n)


def renumbered(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return points.withColumn("new_id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def brightest_per_interval(points: DataFrame, intervals: DataFrame, max_spots: int, cell: int, zero_keeps_all: bool = True) -> DataFrame:
    """Points of each interval of their view, as many as its share round(max_spots * size / largest size) of brightness.

    ``intervals``: the view (tp, setup, or setup alone), interval, x0..z1. A share of 0 keeps all points (as the first version did) or none.
    """
    size = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) * (F.col("z1") - F.col("z0") + 1)
    sized = intervals.withColumn("size", size)
    # A project's intervals: one row each for pairs of overlapping views; the largest size is a single number.
    largest = sized.agg(F.max("size").alias("m")).first()["m"] or 1
    limited = sized.withColumn("spots", F.round(F.lit(max_spots) * F.col("size") / F.lit(largest)).cast("int")).drop("size")
    view = spatial.view_key(points, intervals)
    inside = spatial.points_in_boxes(points, limited, cell, F.struct(*view) == F.struct(*[f"{c}_b" for c in view]))
    rank = F.row_number().over(Window.partitionBy(*view, "interval_b").orderBy(F.desc("intensity"), "id"))
    few = F.col("rank") <= F.col("spots_b")
    out = inside.withColumn("rank", rank).filter(few | (F.col("spots_b") == 0) if zero_keeps_all else few)
    return out.select(*points.columns, F.col("interval_b").alias("interval"))


def far_from(points: DataFrame, others: DataFrame, distance: int, by: list[str]) -> DataFrame:
    """Points with none of ``others`` (of the same group) within ``distance``: an anti join over grid cells.

    A cell is two distances wide, so that one of ``others`` is met in eight. Both sides are shuffled: what is read from a small
    file would be broadcast with all its cells.
    """
    cell = 2 * max(distance, 0.5)
    b = others.select(*[F.col(c).alias(f"{c}_b") for c in (*by, "x", "y", "z")]).distinct()
    for x in "xyz":
        b = b.withColumn(f"__c{x}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"{x}_b") + s) / cell) for s in (-distance, distance)]))))
    a = points.withColumns({f"__p{x}": F.floor(F.col(x) / cell) for x in "xyz"})
    near = F.lit(True)
    for c in by:
        near = near & (F.col(c) == F.col(f"{c}_b"))
    for x in "xyz":
        near = near & (F.col(f"__p{x}") == F.col(f"__c{x}"))
    d = sum(((F.col(x) - F.col(f"{x}_b")) ** 2 for x in "yz"), (F.col("x") - F.col("x_b")) ** 2)
    return a.join(b.hint("merge"), near & (d <= distance * distance), "left_anti").select(*points.columns)


def dedupe_lists(points: DataFrame, distance: float, by: list[str], order: str, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Points list by list in the order of ``order``: one is taken if none taken from earlier lists is within ``distance``.

    Points of one list are never compared, so those at one place share their fate: places are decided, then points looked up.
    A round for each list: an anti join over grid cells with what was taken before, which is stored; lists are a project's labels,
    a few.
    """
    key = [*by, order, "x", "y", "z"]
    places, taken = store(points.select(*key).distinct()), None
    for r in places.select(order).distinct().orderBy(order).collect():
        own = places.filter(F.col(order).eqNullSafe(F.lit(r[0])))
        new = far_from(own, taken, distance, by) if taken is not None else own
        taken = store(new if taken is None else taken.unionByName(new))
    if taken is None:
        return points
    kept = taken.select(*[F.col(c).alias(f"__{c}") for c in key]).hint("merge")
    return points.join(kept, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]), "left_semi")


def clustered(points: DataFrame, radius: float, by: list[str], out: str = "gid", block: int = 16, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Points with the number ``out`` of their cluster: those linked by steps of at most ``radius`` within a group share one.

    A group's space is cut into blocks of ``block`` radii; a place goes to its block and to those within a radius. A block links
    its places as stars, and the stars that share border places are joined as connected components. Points at one place, however
    many, are one place.
    """
    side, key = block * max(radius, 1e-9), [*by, "x", "y", "z"]
    places = store(points.groupBy(*key).agg(F.count("*").alias("__m")).withColumn("__n", F.monotonically_increasing_id()))
    near = places.select(*by, "__n", *[F.col(x).cast("double").alias(x) for x in "xyz"])
    for x in "xyz":
        near = near.withColumn(f"__b{x}", F.explode(F.array_distinct(F.array(F.floor((F.col(x) - radius) / side), F.floor((F.col(x) + radius) / side)))))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        from volumetra.operators.kernels.models import clusters

        _, label = np.unique(clusters(pdf[["x", "y", "z"]].to_numpy(float), radius), return_inverse=True)
        n = pdf["__n"].to_numpy(np.int64)
        root = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, label, n)
        return pd.DataFrame({"a": n, "b": root[label]})[n != root[label]]

    edges = near.groupBy(*by, "__bx", "__by", "__bz").applyInPandas(link, "a long, b long")
    found = graph.components(places.select(F.col("__n").alias("id")), edges, store).select(F.col("id").alias("__n"), F.col("subset").alias(out))
    named = places.join(found, "__n").select(F.col(out), *[F.col(c).alias(f"__{c}") for c in key])
    return points.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])).select(*points.columns, out)


def merged(points: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """Points of a group of views merged: clusters of points linked by steps of at most ``radius`` become their mean."""
    places = points.groupBy(*by, "x", "y", "z").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    found = clustered(stored(places), radius, by, "__g")
    out = found.groupBy(*by, "__g").agg(F.min("id").alias("id"), *[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in "xyz"], F.sum("n").alias("n"))
    return out.select(*by, "id", "x", "y", "z", "n")


def grouped(points: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """Points with the cluster of their group they fall into: ``gid`` and its mean (mx, my, mz). ``merged`` keeps the clusters
    alone; here the members stay, so that matches of clusters can be handed back to the points of each view."""
    found = clustered(points, radius, by)
    means = found.groupBy("gid").agg(*[F.avg(x).alias(f"m{x}") for x in "xyz"])
    return found.join(means, "gid").select(*points.columns, "gid", "mx", "my", "mz")


def ungrouped(matches: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Matches (setup, id, setup_b, id_b) of groups' clusters as matches of their members' points: columns with _a and _b."""
    m = matches.select(F.col("setup").alias("__v"), F.col("id").alias("__i"), F.col("setup_b").alias("__w"), F.col("id_b").alias("__j"))
    a = members.select(F.col("v").alias("__v"), F.col("gid").alias("__i"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = members.select(F.col("v").alias("__w"), F.col("gid").alias("__j"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return m.join(a, ["__v", "__i"]).join(b, ["__w", "__j"]).select(*[f"{c}_{s}" for s in "ab" for c in columns])


def in_other_views(points: DataFrame, views: DataFrame, cell: int) -> DataFrame:
    """Points that lie in the box of another view than their own."""
    view = spatial.view_key(points, views)
    hits = spatial.points_in_boxes(points, views, cell, F.struct(*view) != F.struct(*[f"{c}_b" for c in view])).select(*view, "id").distinct()
    return points.join(hits, [*view, "id"], "left_semi")


def in_intervals(points: DataFrame, intervals: DataFrame, cell: int) -> DataFrame:
    """Points that lie in one of the intervals of their own view."""
    view = spatial.view_key(points, intervals)
    hits = spatial.points_in_boxes(points, intervals, cell, F.struct(*view) == F.struct(*[f"{c}_b" for c in view])).select(*view, "id").distinct()
    return points.join(hits, [*view, "id"], "left_semi")


def resolved(links: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Correspondences with both points: links (id_a, id_b), points (id and more); columns of b get the suffix _b."""
    left = a.withColumnRenamed("id", "id_a")
    right = spatial.renamed(b.withColumnRenamed("id", "id"), "_b")
    return links.join(left, "id_a").join(right, "id_b")


def per_pair(links: DataFrame, at_least: int, pair: list[str]) -> DataFrame:
    """Pairs of views with enough correspondences, and their number."""
    return links.groupBy(*pair).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def padded(views: DataFrame, points: DataFrame) -> DataFrame:
    """Number of points of every view, 0 for views without."""
    view = spatial.view_key(views, points)
    n = points.groupBy(*view).agg(F.count("*").alias("n"))
    return views.select(*view).join(n, view, "left").select(*view, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keep_first(stack: DataFrame, n: int, view: list[str]) -> DataFrame:
    """The n first-applied transforms of each view; seq 0 is applied last."""
    _not_negative(n)
    return stack.withColumn("__r", F.row_number().over(Window.partitionBy(*view).orderBy(F.desc("seq")))).filter(F.col("__r") <= n).drop("__r")


def remove_last(stack: DataFrame, n: int, view: list[str]) -> DataFrame:
    """Without the n last-applied transforms of each view."""
    _not_negative(n)
    return stack.withColumn("__r", F.row_number().over(Window.partitionBy(*view).orderBy("seq"))).filter(F.col("__r") > n).drop("__r")


def _not_negative(n: int) -> None:
    if n < 0:
        raise ValueError("the number of transforms is negative")


def prepended(stack: DataFrame, new: DataFrame, view: list[str]) -> DataFrame:
    """New last-applied transforms (view, name, affine) in front of each view's list."""
    shifted = stack.join(new.select(*view), view, "left_semi").withColumn("seq", F.col("seq") + 1)
    rest = stack.join(new.select(*view), view, "left_anti")
    return rest.unionByName(shifted).unionByName(new.withColumn("seq", F.lit(0)).select(*stack.columns))


def link_filters(links: DataFrame, min_r: float = 0.3, max_r: float = 1.0, max_shift: tuple = (None, None, None), max_total: float | None = None) -> DataFrame:
    """Links within the range of r, and with shifts within the limits that are set."""
    out = links.filter(F.col("r").between(min_r, max_r))
    for x, limit in zip("xyz", max_shift, strict=True):
        if limit is not None:
            out = out.filter(F.abs(f"d{x}") <= limit)
    if max_total is not None:
        out = out.filter(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) <= max_total)
    return out


def current_links(links: DataFrame, registrations: DataFrame, key: list[str], digest: str = "reg_hash") -> DataFrame:
    """Links computed with the registrations that are current: their stored digest equals the view's."""
    now = registrations.select(*key, F.col(digest).alias("__now"))
    return links.join(now, key).filter(F.col(digest) == F.col("__now")).drop("__now")


def upserted(old: DataFrame, new: DataFrame, pair: tuple[list[str], list[str]]) -> DataFrame:
    """Links with new ones in place of the old ones of their pair, in whichever direction those were stored."""
    a, b = pair
    keys = new.select(*a, *b)
    swapped = keys.select(*[F.col(y).alias(x) for x, y in zip([*a, *b], [*b, *a], strict=True)])
    return old.join(keys.unionByName(swapped).distinct(), [*a, *b], "left_anti").unionByName(new)


def without_fixed(pairs: DataFrame, fixed: DataFrame, same_group: Column) -> DataFrame:
    """Pairs of which not both views are fixed and that are not of one group."""
    view = [c for c in spatial.view_key(pairs, fixed) if f"{c}_b" in pairs.columns]
    f = fixed.select(*view).distinct()
    a = pairs.join(f.withColumn("__fa", F.lit(True)), view, "left")
    b = a.join(spatial.renamed(f).withColumn("__fb", F.lit(True)), [f"{c}_b" for c in view], "left")
    both = F.col("__fa").isNotNull() & F.col("__fb").isNotNull()
    return b.filter(~both & ~same_group).select(*pairs.columns)


def best_two(a: DataFrame, b: DataFrame, vector: str, block: int = 4096) -> DataFrame:
    """(id_a, id_b, d1, d2): each descriptor of ``a`` with the nearest of ``b`` and the squared distances of the two nearest."""
    return knn.nearest_two(a, b, vector, block=block)


def ratio_test(two: DataFrame, significance: float) -> DataFrame:
    """Matches whose nearest is ``significance`` times nearer (squared) than the second, or without a second."""
    return two.filter(F.col("d2").isNull() | (F.col("d1") * significance < F.col("d2")))


def cell_matches(voxels: DataFrame, cell: tuple[int, int, int], low: float | None = None, high: float | None = None) -> DataFrame:
    """Intensities of two views at the same voxel, with the coefficient cell: (setup, setup_b, cx, cy, cz, v, v_b), and the
    timepoints if there are any."""
    if low is not None:
        voxels = voxels.filter(F.col("v") >= low)
    if high is not None:
        voxels = voxels.filter(F.col("v") <= high)
    view = spatial.view_key(voxels)
    b = voxels.select("x", "y", "z", *[F.col(c).alias(f"{c}_b") for c in (*view, "v")])
    pairs = voxels.join(b, ["x", "y", "z"]).filter(F.struct(*view) < F.struct(*[f"{c}_b" for c in view]))
    return pairs.withColumns({f"c{x}": F.floor(F.col(x) / F.lit(s)).cast("long") for x, s in zip("xyz", cell, strict=True)})


def linear_fit(matches: DataFrame, at_least: int) -> DataFrame:
    """v_b = scale * v + offset per pair and cell with enough candidates."""
    by = ["setup", "setup_b", "cx", "cy", "cz"]
    fit = matches.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("v_b", "v").alias("scale"), F.regr_intercept("v_b", "v").alias("offset"))
    return fit.filter(F.col("n") >= at_least)

