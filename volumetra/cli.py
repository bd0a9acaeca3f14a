"""The commands: ``python -m volumetra.cli COMMAND ...``. Each reads a project, runs jobs, and saves the project anew.

Options follow one vocabulary: ``-x`` project, ``-o`` output, view selections, ``--dryRun`` (nothing is saved).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.functions import options
from volumetra.operators import blocks, consensus, points, pyramid, registration, rendered, select, spatial
from volumetra.sources import chunks as ch
from volumetra.sources import container, points_csv
from volumetra.sources import project as projects

SELECTION = (("angleId", "angle"), ("tileId", "tile"), ("illuminationId", "illum"), ("channelId", "channel"), ("timepointId", "tp"))
XYZ = ("x", "y", "z")
FACES = [f"{x}{i}" for x in "xyz" for i in (0, 1)]


def session() -> SparkSession:
    return SparkSession.builder.appName("volumetra").getOrCreate()


def selected(views: DataFrame, a: argparse.Namespace) -> DataFrame:
    lists = {c: options.ids(getattr(a, o)) for o, c in SELECTION}
    explicit = options.view_ids(a.vi)
    options.one_selection(explicit, **lists)
    views = select.present(views)
    return select.require_some(select.by_ids(views, explicit) if explicit else select.by_attributes(views, **lists))


def overlap_pairs(views: DataFrame, cell: int = 512, all_pairs: bool = False) -> DataFrame:
    v = views.select("tp", "setup", "channel", "angle", "illum", "tile", "m", "nx", "ny", "nz", *FACES)
    if all_pairs:
        return v.join(spatial.renamed(v), F.struct("tp", "setup") < F.struct("tp_b", "setup_b"))
    return spatial.overlapping_pairs(v, cell)


def registration_pairs(pairs: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Pairs by timepoint: individual, all to all, within a range, or with a reference."""
    kind = a.registrationTP
    if kind == "TIMEPOINTS_INDIVIDUALLY":
        return pairs.filter("tp = tp_b")
    if kind == "ALL_TO_ALL_WITH_RANGE":
        return pairs.filter(F.abs(F.col("tp") - F.col("tp_b")) <= a.rangeTP)
    if kind == "REFERENCE_TIMEPOINT":
        if a.referenceTP is None:
            raise ValueError("a reference timepoint is needed")
        return pairs.filter((F.col("tp") == a.referenceTP) | (F.col("tp_b") == a.referenceTP))
    return pairs


def resave(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    block = options.vector(a.blockSize)
    chunks = ch.rechunked(images_of(spark, p, a), block)
    sizes = p["views"].agg(*[F.max(f"n{x}").alias(x) for x in XYZ]).first()
    levels = options.pyramid(a.downsampling) or options.propose_pyramid(tuple(sizes))
    if a.dryRun:
        return
    ch.write_pyramid(chunks, a.n5Path or a.output, levels, block, a.compression, a.compressionLevel, present(p))
    facts = [("images", json.dumps(a.n5Path or a.output)), ("levels", json.dumps([list(f) for f in levels]))]
    p["properties"] = p["properties"].filter("key not in ('images', 'levels')").union(spark.createDataFrame(facts, projects.SCHEMAS["properties"]))
    p.save(a.xmlout or a.xml)


def images_of(spark: SparkSession, p: projects.Project, a: argparse.Namespace, level: int | None = 0) -> DataFrame:
    """The chunks of a level of the images, of all levels for None."""
    facts = properties(p)
    if not a.images and "images" not in facts:
        raise ValueError("the project names no images; give --images")
    path = a.images or facts["images"]
    return ch.read_images(spark, path, list(present(p)) if ch.is_container(path) else [], level, len(levels_of(spark, p, a)))


def present(p: projects.Project) -> dict[tuple[int, int], tuple[int, int, int]]:
    """The sizes of present views; metadata."""
    return {(r["tp"], r["setup"]): (r["nx"], r["ny"], r["nz"]) for r in p["views"].filter("present").select("tp", "setup", "nx", "ny", "nz").collect()}


def properties(p: projects.Project) -> dict:
    return {r["key"]: json.loads(r["value"]) for r in p["properties"].collect()}


def levels_of(spark: SparkSession, p: projects.Project, a: argparse.Namespace) -> list[tuple[int, int, int]]:
    """Factors of the stored levels; full resolution alone where images are given without the project's word for them."""
    facts = properties(p)
    known = not a.images or a.images == facts.get("images")
    return [tuple(f) for f in facts.get("levels", [[1, 1, 1]])] if known else [(1, 1, 1)]


def level_table(spark: SparkSession, factors: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, f), pyramid.mipmap(f)) for i, f in enumerate(factors)], "level int, fx double, fy double, fz double, mipmap array<double>")


def stored_images(spark: SparkSession, p: projects.Project, a: argparse.Namespace, wanted: tuple[int, int, int]) -> tuple[DataFrame, tuple[int, int, int]]:
    """The chunks of the coarsest stored level that is not coarser than ``wanted``, and its factors."""
    known = levels_of(spark, p, a)
    level = pyramid.level_for_detection(level_table(spark, known).withColumn("setup", F.lit(0)), wanted).first()["level"] or 0
    return images_of(spark, p, a, level).withColumn("level", F.lit(0)), known[level]


def halved_to(chunks: DataFrame, factors: tuple[int, int, int], wanted: tuple[int, int, int]) -> tuple[DataFrame, tuple[int, int, int]]:
    """The images halved from ``factors`` while that stays within ``wanted``, and the factors they have then."""
    factors = tuple(int(f) for f in factors)
    while any(2 * f <= w for f, w in zip(factors, wanted, strict=True)):
        half = tuple(2 if 2 * f <= w else 1 for f, w in zip(factors, wanted, strict=True))
        chunks, factors = ch.downsampled(chunks, half), tuple(f * h for f, h in zip(factors, half, strict=True))
    return chunks, factors


def detect_interestpoints(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    views = selected(p["views"], a)
    factors = (a.downsampleXY, a.downsampleXY, a.downsampleZ)
    stored = level_table(spark, levels_of(spark, p, a))
    level = pyramid.level_for_detection(stored.withColumn("setup", F.lit(0)), factors).first()["level"] or 0
    chunks = images_of(spark, p, a, level).join(F.broadcast(views.select("tp", "setup")), ["tp", "setup"], "left_semi").withColumn("level", F.lit(0))
    step = tuple(stored.filter(F.col("level") == level).select(*pyramid.residual_factors(factors)).first())
    while max(step) > 1:
        half = tuple(2 if f > 1 else 1 for f in step)
        chunks, step = ch.downsampled(chunks, half), tuple(f // h for f, h in zip(step, half, strict=True))
    found = registration.detect_points(chunks, a.sigma, a.threshold, a.minIntensity, a.maxIntensity, a.type, a.localization, a.medianFilter, factors)
    found = found.withColumn("id", F.xxhash64("x", "y", "z"))
    if a.overlappingOnly:
        boxes = projects.view_boxes(p).join(views.select("tp", "setup"), ["tp", "setup"], "left_semi")
        # Points and intervals are in each view's own image.
        inside = spatial.local_overlaps(boxes, 512, F.expr("tp = tp_b and channel = channel_b") if a.onlyCompareOverlapTiles else None)
        if a.maxSpots and a.maxSpots > 0 and a.maxSpotsPerOverlap:
            found = points.brightest_per_interval(found, inside, a.maxSpots, 512).drop("interval").dropDuplicates(["tp", "setup", "id"])
        else:
            found = points.in_intervals(found, inside, 512)
    if a.maxSpots and a.maxSpots > 0 and not a.maxSpotsPerOverlap:
        found = points.brightest(found, a.maxSpots, ["tp", "setup"]).drop("new_id")
    found = points.renumbered(found, ["tp", "setup"], ["x", "y", "z"]).withColumn("id", F.col("new_id").cast("long")).withColumn("label", F.lit(a.label))
    if not a.storeIntensities:
        found = found.withColumn("intensity", F.lit(None).cast("double"))
    old = p["points"].filter(F.col("label") != a.label).unionByName(p["points"].filter(F.col("label") == a.label).join(views.select("tp", "setup"), ["tp", "setup"], "left_anti"))
    p["points"] = old.unionByName(found.select(*p["points"].columns))
    p.save(a.xml, a.dryRun)


def world_points(p: projects.Project, views: DataFrame, labels: list[str]) -> DataFrame:
    """Points of the views and labels, in world coordinates."""
    pts = p["points"].filter(F.col("label").isin(labels)).join(F.broadcast(projects.models(p)), ["tp", "setup"]).join(views.select("tp", "setup"), ["tp", "setup"], "left_semi")
    found = {r["label"] for r in pts.select("label").distinct().collect()}
    if set(labels) - found:
        raise ValueError(f"no points are labelled {', '.join(sorted(set(labels) - found))}")
    to = g.apply(F.col("m"), (F.col("x"), F.col("y"), F.col("z")))
    return pts.select("tp", "setup", "label", "id", *[c.alias(x) for x, c in zip(XYZ, to, strict=True)])


def match_interestpoints(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.method == "ICP" and a.searchRadius is not None:
        raise ValueError("descriptor options do not go with ICP")
    p = projects.load(spark, a.xml)
    views = selected(p["views"], a)
    boxes = projects.view_boxes(p).join(views.select("tp", "setup"), ["tp", "setup"], "left_semi")
    pts = world_points(p, views, a.label)
    if a.interestpointsForReg == "OVERLAPPING_ONLY":
        pts = points.in_other_views(pts, boxes.select("tp", "setup", *FACES), 512)
    pairs = registration_pairs(overlap_pairs(boxes, all_pairs=a.viewReg == "ALL_AGAINST_ALL"), a)
    # Groups of views and a label are named by one number; without grouping every view is a group.
    attributes = [c for c, off in (("angle", a.splitTimepoints), ("channel", a.groupChannels or a.splitTimepoints), ("illum", a.groupIllums or a.splitTimepoints), ("tile", a.groupTiles or a.splitTimepoints)) if not off]
    grouping = len(attributes) < 4
    name = ["tp", *attributes] if grouping else ["tp", "setup"]
    of_view = boxes.select("tp", "setup", F.xxhash64(*name).alias("g"))
    pts = pts.join(F.broadcast(of_view), ["tp", "setup"]).withColumn("v", F.xxhash64("g", "label"))
    if grouping:
        members = points.grouped(pts, a.interestPointMergeDistance, ["v"])
    else:
        members = pts.select("*", F.col("id").alias("gid"), *[F.col(x).alias(f"m{x}") for x in XYZ])
    code = members.select("g", "label", "v").distinct()
    left, right = code.select(*[F.col(c).alias(f"{c}_1") for c in code.columns]), code.select(*[F.col(c).alias(f"{c}_2") for c in code.columns])
    ends = pairs.select("tp", "setup", "tp_b", "setup_b").join(of_view.withColumnRenamed("g", "g_1"), ["tp", "setup"])
    ends = ends.join(of_view.select(F.col("tp").alias("tp_b"), F.col("setup").alias("setup_b"), F.col("g").alias("g_2")), ["tp_b", "setup_b"])
    tasks = ends.filter("g_1 <> g_2").select(F.least("g_1", "g_2").alias("g_1"), F.greatest("g_1", "g_2").alias("g_2")).distinct().join(left, "g_1").join(right, "g_2")
    if not a.matchAcrossLabels:
        tasks = tasks.filter("label_1 = label_2")
    ransac = {"iterations": a.ransacIterations or (200 if a.method == "ICP" else 10_000), "max_error": a.ransacMaxError or (2.5 if a.method == "ICP" else 5.0), "min_ratio": a.ransacMinInlierRatio, "min_inliers": a.ransacMinNumInliers}
    common = {"model": a.transformationModel, "regularizer": a.regularizationModel, "blend": getattr(a, "lambda")}
    if a.method == "ICP":
        kw = common | {"max_error": a.icpMaxError, "iterations": a.icpIterations, "use_ransac": a.icpUseRANSAC}
    else:
        kw = common | ransac | {"significance": a.significance, "redundancy": a.redundancy, "neighbours": a.numNeighbors, "search_radius": a.searchRadius, "multi": a.ransacMultiConsensus}
    coded = members.select(F.col("v").alias("setup"), F.col("gid").alias("id"), *[F.col(f"m{x}").alias(x) for x in XYZ]).distinct()
    found = registration.match_points(tasks.select(F.col("v_1").alias("setup"), F.col("v_2").alias("setup_b")), coded, a.method, **kw)
    names = ["tp", "setup", "label", "id"]
    one = points.ungrouped(found, members, names)
    both = one.unionByName(one.select(*[F.col(f"{c}_{t}").alias(f"{c}_{s}") for s, t in (("a", "b"), ("b", "a")) for c in names]))
    p["correspondences"] = both if a.clearCorrespondences else p["correspondences"].unionByName(both).distinct()
    p.save(a.xml, a.dryRun)


def stitching(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    views = selected(p["views"], a)
    boxes = projects.view_boxes(p).join(views.select("tp", "setup"), ["tp", "setup"], "left_semi")
    # Channels and illuminations of one place are one group, stitched by their combined images, under its first view's name.
    place = ["tp", "angle", "tile"]
    members = boxes.join(boxes.groupBy(*place).agg(F.min("setup").alias("leader")), place)
    leaders = members.filter("setup = leader").drop("leader")
    pairs = overlap_pairs(leaders).filter("tp = tp_b and angle = angle_b and tile <> tile_b")
    wanted = options.vector(a.downsampling)
    chunks, stored = stored_images(spark, p, a, wanted)
    if not members.filter("setup <> leader").isEmpty():
        chunks = chunks.join(F.broadcast(members.select("tp", "setup")), ["tp", "setup"], "left_semi")
        by_channel = members.groupBy(*place, "channel").agg(F.min("setup").alias("first"))
        illums = members.drop("leader").join(by_channel, [*place, "channel"]).select("tp", "setup", F.col("first").alias("leader"))
        chunks = registration.combined_views(chunks, F.broadcast(illums), a.illumCombine)
        channels = by_channel.join(members.filter("setup = leader").select(*place, "leader"), place).select("tp", F.col("first").alias("setup"), "leader")
        chunks = registration.combined_views(chunks, F.broadcast(channels), a.channelCombine)
    chunks, factors = halved_to(chunks, stored, wanted)
    low = {f"{n}{x}{s}": F.floor(c / f).cast("long") for x, f, i in zip(XYZ, factors, range(3), strict=True) for n, s, c in (("t", "", F.col("m")[4 * i + 3]), ("t", "_b", F.col("m_b")[4 * i + 3]))}
    box = {f"i{x}{i}": F.floor(c / f).cast("long") for x, f in zip(XYZ, factors, strict=True) for i, c in ((0, F.greatest(f"{x}0", f"{x}0_b")), (1, F.least(f"{x}1", f"{x}1_b")))}
    both = ["tp", "setup", "tp_b", "setup_b"]
    # Views that are only moved are compared as they are; all others are rendered into one frame of their pair.
    only_moved = F.lit(True)
    for m in ("m", "m_b"):
        for i in (i for i in range(12) if i % 4 < 3):
            only_moved = only_moved & (F.abs(F.col(m)[i] - g.IDENTITY[i]) < 1e-6)
    moved = pairs.filter(only_moved).select(*both, "m", "m_b", *[c.alias(n) for n, c in {**low, **box}.items()])
    found = registration.stitch_pairs(moved.drop("m", "m_b"), chunks, a.peaksToCheck, not a.disableSubpixelResolution).join(moved, both)
    # Places are whole steps there: what they leave of the maps' translations is put back.
    rest = [F.col(f"t{x}_b") * f - F.col("m_b")[4 * i + 3] - F.col(f"t{x}") * f + F.col("m")[4 * i + 3] for i, (x, f) in enumerate(zip(XYZ, factors, strict=True))]
    shifts = found.select(*both, *[(F.col(f"d{x}") * f + c).alias(f"d{x}") for x, f, c in zip(XYZ, factors, rest, strict=True)], "r")
    turned = pairs.filter(~only_moved)
    if not turned.isEmpty():
        frames = turned.select(*both, "m", "m_b", *[f"n{x}{s}" for x in XYZ for s in ("", "_b")], *g.intersection())
        shifts = shifts.unionByName(registration.stitch_rendered(frames, chunks, factors, a.peaksToCheck, not a.disableSubpixelResolution))
    shifts = points.link_filters(shifts, a.minR, a.maxR, (a.maxShiftX, a.maxShiftY, a.maxShiftZ), a.maxShiftTotal)
    # A group's link is one between its members of one channel and illumination.
    one = members.select("tp", "leader", "channel", "illum", F.col("setup").alias("own"), "m")
    new = shifts.join(one.withColumnRenamed("leader", "setup"), ["tp", "setup"])
    new = new.join(spatial.renamed(one.withColumnRenamed("leader", "setup")), ["tp_b", "setup_b"]).filter("channel = channel_b and illum = illum_b")
    new = new.withColumns({"setup": F.col("own"), "setup_b": F.col("own_b"), "reg_hash": g.registration_hash(F.col("m"), F.col("m_b"))}).select(*p["links"].columns)
    p["links"] = points.upserted(p["links"], new, (["tp", "setup"], ["tp_b", "setup_b"]))
    p.save(a.xml, a.dryRun)


def solver(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    views = selected(p["views"], a)
    models_ = projects.models(p).join(views.select("tp", "setup"), ["tp", "setup"], "left_semi")
    tiles = [(r["tp"], r["setup"]) for r in views.select("tp", "setup").orderBy("tp", "setup").collect()]
    if a.sourcePoints == "STITCHING":
        m2 = spatial.renamed(models_)
        rows = p["links"].join(models_, ["tp", "setup"]).join(m2, ["tp_b", "setup_b"])
        rows = rows.filter(F.col("reg_hash") == g.registration_hash(F.col("m"), F.col("m_b")))
        corner = [F.array(*[F.lit(float(v)) for v in c]) for c in ((0, 0, 0), (100, 0, 0), (0, 100, 0), (0, 0, 100))]
        moved = [F.array(*[c[i] - F.col(f"d{x}") for i, x in enumerate(XYZ)]) for c in corner]
        links = rows.select(F.array("tp", "setup").alias("a"), F.array("tp_b", "setup_b").alias("b"), F.array(*corner).alias("p"), F.array(*moved).alias("q"), F.lit(1.0).alias("weight"))
    else:
        labels = a.label
        weights = dict(zip(labels, options.vector(a.labelweights, len(labels), float) if a.labelweights else [1.0] * len(labels), strict=True))
        pts = world_points(p, views, labels)
        one = pts.select(*[F.col(c).alias(f"{c}_a") for c in ("tp", "setup", "label", "id")], *XYZ)
        two = pts.select(*[F.col(c).alias(f"{c}_b") for c in ("tp", "setup", "label", "id")], *[F.col(x).alias(f"{x}_b") for x in XYZ])
        c = p["correspondences"].filter(F.struct("tp_a", "setup_a") < F.struct("tp_b", "setup_b"))
        rows = c.join(one, ["tp_a", "setup_a", "label_a", "id_a"]).join(two, ["tp_b", "setup_b", "label_b", "id_b"])
        weight = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("label_a"))
        named = rows.select(F.array("tp_a", "setup_a").alias("a"), F.array("tp_b", "setup_b").alias("b"), weight.alias("weight"), *consensus.PLACES)
        links = consensus.link_moments(named, ["a", "b", "weight"])
    links = links.withColumns({c: F.concat_ws(",", c) for c in ("a", "b")})
    name = lambda t: f"{t[0]},{t[1]}"
    # Views of a group move as one tile, named by the group's first view; links within a group say nothing.
    attributes = [c for c, off in (("angle", a.splitTimepoints), ("channel", a.groupChannels or a.splitTimepoints), ("illum", a.groupIllums or a.splitTimepoints), ("tile", a.groupTiles or a.splitTimepoints)) if not off]
    leader = {name(t): name(t) for t in tiles}
    if len(attributes) < 4:
        first: dict = {}
        for r in views.orderBy("tp", "setup").collect():
            leader[name((r["tp"], r["setup"]))] = first.setdefault((r["tp"], *[r[c] for c in attributes]), name((r["tp"], r["setup"])))
        named = spark.createDataFrame(list(leader.items()), "view string, tile string")
        for side in ("a", "b"):
            links = links.join(F.broadcast(named), F.col(side) == F.col("view")).withColumn(side, F.col("tile")).drop("view", "tile")
        links = links.filter("a <> b")
    if a.disableFixedViews:
        fixed = set()
    elif a.fixedViews:
        fixed = {name(t) for t in options.view_ids(a.fixedViews)}
    else:
        by = ["tp"] if a.registrationTP == "TIMEPOINTS_INDIVIDUALLY" else []
        fixed = {name((r["tp"], r["setup"])) for r in select.fixed_views(views.filter(F.col("tp") == a.referenceTP) if a.registrationTP == "REFERENCE_TIMEPOINT" else views, by).collect()}
    fixed = {leader[t] for t in fixed if t in leader}
    weak = []
    if a.method.startswith("TWO_ROUND"):
        from volumetra.operators.kernels.solving import Link

        import numpy as np

        for r in overlap_pairs(projects.view_boxes(p)).select("tp", "setup", "tp_b", "setup_b").collect():
            corner = np.array([[0.0, 0, 0], [100, 0, 0], [0, 100, 0], [0, 0, 100]])
            one, two = leader.get(name((r["tp"], r["setup"]))), leader.get(name((r["tp_b"], r["setup_b"])))
            if one and two and one != two:
                weak.append(Link(one, two, corner, corner))
    found, error = registration.solve_links(links, sorted(set(leader.values())), fixed, a.method, weak, a.relativeThreshold, a.absoluteThreshold, model=a.transformationModel, regularizer=a.regularizationModel, blend=getattr(a, "lambda"), max_error=a.maxError, iterations=a.maxIterations, plateau=a.maxPlateauwidth)
    print(f"error {error:.4f}")
    rows = [(*t, f"{a.transformationModel} solved", [float(x) for x in found[leader[name(t)]].ravel()]) for t in tiles]
    new = spark.createDataFrame(rows, "tp int, setup long, name string, affine array<double>")
    p["transforms"] = points.prepended(p["transforms"], new, ["tp", "setup"])
    p.save(a.xml, a.dryRun)


def at_best_levels(spark: SparkSession, p: projects.Project, a: argparse.Namespace, views: DataFrame, finer: int = 1) -> tuple[DataFrame, DataFrame]:
    """(views, chunks), each view at the coarsest stored level that the steps of its map m allow: m and its size n{x} are those
    of the level, whose factors are f{x}; the size at full resolution is full_n{x}. Levels are ``finer`` times as fine as m asks."""
    stored = levels_of(spark, p, a)
    chunks = images_of(spark, p, a, None if len(stored) > 1 else 0)
    views = views.withColumns({f"full_n{x}": F.col(f"n{x}") for x in XYZ})
    if len(stored) == 1:
        return views.withColumns({f"f{x}": F.lit(1.0) for x in XYZ}), chunks
    each = views.select("tp", "setup", "m", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[F.lit(float(v)).alias(f"f{x}") for x, v in zip(XYZ, f, strict=True)], g.affine(pyramid.mipmap(f)).alias("mipmap")) for i, f in enumerate(stored)])).alias("l")).select("tp", "setup", "m", "l.*")
    each = each.withColumns({f"s{x}": s * finer for x, s in zip(XYZ, g.step_sizes(F.col("m")), strict=True)})
    best = pyramid.level_for_fusion(each, (F.col("sx"), F.col("sy"), F.col("sz")), by=("tp", "setup"))
    chosen = each.join(best, ["tp", "setup", "level"]).select("tp", "setup", "level", "mipmap", "fx", "fy", "fz")
    views = views.join(chosen, ["tp", "setup"])
    views = views.withColumns({"m": g.compose(F.col("m"), F.col("mipmap")), **{f"n{x}": F.floor(F.col(f"n{x}") / F.col(f"f{x}")).cast("long") for x in XYZ}})
    return views, chunks.join(F.broadcast(chosen.select("tp", "setup", "level")), ["tp", "setup", "level"], "left_semi")


def match_intensities(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    views = projects.view_boxes(p).join(selected(p["views"], a).select("tp", "setup"), ["tp", "setup"], "left_semi")
    pairs = overlap_pairs(views)
    # The grid has renderScale cells a world unit, which end between voxels, so that a small shift moves few of them to another
    # cell. A level's voxels have to be at most half a cell, as each goes to the cell it lies in.
    grid = views.withColumn("m", F.transform("m", lambda c, i: (c + F.when(i % 4 == 3, 0.5).otherwise(0.0)) * a.renderScale))
    grid, chunks = at_best_levels(spark, p, a, grid, 2)
    grid = grid.select("tp", "setup", "m", "fx", "fy", "fz", *[F.col(f"full_n{x}").alias(f"n{x}") for x in XYZ])
    cells = options.vector(a.numCoefficients)
    values = rendered.cell_values(pairs, grid, chunks, cells, a.renderScale, a.minThreshold, a.maxThreshold)
    fit = rendered.match_cells(values, cells, a.method, a.minNumCandidates, **({} if a.method == "HISTOGRAM" else {"iterations": a.numIterations, "max_error": a.maxEpsilon, "min_ratio": a.minInlierRatio, "min_inliers": a.minNumInliers, "trust": a.maxTrust}))
    p["intensity_matches"] = fit.select(*p["intensity_matches"].columns)
    p.save(a.outputPath or a.xml, a.dryRun)


def solve_intensities(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.matchesPath or a.xml)
    p["coefficients"] = registration.solve_intensities(p["intensity_matches"], 0.1, a.maxIterations)
    p.save(a.output or a.xml, a.dryRun)


def create_fusion_container(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dryRun:
        raise ValueError("a container is created at once; there is no dry run")
    p = projects.load(spark, a.xml)
    box = None
    if a.boundingBox:
        box = select.named_box(p["boxes"], a.boundingBox).select(*FACES).first().asDict()
    props = container.properties_of(p, a.xml, dtype=a.dataType, block=options.vector(a.blockSize), box=box, channels=a.numChannels, timepoints=a.numTimepoints, low=a.minIntensity, high=a.maxIntensity, anisotropy=a.preserveAnisotropy, factor=a.anisotropyFactor, multires=a.multiRes, pyramid=a.downsampling, codec=a.compression, level=a.compressionLevel, xml_out=a.xmlout)
    container.create(spark, a.output, props | {"multiscales": container.multiscales(props)})
    if a.xmlout:
        container.output_project(spark, a.output, props).save(a.xmlout)


def affine_fusion(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dryRun:
        raise ValueError("fusion has no dry run")
    props = container.read(spark, a.output)
    p = projects.load(spark, a.xml or props["source"])
    lists = {c: options.ids(getattr(a, o)) for o, c in SELECTION}
    options.fusion_indices(a.timepointIndex, a.channelIndex, any(lists.values()) or bool(a.vi))
    views = container.volume_views(p, a.timepointIndex, a.channelIndex).join(selected(p["views"], a).select("tp", "setup"), ["tp", "setup"], "left_semi")
    views = container.anisotropic(views, props.get("anisotropy_factor"))
    volumes = volumes_of(views)
    work = in_volumes(container.blocks(spark, props, options.vector(a.blockScale)), volumes)
    # Each view is read at the coarsest level that the output's resolution allows.
    views, chunks = at_best_levels(spark, p, a, views)
    low, high = props.get("min_intensity", 0), props.get("max_intensity", 1)
    coefficients = p["coefficients"] if not p["coefficients"].isEmpty() else None
    fused = registration.fuse_views(work, views, chunks, a.fusion, props["data_type"], low, high, coefficients, masks=a.masks, mask_offset=options.vector(a.maskOffset, 3, float))
    _save_volumes(fused, props, a.output, volumes)


def volumes_of(views: DataFrame) -> list[tuple[int, int]]:
    """The volumes (t_index, c_index) that have views; metadata."""
    return sorted((r["t_index"], r["c_index"]) for r in views.select("t_index", "c_index").distinct().collect())


def in_volumes(work: DataFrame, volumes: list[tuple[int, int]]) -> DataFrame:
    """Blocks once for each volume."""
    each = F.array(*[F.struct(F.lit(t).alias("t_index"), F.lit(c).alias("c_index")) for t, c in volumes]) if volumes else F.lit(None).cast("array<struct<t_index:int,c_index:int>>")
    return work.withColumn("v", F.explode(each)).select(*work.columns, "v.*")


def _save_volumes(fused: DataFrame, props: dict, path: str, volumes: list[tuple[int, int]]) -> None:
    """Full resolution first, then each level from the stored one before: a chunk table, N5, or one five-dimensional image."""
    block, codec, level, spark = tuple(props["block_size"]), props.get("compression", "zstandard"), props.get("compression_level"), fused.sparkSession
    origin, factors = props["box_min"], [tuple(x["factors"]) for x in props["levels"]]
    fused = fused.withColumns({f"o{x}": F.col(f"o{x}") - o for x, o in zip(XYZ, origin, strict=True)})
    named = fused.withColumnsRenamed({"t_index": "tp", "c_index": "setup"}).select(*[F.col(c).cast(k) for c, k in (x.split() for x in ch.SCHEMA.split(", "))])
    out, chunks = container.volumes(path), ch.rechunked(named, block)
    if ch.is_container(path):
        n5 = options.storage_format(path) == "N5"
        counts = props.get("num_timepoints", 1), props.get("num_channels", 1)
        ch.write_container(chunks, out, factors, block, codec, level, volumes, "n5" if n5 else "ngff", None if n5 else counts, dict.fromkeys(volumes, tuple(b - a + 1 for a, b in zip(origin, props["box_max"], strict=True))))
        return
    ch.write(chunks, out, codec, "append", level, ("level",))
    for i, step in enumerate(options.relative_factors(factors)[1:]):
        ch.write(ch.downsampled(ch.read(spark, out, i), step, block), out, codec, "append", level, ("level",))


def nonrigid_fusion(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dryRun:
        raise ValueError("fusion has no dry run")
    p = projects.load(spark, a.xml)
    views = projects.view_boxes(p).join(selected(p["views"], a).select("tp", "setup"), ["tp", "setup"], "left_semi")
    box = select.named_box(p["boxes"], a.boundingBox) if a.boundingBox else select.maximal_box(views)
    box = box.select(*FACES).first().asDict()
    props = {"box_min": [box[f"{x}0"] for x in XYZ], "box_max": [box[f"{x}1"] for x in XYZ], "block_size": list(options.vector(a.blockSize)), "levels": [{"factors": [1, 1, 1]}]}
    pts = world_points(p, views, a.interestPoints)
    one = pts.select(*[F.col(c).alias(f"{c}_a") for c in ("tp", "setup", "label", "id")], *XYZ)
    two = pts.select(*[F.col(c).alias(f"{c}_b") for c in ("tp", "setup", "label", "id")], *[F.col(x).alias(f"{x}_b") for x in XYZ])
    # A point ought to lie in the middle of itself and its correspondences.
    pairs = p["correspondences"].join(one, ["tp_a", "setup_a", "label_a", "id_a"]).join(two, ["tp_b", "setup_b", "label_b", "id_b"])
    common = pairs.groupBy(F.col("tp_a").alias("tp"), F.col("setup_a").alias("setup"), "label_a", "id_a", *XYZ).agg(*[((F.first(x) + F.sum(f"{x}_b")) / (F.count("*") + 1)).alias(f"c{x}") for x in XYZ])
    # All channels of a timepoint are one volume.
    views = views.withColumns({"t_index": F.dense_rank().over(Window.orderBy("tp")) - 1, "c_index": F.lit(0)})
    volumes = volumes_of(views)
    work = in_volumes(container.blocks(spark, props, options.vector(a.blockScale)), volumes)
    fused = registration.fuse_nonrigid(work, views, images_of(spark, p, a), common.select("tp", "setup", *XYZ, "cx", "cy", "cz"), dtype=a.dataType, low=a.minIntensity or 0.0, high=a.maxIntensity or 1.0)
    _save_volumes(fused, props, a.output, volumes)


def split_images(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    v = p["views"].filter("present").withColumns({f"{x}{i}": F.lit(0).cast("long") if i == 0 else F.col(f"n{x}") - 1 for x in XYZ for i in (0, 1)})
    t = blocks.split_tiles(v, options.vector(a.targetImageSize), options.vector(a.targetOverlap))
    t = t.withColumn("new", F.row_number().over(Window.partitionBy("tp").orderBy("setup", "tx0", "ty0", "tz0")) - 1)
    cut = t.select("tp", F.col("new").cast("long").alias("setup"), "angle", "channel", F.col("tile").alias("illum") if a.assignIlluminations else F.col("illum"), F.col("new").cast("long").alias("tile"), "present", *[(F.col(f"t{x}1") - F.col(f"t{x}0") + 1).alias(f"n{x}") for x in XYZ], "vx", "vy", "vz")
    one, zero = F.lit(1.0), F.lit(0.0)
    move = F.array(one, zero, zero, F.col("tx0").cast("double"), zero, one, zero, F.col("ty0").cast("double"), zero, zero, one, F.col("tz0").cast("double"))
    first = t.join(p["transforms"].groupBy("tp", "setup").agg(F.max("seq").alias("last")), ["tp", "setup"], "left").select("tp", F.col("new").cast("long").alias("setup"), (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("seq"), F.lit("tile offset").alias("name"), move.alias("affine"))
    old = t.select("tp", "setup", F.col("new").cast("long").alias("to")).join(p["transforms"], ["tp", "setup"]).select("tp", F.col("to").alias("setup"), "seq", "name", "affine")
    out = projects.Project(spark)
    out["views"], out["transforms"] = cut, old.unionByName(first)
    if a.fakeInterestPoints:
        boxes = t.select("tp", F.col("new").cast("long").alias("setup"), *[F.col(f"t{x}{i}").alias(f"{x}{i}") for x in XYZ for i in (0, 1)], F.col("setup").alias("image"))
        pairs = spatial.overlapping_pairs(boxes, 512, ["tp", "image"]).select("tp", "setup", "setup_b", *[F.col(f"{x}0").alias(f"o{x}") for x in XYZ], *[F.col(f"{x}0_b").alias(f"o{x}_b") for x in XYZ], *g.intersection())
        made = blocks.synthetic_points(pairs, a.fipDensity, a.fipMinNumPoints, a.fipMaxNumPoints, a.fipError, a.fipExclusionRadius)
        made = made.withColumn("id", F.xxhash64("setup", "setup_b", "k"))
        rows = [made.select("tp", F.col(s).alias("setup"), F.lit("split").alias("label"), "id", *[(F.col(f"{x}_{w}") - F.col(f"o{x}{q}")).alias(x) for x in XYZ], F.lit(None).cast("double").alias("intensity")) for s, w, q in (("setup", "a", ""), ("setup_b", "b", "_b"))]
        out["points"] = rows[0].unionByName(rows[1])
        ends = lambda s, t: made.select(F.col("tp").alias("tp_a"), F.col(s).alias("setup_a"), F.lit("split").alias("label_a"), F.col("id").alias("id_a"), F.col("tp").alias("tp_b"), F.col(t).alias("setup_b"), F.lit("split").alias("label_b"), F.col("id").alias("id_b"))
        out["correspondences"] = ends("setup", "setup_b").unionByName(ends("setup_b", "setup"))
    out.save(a.xmlout or a.xml, a.dryRun)


def downsample(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dryRun:
        raise ValueError("downsampling has no dry run")
    steps = options.pyramid(a.downsampling, absolute=False)
    level = ch.read(spark, a.input)
    for i, step in enumerate(steps):
        level = ch.downsampled(level, step)
        level.write.mode("append").partitionBy("setup", "level").parquet(a.output or a.input)
        level = ch.read(spark, a.output or a.input, i + 1)


def clear_interestpoints(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    for r in p["points"].groupBy("tp", "setup", "label").agg(F.count("*").alias("n")).orderBy("tp", "setup", "label").collect():
        print(f"{r['tp']},{r['setup']} {r['label']}: {r['n']} points")
    p["correspondences"] = p["correspondences"].limit(0)
    if not a.correspondencesOnly:
        p["points"] = p["points"].limit(0)
    p.save(a.xml, a.dryRun)


def clear_registrations(spark: SparkSession, a: argparse.Namespace) -> None:
    which = options.exactly_one(keep=a.keep, remove=a.remove)
    p = projects.load(spark, a.xml)
    views = selected(p["views"], a).select("tp", "setup")
    mine = p["transforms"].join(views, ["tp", "setup"], "left_semi")
    rest = p["transforms"].join(views, ["tp", "setup"], "left_anti")
    trimmed = points.keep_first(mine, a.keep, ["tp", "setup"]) if which == "keep" else points.remove_last(mine, a.remove, ["tp", "setup"])
    p["transforms"] = rest.unionByName(trimmed)
    p.save(a.xml, a.dryRun)


def transform_points(spark: SparkSession, a: argparse.Namespace) -> None:
    p = projects.load(spark, a.xml)
    m = select.by_ids(projects.models(p), options.view_ids(a.vi))
    good, bad = points_csv.read(spark, a.csvIn) if a.csvIn else points_csv.from_literals(spark, a.p or [])
    if a.csvIn and a.p:
        more, worse = points_csv.from_literals(spark, a.p)
        good, bad = good.unionByName(more), bad.unionByName(worse)
    for r in bad.limit(100).collect():
        print(f"skipped: {r['value']}", file=sys.stderr)
    out = None
    for r in m.collect():  # the views that were named
        to = g.apply(g.affine(r["m"]), (F.col("x"), F.col("y"), F.col("z")))
        moved = good.select(*[c.alias(x) for x, c in zip(XYZ, to, strict=True)])
        out = moved if out is None else out.unionByName(moved)
    if out is None:
        raise ValueError("no such view")
    if a.csvOut:
        points_csv.write(out, a.csvOut)
    else:
        for r in out.toLocalIterator():
            print(f"{r['x']},{r['y']},{r['z']}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="volumetra")
    commands = top.add_subparsers(dest="command", required=True)
    flag = {"action": "store_true"}

    def command(name: str, run, *groups: str, **opts: dict) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--dryRun", **flag)
        c.add_argument("-x", "--xml", required=name not in ("affine-fusion", "downsample"))
        if "views" in groups:
            for o, _ in SELECTION:
                c.add_argument(f"--{o}")
            c.add_argument("-vi", nargs="*")
        if "images" in groups:
            c.add_argument("--images")
        if "register" in groups:
            c.add_argument("-rtp", "--registrationTP", default="TIMEPOINTS_INDIVIDUALLY", choices=["TIMEPOINTS_INDIVIDUALLY", "ALL_TO_ALL", "ALL_TO_ALL_WITH_RANGE", "REFERENCE_TIMEPOINT"])
            c.add_argument("--referenceTP", type=int)
            c.add_argument("--rangeTP", type=int, default=5)
            c.add_argument("-tm", "--transformationModel", default="AFFINE", choices=["TRANSLATION", "RIGID", "AFFINE"])
            c.add_argument("-rm", "--regularizationModel", default="RIGID", choices=["NONE", "IDENTITY", "TRANSLATION", "RIGID", "AFFINE"])
            c.add_argument("--lambda", type=float, default=0.1)
        for o, kw in opts.items():
            short, _, long = o.partition("__")
            names = [f"-{short}", f"--{long}"] if long else [f"--{short}" if len(short) > 2 else f"-{short}"]
            c.add_argument(*names, **kw)

    def of(kind, default=None, **kw) -> dict:
        return {"type": kind, "default": default} | kw

    size, scale = of(str, "128,128,128"), of(str, "2,2,1")
    command("resave", resave, "images", xo__xmlout=of(str), blockSize=of(str, "128,128,64"), blockScale=of(str, "16,16,1"), ds__downsampling=of(str), c__compression=of(str, "zstandard"), cl__compressionLevel=of(int), o__output=of(str), n5Path=of(str))
    command("detect-interestpoints", detect_interestpoints, "views", "images", l__label=of(str, required=True), s__sigma=of(float, required=True), t__threshold=of(float, required=True), type=of(str, "MAX", choices=["MIN", "MAX", "BOTH"]), localization=of(str, "QUADRATIC", choices=["NONE", "QUADRATIC"]), overlappingOnly=flag, onlyCompareOverlapTiles=flag, storeIntensities=flag, i0__minIntensity=of(float, required=True), i1__maxIntensity=of(float, required=True), prefetch=flag, keepTemporaryN5=flag, maxSpots=of(int, -1), maxSpotsPerOverlap=flag, blockSize=of(str, "512,512,128"), medianFilter=of(int), dsxy__downsampleXY=of(int, 2), dsz__downsampleZ=of(int, 1))
    command("match-interestpoints", match_interestpoints, "views", "register", l__label=of(str, required=True, nargs="+"), m__method=of(str, required=True, choices=["FAST_ROTATION", "FAST_TRANSLATION", "PRECISE_TRANSLATION", "ICP"]), s__significance=of(float, 3.0), sr__searchRadius=of(float), r__redundancy=of(int, 1), n__numNeighbors=of(int, 3), clearCorrespondences=flag, matchAcrossLabels=flag, ipfr__interestpointsForReg=of(str, "ALL", choices=["ALL", "OVERLAPPING_ONLY"]), vr__viewReg=of(str, "OVERLAPPING_ONLY", choices=["OVERLAPPING_ONLY", "ALL_AGAINST_ALL"]), interestPointMergeDistance=of(float, 5.0), groupIllums=flag, groupChannels=flag, groupTiles=flag, splitTimepoints=flag, rit__ransacIterations=of(int), rme__ransacMaxError=of(float), rmir__ransacMinInlierRatio=of(float, 0.1), rmni__ransacMinNumInliers=of(int, 12), rmc__ransacMultiConsensus=flag, ime__icpMaxError=of(float, 5.0), iit__icpIterations=of(int, 200), icpUseRANSAC=flag)
    command("stitching", stitching, "views", "images", ds__downsampling=of(str, "2,2,1"), p__peaksToCheck=of(int, 5), disableSubpixelResolution=flag, minR=of(float, 0.3), maxR=of(float, 1.0), maxShiftX=of(float), maxShiftY=of(float), maxShiftZ=of(float), maxShiftTotal=of(float), channelCombine=of(str, "AVERAGE"), illumCombine=of(str, "PICK_BRIGHTEST"))
    command("solver", solver, "views", "register", s__sourcePoints=of(str, required=True, choices=["IP", "STITCHING"]), groupIllums=flag, groupChannels=flag, groupTiles=flag, splitTimepoints=flag, l__label=of(str, nargs="+"), lw__labelweights=of(str), method=of(str, "ONE_ROUND_SIMPLE", choices=["ONE_ROUND_SIMPLE", "ONE_ROUND_ITERATIVE", "TWO_ROUND_SIMPLE", "TWO_ROUND_ITERATIVE"]), relativeThreshold=of(float, 3.5), absoluteThreshold=of(float, 7.0), maxError=of(float, 5.0), maxIterations=of(int, 10_000), maxPlateauwidth=of(int, 200), disableFixedViews=flag, fv__fixedViews=of(str, nargs="*"))
    command("match-intensities", match_intensities, "views", "images", numCoefficients=of(str, "8,8,8"), renderScale=of(float, 0.25), o__outputPath=of(str), minThreshold=of(float, 1.0), maxThreshold=of(float), minNumCandidates=of(int, 1000), method=of(str, "RANSAC", choices=["RANSAC", "HISTOGRAM"]), numIterations=of(int, 1000), maxEpsilon=of(float, 5.1), minInlierRatio=of(float, 0.1), minNumInliers=of(int, 10), maxTrust=of(float, 3.0))
    command("solve-intensities", solve_intensities, "views", numCoefficients=of(str, "8,8,8"), matchesPath=of(str), maxIterations=of(int, 1000), o__output=of(str))
    command("create-fusion-container", create_fusion_container, o__output=of(str, required=True), c__compression=of(str, "zstandard"), cl__compressionLevel=of(int), ch__numChannels=of(int), tp__numTimepoints=of(int), blockSize=size, d__dataType=of(str, "FLOAT32", choices=list(container.TYPES)), minIntensity=of(float), maxIntensity=of(float), xo__xmlout=of(str), b__boundingBox=of(str), multiRes=flag, ds__downsampling=of(str), preserveAnisotropy=flag, anisotropyFactor=of(float))
    command("affine-fusion", affine_fusion, "views", "images", o__output=of(str, required=True), blockScale=scale, masks=flag, maskOffset=of(str, "0.0,0.0,0.0"), f__fusion=of(str, "AVG_BLEND", choices=list(registration.STRATEGIES)), t__timepointIndex=of(int), c__channelIndex=of(int), prefetch=flag)
    command("nonrigid-fusion", nonrigid_fusion, "views", "images", o__output=of(str, required=True), blockSize=size, blockScale=scale, b__boundingBox=of(str), ip__interestPoints=of(str, required=True, nargs="+"), p__dataType=of(str, "FLOAT32", choices=list(container.TYPES)), minIntensity=of(float), maxIntensity=of(float))
    command("split-images", split_images, xo__xmlout=of(str), tis__targetImageSize=of(str, required=True), to__targetOverlap=of(str, required=True), disableOptimization=flag, fip__fakeInterestPoints=flag, fipDensity=of(float, 100.0), fipMinNumPoints=of(int, 20), fipMaxNumPoints=of(int, 500), fipError=of(float, 0.5), fipExclusionRadius=of(float, 20.0), assignIlluminations=flag)
    command("downsample", downsample, i__input=of(str, required=True), o__output=of(str), blockScale=of(str, "1,1,1"), ds__downsampling=of(str, required=True))
    command("clear-interestpoints", clear_interestpoints, correspondencesOnly=flag)
    command("clear-registrations", clear_registrations, "views", keep=of(int), remove=of(int))
    command("transform-points", transform_points, vi=of(str, required=True, nargs="+"), csvIn=of(str), p=of(str, nargs="*"), csvOut=of(str))
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(session(), a)


if __name__ == "__main__":
    main()
