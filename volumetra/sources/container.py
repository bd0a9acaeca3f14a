"""Fusion containers: a folder with properties and chunks of the output, per channel and timepoint, with a pyramid."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.functions import options
from volumetra.sources import project as projects

TYPES = ("UINT8", "UINT16", "FLOAT32")


def properties_of(project: projects.Project, source: str, *, dtype: str = "FLOAT32", block=(128, 128, 128), box: dict | None = None, channels: int | None = None, timepoints: int | None = None, low: float | None = None, high: float | None = None, anisotropy: bool = False, factor: float | None = None, multires: bool = False, pyramid: str | None = None, codec: str = "zstandard", level: int | None = None, xml_out: str | None = None) -> dict:
    """The properties of a new container. Unset numbers are left out; whole-number types get their full range by default."""
    if dtype not in TYPES:
        raise ValueError(f"output is one of {', '.join(TYPES)}")
    boxes = projects.view_boxes(project)
    if box is None:
        row = boxes.agg(*[f(f"{x}{i}").alias(f"{x}{i}") for x in "xyz" for i, f in ((0, F.min), (1, F.max))]).first()
        box = row.asDict()
    if anisotropy:
        if factor is None:
            factor = project["views"].filter("present").agg(F.avg(F.col("vz") / F.col("vx")).alias("f")).first()["f"]
        import math

        box = box | {"z0": math.floor(box["z0"] / factor), "z1": math.ceil(box["z1"] / factor)}
    size = [box[f"{x}1"] - box[f"{x}0"] + 1 for x in "xyz"]
    levels = options.pyramid_levels(multires, pyramid, size)
    options.relative_factors(levels)
    counts = boxes.agg(F.count_distinct("channel").alias("c"), F.count_distinct("tp").alias("t")).first()
    if dtype != "FLOAT32":
        low, high = 0 if low is None else low, {"UINT8": 255, "UINT16": 65535}[dtype] if high is None else high
    out = {
        "source": source, "num_channels": channels or counts["c"], "num_timepoints": timepoints or counts["t"], "box_min": [box[f"{x}0"] for x in "xyz"], "box_max": [box[f"{x}1"] for x in "xyz"],
        "preserve_anisotropy": anisotropy, "anisotropy_factor": factor if anisotropy else None, "data_type": dtype, "block_size": list(block), "min_intensity": low, "max_intensity": high,
        "levels": [{"factors": list(f), "size": [max(1, n // k) for n, k in zip(size, f, strict=True)]} for f in levels], "compression": codec, "compression_level": level, "project_out": xml_out,
    }
    return {k: v for k, v in out.items() if v is not None}


def create(spark: SparkSession, path: str, properties: dict) -> None:
    rows = [(k, json.dumps(v)) for k, v in properties.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.json(f"{path.rstrip('/')}/properties")


def read(spark: SparkSession, path: str) -> dict:
    """The properties; an error with a hint if there is no container."""
    try:
        rows = spark.read.schema("key string, value string").json(f"{path.rstrip('/')}/properties").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no fusion container at {path}; create one first") from e
    return {r["key"]: json.loads(r["value"]) for r in rows}


def multiscales(properties: dict, name: str = "fused") -> dict:
    """Metadata of a five-dimensional multiscale image (x, y, z, channel, timepoint), full resolution at scale 1."""
    axes = [{"name": a, "type": t} | ({"unit": "micrometer"} if t == "space" else {}) for a, t in (("t", "time"), ("c", "channel"), ("z", "space"), ("y", "space"), ("x", "space"))]
    datasets = []
    for i, level in enumerate(properties["levels"]):
        fx, fy, fz = level["factors"]
        shift = [0.0, 0.0, *[(f - 1) / 2 for f in (fz, fy, fx)]]
        datasets.append({"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0, float(fz), float(fy), float(fx)]}, {"type": "translation", "translation": shift}]})
    return {"multiscales": [{"version": "0.4", "name": name, "axes": axes, "datasets": datasets}]}


def volumes(path: str) -> str:
    """Where a container's images lie: an image group in it that viewers open, N5 arrays, or a chunk table."""
    root = path.rstrip("/")
    try:
        kind = options.storage_format(root)
    except ValueError:
        kind = ""
    return f"{root}/volumes" + {"ZARR": ".zarr", "N5": ".n5"}.get(kind, "")


def output_project(spark: SparkSession, path: str, properties: dict) -> projects.Project:
    """A project of the output: a setup for each channel, with the size of the output box, unmoved, and its images' place."""
    size = [b - a + 1 for a, b in zip(properties["box_min"], properties["box_max"], strict=True)]
    deep = float(properties.get("anisotropy_factor", 1.0))
    views = [(t, c, 0, c, 0, 0, True, *size, 1.0, 1.0, deep) for t in range(properties["num_timepoints"]) for c in range(properties["num_channels"])]
    facts = {"images": volumes(path), "levels": [x["factors"] for x in properties["levels"]]}
    out = projects.Project(spark)
    out["views"] = spark.createDataFrame(views, projects.SCHEMAS["views"])
    out["properties"] = spark.createDataFrame([(k, json.dumps(v)) for k, v in facts.items()], projects.SCHEMAS["properties"])
    return out


def blocks(spark: SparkSession, properties: dict, scale=(2, 2, 1)) -> DataFrame:
    """Compute blocks of the output box in world coordinates, from one row."""
    from volumetra.operators import blocks as b

    row = [tuple(v for p in zip(properties["box_min"], properties["box_max"], strict=True) for v in p)]
    box = spark.createDataFrame(row, ", ".join(f"{x}{i} long" for x in "xyz" for i in (0, 1)))
    return b.block_boxes(b.grid(box, tuple(properties["block_size"]), scale))


def volume_views(project: projects.Project, t_index: int | None, c_index: int | None) -> DataFrame:
    """Views with their volume (t_index, c_index); of one volume only if both indices are given."""
    from volumetra.operators import select

    options.fusion_indices(t_index, c_index, False)
    v = projects.view_boxes(project)
    if t_index is not None:
        return v.withColumns({"t_index": F.lit(t_index), "c_index": F.lit(c_index)})
    return select.volume_indices(v)


def anisotropic(views: DataFrame, factor: float | None) -> DataFrame:
    """Views whose maps are followed by the division of z by the factor."""
    if not factor:
        return views
    m = g.compose(g.affine((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1 / factor, 0)), F.col("m"))
    lo, hi = g.containing_box(m, [F.lit(0.0)] * 3, [(F.col(f"n{x}") - 1).cast("double") for x in "xyz"])
    return views.withColumns({"m": m, **{f"{x}{i}": c for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))}})
