"""A project: views, registrations, points, links and boxes as tables, saved together in one folder.

``Project`` holds small metadata tables as DataFrames; every save writes a new version and then points ``_current`` at
it, so that a lost job never leaves half a project. ``from_xml`` reads the XML form (view setups with attributes and
sizes, timepoints, missing views, registrations).
"""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Root element of the XML form; readers take any.
ROOT = "Project"
#: Elements that hold the images' place, and the formats of their loaders.
LOADERS = {"n5": "bdv.n5", "zarr": "bdv.multimg.zarr", "table": "chunks"}
SCHEMAS = {
    "views": "tp int, setup long, angle long, channel long, illum long, tile long, present boolean, nx long, ny long, nz long, vx double, vy double, vz double",
    "transforms": "tp int, setup long, seq int, name string, affine array<double>",
    "points": "tp int, setup long, label string, id long, x double, y double, z double, intensity double",
    "correspondences": "tp_a int, setup_a long, label_a string, id_a long, tp_b int, setup_b long, label_b string, id_b long",
    "links": "tp int, setup long, tp_b int, setup_b long, dx double, dy double, dz double, r double, reg_hash long",
    "intensity_matches": "tp int, setup long, tp_b int, setup_b long, cx long, cy long, cz long, cx_b long, cy_b long, cz_b long, scale double, offset double, n long",
    "coefficients": "tp int, setup long, cx int, cy int, cz int, scale double, offset double",
    "boxes": "title string, seq int, x0 long, x1 long, y0 long, y1 long, z0 long, z1 long",
    "properties": "key string, value string",
}


@dataclass
class Project:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        want = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        missing = set(want) - set(df.columns)
        if missing:
            raise ValueError(f"table {name} lacks {sorted(missing)}")
        self.tables[name] = df.select(*want)

    def save(self, path: str, dry_run: bool = False) -> str | None:
        """Write all tables as a new version, or views, registrations and the images' place to an XML file; nothing with
        ``dry_run``."""
        if dry_run:
            return None
        if path.rstrip("/").endswith(".xml"):
            from volumetra.sources import arrays

            fs, file = arrays.open_folder(path)
            fs.create_dir(file.rsplit("/", 1)[0])
            arrays._put(fs, file, to_xml(self).encode())
            return None
        version = uuid.uuid4().hex
        for name in SCHEMAS:
            df = self[name]
            big = name in ("points", "correspondences", "intensity_matches")
            (df if big else df.coalesce(1)).write.parquet(f"{path.rstrip('/')}/{version}/{name}")
        now = self.spark.createDataFrame([(version,)], "version string")
        now.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_current")
        return version


def load(spark: SparkSession, path: str) -> Project:
    if path.rstrip("/").endswith(".xml"):
        return from_xml(spark, path)
    version = spark.read.schema("version string").json(f"{path.rstrip('/')}/_current").first()["version"]
    tables = {n: spark.read.parquet(f"{path.rstrip('/')}/{version}/{n}") for n in SCHEMAS}
    return Project(spark, tables)


def models(project: Project) -> DataFrame:
    """(tp, setup, m): each view's whole map; the identity for views without transforms."""
    from volumetra.functions import geometry as g

    lists = project["transforms"].groupBy("tp", "setup").agg(F.sort_array(F.collect_list(F.struct("seq", "affine"))).alias("l"))
    whole = lists.select("tp", "setup", g.compose_list(F.transform("l", lambda e: e["affine"])).alias("m"))
    return project["views"].filter("present").select("tp", "setup").join(whole, ["tp", "setup"], "left").select("tp", "setup", F.coalesce("m", g.affine(g.IDENTITY)).alias("m"))


def view_boxes(project: Project) -> DataFrame:
    """Present views with their box in world coordinates, inclusive."""
    from volumetra.functions import geometry as g

    v = project["views"].filter("present").join(models(project), ["tp", "setup"])
    lo, hi = g.containing_box(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"n{x}") - 1).cast("double") for x in "xyz"])
    return v.select("tp", "setup", "angle", "channel", "illum", "tile", "m", "nx", "ny", "nz", *[c.alias(f"{x}{i}") for x, a, b in zip("xyz", lo, hi, strict=True) for i, c in ((0, a), (1, b))])


def next_ids(project: Project) -> DataFrame:
    """One row: the id a new setup, angle, channel, illumination or tile gets."""
    return project["views"].agg(*[(F.coalesce(F.max(c), F.lit(-1)) + 1).alias(c) for c in ("setup", "angle", "channel", "illum", "tile")])


def from_xml(spark: SparkSession, path: str) -> Project:
    text = spark.read.text(path, wholetext=True).first()["value"]
    root = ET.fromstring(text)

    def numbers(node, kind=float) -> list:
        return [kind(float(x)) for x in (node.text or "").split()] if node is not None else []

    setups = []
    for s in root.iter("ViewSetup"):
        get = lambda tag, d=0: int(s.findtext(f"attributes/{tag}", str(d)))  # noqa: B023, E731
        size, voxel = numbers(s.find("size"), int) or [0, 0, 0], numbers(s.find("voxelSize/size")) or [1.0, 1.0, 1.0]
        setups.append((int(s.findtext("id")), get("angle"), get("channel"), get("illumination"), get("tile"), *size, *voxel))
    t = root.find(".//Timepoints")
    tps: list[int] = [0]
    if t is not None:
        first, last, pattern = t.findtext("first"), t.findtext("last"), t.findtext("integerpattern")
        if first is not None:
            tps = list(range(int(first), int(last) + 1))
        elif pattern:
            tps = sorted({i for part in pattern.split(",") for a, _, b in [part.strip().partition("-")] for i in range(int(a), int(b or a) + 1)})
    missing = {(int(m.get("timepoint")), int(m.get("setup"))) for m in root.iter("MissingView")}
    views = [(tp, s[0], *s[1:5], (tp, s[0]) not in missing, *s[5:]) for tp in tps for s in setups]
    transforms = []
    for r in root.iter("ViewRegistration"):
        for i, x in enumerate(r.iter("ViewTransform")):
            transforms.append((int(r.get("timepoint")), int(r.get("setup")), i, (x.findtext("Name") or "").strip(), numbers(x.find("affine"))))
    out = Project(spark)
    facts = {}
    loader = root.find(".//ImageLoader")
    place = next((e for e in loader if e.tag in LOADERS) if loader is not None else iter(()), None)
    if place is not None:
        facts["images"] = f"{path.rstrip('/').rsplit('/', 1)[0]}/{place.text}" if place.get("type") == "relative" else place.text
    if loader is not None and (levels := loader.findtext("levels")):
        facts["levels"] = [[int(x) for x in f.split(",")] for f in levels.split(";")]
    out["properties"] = spark.createDataFrame([(k, json.dumps(v)) for k, v in facts.items()], SCHEMAS["properties"])
    out["views"] = spark.createDataFrame(views, SCHEMAS["views"])
    out["transforms"] = spark.createDataFrame(transforms, SCHEMAS["transforms"])
    return out


def to_xml(project: Project) -> str:
    """The XML form of views and registrations."""
    root = ET.Element(ROOT, version="0.2")
    seq = ET.SubElement(root, "SequenceDescription")
    facts = {r["key"]: json.loads(r["value"]) for r in project["properties"].collect()}
    if "images" in facts:
        kind = next((k for k in LOADERS if facts["images"].rstrip("/").lower().endswith(f".{k}")), "table")
        loader = ET.SubElement(seq, "ImageLoader", format=LOADERS[kind], version="1.0")
        ET.SubElement(loader, kind, type="absolute").text = facts["images"]
        ET.SubElement(loader, "levels").text = ";".join(",".join(map(str, f)) for f in facts.get("levels", [[1, 1, 1]]))
    holder = ET.SubElement(seq, "ViewSetups")
    views = [r.asDict() for r in project["views"].orderBy("setup", "tp").collect()]
    for s in {v["setup"]: v for v in views}.values():
        e = ET.SubElement(holder, "ViewSetup")
        ET.SubElement(e, "id").text = str(s["setup"])
        ET.SubElement(e, "size").text = f"{s['nx']} {s['ny']} {s['nz']}"
        ET.SubElement(ET.SubElement(e, "voxelSize"), "size").text = f"{s['vx']} {s['vy']} {s['vz']}"
        a = ET.SubElement(e, "attributes")
        for tag, c in (("illumination", "illum"), ("channel", "channel"), ("tile", "tile"), ("angle", "angle")):
            ET.SubElement(a, tag).text = str(s[c])
    t = ET.SubElement(seq, "Timepoints", type="pattern")
    ET.SubElement(t, "integerpattern").text = ",".join(str(x) for x in sorted({v["tp"] for v in views}))
    gone = ET.SubElement(seq, "MissingViews")
    for v in views:
        if not v["present"]:
            ET.SubElement(gone, "MissingView", timepoint=str(v["tp"]), setup=str(v["setup"]))
    regs = ET.SubElement(root, "ViewRegistrations")
    by: dict = {}
    for r in project["transforms"].orderBy("tp", "setup", "seq").collect():
        by.setdefault((r["tp"], r["setup"]), []).append(r)
    for (tp, setup), rows in by.items():
        e = ET.SubElement(regs, "ViewRegistration", timepoint=str(tp), setup=str(setup))
        for r in rows:
            x = ET.SubElement(e, "ViewTransform", type="affine")
            ET.SubElement(x, "Name").text = r["name"]
            ET.SubElement(x, "affine").text = " ".join(str(v) for v in r["affine"])
    return ET.tostring(root, encoding="unicode")
