"""N5, zarr and OME-NGFF containers as a Spark data source of chunks.

``read`` plans tasks over ranges of each array's grid, from metadata alone (no listing of files); levels, views and boxes are
pruned before a block is opened, whether given as options or as filters on the columns tp, setup, level, ox, oy and oz.
Blocks that are not stored are missing rows, unless the fill value is not 0.

``write`` stores blocks that lie on the grid. Tasks write into a staging folder of the job, each block under a name of its
own that is then renamed; the driver's commit moves each array's folder into place and writes its metadata last, so that a
failed or repeated task leaves no array, and no half block. Shapes and types are what the tasks report: the plan runs once.
On object stores, where a put is atomic and a rename is a copy, blocks go to their final names; they belong to no array
until its metadata is there.

Layouts: ``n5`` (setupS/timepointT/sL), ``zarr`` (T/S/L, three axes x, y, z), ``ngff`` (one five-dimensional array L for each
level, indexed by timepoint and channel, axes t, c, z, y, x), ``ngff-views`` (sS-tT.zarr/L, an image for each view).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from volumetra.sources import codecs

SCHEMA = "tp int, setup long, level int, gx int, gy int, gz int, ox long, oy long, oz long, sx long, sy long, sz long, dtype string, payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
NUMPY = {"UINT8": "u1", "UINT16": "<u2", "UINT32": "<u4", "UINT64": "<u8", "INT8": "i1", "INT16": "<i2", "INT32": "<i4", "INT64": "<i8", "FLOAT32": "<f4", "FLOAT64": "<f8"}
#: Voxel bytes that a reading task takes, and that it hands to Spark at once.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
OBJECT_STORES = ("s3", "gcs", "abfs")
FORMAT = "volumetra-arrays"


@dataclass(frozen=True)
class Layout:
    folder: str
    axes: str
    n5: bool = False
    indexed: bool = False

    def of(self, tp: int, setup: int, level: int) -> str:
        return self.folder.format(tp=tp, setup=setup, level=level)


LAYOUTS = {
    "n5": Layout("setup{setup}/timepoint{tp}/s{level}", "xyz", n5=True),
    "zarr": Layout("{tp}/{setup}/{level}", "xyz"),
    "ngff": Layout("{level}", "tczyx", indexed=True),
    "ngff-views": Layout("s{setup}-t{tp}.zarr/{level}", "tczyx"),
}


def open_folder(path: str):
    """The file system and the path in it of a plain path or an address."""
    import pyarrow.fs

    found = re.match(r"file:/*(/.*)", path)
    return pyarrow.fs.FileSystem.from_uri(found[1] if found else path.rstrip("/"))


def _exists(fs, path: str) -> bool:
    import pyarrow.fs

    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def _put(fs, path: str, data: bytes) -> None:
    """A whole file or none."""
    if fs.type_name in OBJECT_STORES:
        with fs.open_output_stream(path) as out:
            out.write(data)
        return
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def _load(fs, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Info:
    """What the metadata of an array says; shape and block are along x, y, z."""

    shape: tuple[int, ...]
    block: tuple[int, ...]
    dtype: str
    codec: str
    axes: str
    chunk: tuple[int, ...]  # along axes
    stored: str  # numpy's name of the stored type
    separator: str
    order: str
    fill: float


KINDS = {np.dtype(v).newbyteorder("<").str: k for k, v in NUMPY.items()}


def info(fs, folder: str, layout: Layout) -> Info:
    """An error if there is no array."""
    try:
        if layout.n5:
            m = _load(fs, f"{folder}/attributes.json")
            kind = np.dtype(m["dataType"]).newbyteorder(">")
            block = tuple(m["blockSize"])
            return Info(tuple(m["dimensions"]), block, KINDS[kind.newbyteorder("<").str], codecs.n5_codec(m.get("compression") or m["compressionType"]), "xyz", block, kind.str, "/", "F", 0)
        m = _load(fs, f"{folder}/.zarray")
    except (FileNotFoundError, KeyError) as e:
        raise FileNotFoundError(f"no array at {folder}") from e
    if m.get("filters"):
        raise ValueError(f"filters of {folder} are not supported")
    axes = layout.axes[-len(m["shape"]) :]
    by = dict(zip(axes, zip(m["shape"], m["chunks"], strict=True), strict=True))
    kind = np.dtype(m["dtype"])
    return Info(tuple(by[x][0] for x in "xyz"), tuple(by[x][1] for x in "xyz"), KINDS[kind.newbyteorder("<").str], codecs.zarr_codec(m["compressor"]), axes, tuple(m["chunks"]), kind.str, m.get("dimension_separator", "."), m["order"], float(m["fill_value"] or 0))


def block_name(i: Info, layout: Layout, tp: int, setup: int, g) -> tuple[str, dict[str, int]]:
    """The file of a block in its array's folder, and the places of tp and setup inside of it."""
    at = dict(zip("xyz", g, strict=True)) | {"t": tp if layout.indexed else 0, "c": setup if layout.indexed else 0}
    size = dict(zip(i.axes, i.chunk, strict=True))
    within = {a: at[a] % size[a] for a in "tc" if a in size}
    return i.separator.join(str(at[a] // size[a] if a in "tc" else at[a]) for a in i.axes), within


def decode_block(data: bytes, i: Info, within: dict[str, int], n5: bool) -> np.ndarray:
    """A stored block along x, y, z."""
    shape = i.chunk
    if n5:
        mode, dims = struct.unpack_from(">HH", data)
        if mode not in (0, 1):
            raise ValueError(f"blocks of mode {mode} hold no voxels")
        shape = struct.unpack_from(f">{dims}I", data, 4)
        data = data[4 + 4 * dims + 4 * mode :]
    a = np.frombuffer(codecs.decompress(data, i.codec), i.stored).reshape(shape, order=i.order)
    a = a[tuple(within.get(x, slice(None)) for x in i.axes)]
    left = [x for x in i.axes if x not in within]
    return a.transpose([left.index(x) for x in "xyz"])


def _grown(a: np.ndarray, shape) -> np.ndarray:
    """With zeros up to a shape."""
    if all(x >= n for x, n in zip(a.shape, shape, strict=True)):
        return a
    out = np.zeros([max(x, n) for x, n in zip(a.shape, shape, strict=True)], a.dtype)
    out[tuple(slice(0, x) for x in a.shape)] = a
    return out


def encode_block(a: np.ndarray, i: Info, level: int | None, n5: bool) -> bytes:
    """A block along x, y, z as it is stored: cut at the border in N5, filled up with zeros in zarr."""
    if n5:
        body = a.astype(np.dtype(i.stored)).tobytes(order="F")
        return struct.pack(">HH3I", 0, 3, *a.shape) + codecs.compress(body, i.codec, level)
    whole = np.zeros(i.block, i.stored)
    whole[tuple(slice(0, s) for s in a.shape)] = a
    return codecs.compress(whole.transpose(["xyz".index(x) for x in i.axes if x in "xyz"]).tobytes(), i.codec, level)


# --- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Blocks(ds.InputPartition):
    """A range of the blocks of an array, numbered along the pruned part of its grid."""

    tp: int
    setup: int
    level: int
    info: Info
    low: tuple[int, ...]
    high: tuple[int, ...]
    start: int
    stop: int


class Reader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], LAYOUTS[options["layout"]]
        self.arrays = [tuple(a) for a in json.loads(options["arrays"])]
        box = json.loads(options.get("box", "null"))
        self.low, self.high = ([float("-inf")] * 3, [float("inf")] * 3) if box is None else box
        self.origin_low, self.origin_high = [float("-inf")] * 3, [float("inf")] * 3

    def pushFilters(self, filters):
        """Arrays and origins that no row can have are left out; every filter is also kept for Spark."""
        places = {("tp",): 0, ("setup",): 1, ("level",): 2}
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name in places and isinstance(f, ds.EqualTo | ds.In):
                wanted = set(value) if isinstance(f, ds.In) else {value}
                self.arrays = [a for a in self.arrays if a[places[name]] in wanted]
            elif name in (("ox",), ("oy",), ("oz",)) and isinstance(f, ds.EqualTo | ds.LessThan | ds.LessThanOrEqual | ds.GreaterThan | ds.GreaterThanOrEqual):
                d = "xyz".index(name[0][1])
                if not isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
                    self.origin_high[d] = min(self.origin_high[d], value)
                if not isinstance(f, ds.LessThan | ds.LessThanOrEqual):
                    self.origin_low[d] = max(self.origin_low[d], value)
            yield f

    def partitions(self):
        fs, root = open_folder(self.path)
        out = []
        for tp, setup, level in self.arrays:
            i = info(fs, f"{root}/{self.layout.of(tp, setup, level)}", self.layout)
            low, high = [], []
            for d in range(3):
                b, n = i.block[d], -(-i.shape[d] // i.block[d])
                first = max(0, self.low[d] // b, -(-self.origin_low[d] // b))
                last = min(n - 1, self.high[d] // b, self.origin_high[d] // b)
                low.append(int(min(first, n)))
                high.append(int(max(last, -1)) + 1)
            blocks = int(np.prod([max(0, h - x) for x, h in zip(low, high, strict=True)]))
            step = max(1, TASK_BYTES // (int(np.prod(i.block)) * np.dtype(i.stored).itemsize))
            out += [Blocks(tp, setup, level, i, tuple(low), tuple(high), s, min(blocks, s + step)) for s in range(0, blocks, step)]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing left after pruning
            return
        fs, root = open_folder(self.path)
        p, i = partition, partition.info
        folder, rows, size = f"{root}/{self.layout.of(p.tp, p.setup, p.level)}", [], 0
        grid = [h - x for x, h in zip(p.low, p.high, strict=True)]
        for k in range(p.start, p.stop):
            g = [int(x) + o for x, o in zip(np.unravel_index(k, grid), p.low, strict=True)]
            origin = [x * b for x, b in zip(g, i.block, strict=True)]
            n = [min(b, s - o) for b, s, o in zip(i.block, i.shape, origin, strict=True)]
            name, within = block_name(i, self.layout, p.tp, p.setup, g)
            try:
                with fs.open_input_stream(f"{folder}/{name}") as f:
                    a = _grown(decode_block(f.read(), i, within, self.layout.n5)[tuple(slice(0, x) for x in n)], n)
            except FileNotFoundError:
                if not i.fill:
                    continue
                a = np.full(n, i.fill)
            payload = np.ascontiguousarray(a.astype(NUMPY[i.dtype])).tobytes()
            rows.append((p.tp, p.setup, p.level, *g, *origin, *n, i.dtype, payload))
            size += len(payload)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


# --- writing -----------------------------------------------------------------------------------------------------


@dataclass
class Written(ds.WriterCommitMessage):
    """For each array a task met: its extent along x, y, z and its type."""

    arrays: dict[tuple[int, int, int], tuple[list[int], str]]


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.layout = options["path"], LAYOUTS[options["layout"]]
        self.block, self.codec = tuple(json.loads(options["block"])), options["codec"]
        self.compression = json.loads(options.get("compressionlevel", "null"))
        self.counts, self.attributes = json.loads(options.get("counts", "null")), json.loads(options.get("attributes", "{}"))
        self.shapes = {(t, s): shape for t, s, shape in json.loads(options.get("shapes", "[]"))}
        self.job = f".staging-{uuid.uuid4().hex}"
        fs, root = open_folder(self.path)
        if fs.type_name not in OBJECT_STORES:
            fs.create_dir(f"{root}/{self.job}")

    def planned(self, dtype: str) -> Info:
        if self.layout.n5:
            return Info((), self.block, dtype, self.codec, "xyz", self.block, np.dtype(NUMPY[dtype]).newbyteorder(">").str, "/", "F", 0)
        chunk = tuple(dict(zip("xyz", self.block, strict=True)).get(a, 1) for a in self.layout.axes)
        codec = "lz4raw" if self.codec == "lz4" else self.codec
        return Info((), self.block, dtype, codec, self.layout.axes, chunk, np.dtype(NUMPY[dtype]).str, "/" if "t" in self.layout.axes else ".", "C", 0)

    def unit(self, tp: int, setup: int, level: int) -> str:
        """The folder that a commit moves: an array's, or one volume's part of an array."""
        folder = self.layout.of(tp, setup, level)
        return f"{folder}/{tp}/{setup}" if self.layout.indexed else folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_folder(self.path)
        direct, found, made = fs.type_name in OBJECT_STORES, {}, set()
        for batch in iterator:
            for r in batch.to_pylist():
                key, size = (r["tp"], r["setup"], r["level"]), [r["sx"], r["sy"], r["sz"]]
                g, origin = [r["gx"], r["gy"], r["gz"]], [r["ox"], r["oy"], r["oz"]]
                if any(o != x * b or n > b for o, x, n, b in zip(origin, g, size, self.block, strict=True)):
                    raise ValueError(f"a chunk at {origin} of {size} voxels does not lie on the grid of {list(self.block)}")
                folder = f"{root}/{self.layout.of(*key)}"
                if key not in found:
                    if not self.layout.indexed and _exists(fs, f"{folder}/{'attributes.json' if self.layout.n5 else '.zarray'}"):
                        raise FileExistsError(f"there is an array at {folder}")
                    found[key] = ([0, 0, 0], r["dtype"])
                extent, dtype = found[key]
                if dtype != r["dtype"]:
                    raise ValueError(f"chunks of {key} are of {dtype} and {r['dtype']}")
                extent[:] = [max(e, o + n) for e, o, n in zip(extent, origin, size, strict=True)]
                i = self.planned(dtype)
                a = np.frombuffer(r["payload"], NUMPY[dtype]).reshape(size)
                if not a.any():
                    continue  # zeros are the fill value
                if self.layout.n5 and key[:2] in self.shapes:  # whole blocks but for those at the border
                    a = _grown(a, [min(b, n - o) for b, n, o in zip(self.block, self.shapes[key[:2]], origin, strict=True)])
                name, _ = block_name(i, self.layout, *key[:2], g)
                file = f"{folder}/{name}" if direct else f"{root}/{self.job}/{self.layout.of(*key)}/{name}"
                parent = file.rsplit("/", 1)[0]
                if parent not in made:
                    if not direct and not _exists(fs, f"{root}/{self.job}"):
                        raise RuntimeError("the job has been aborted")
                    fs.create_dir(parent)
                    made.add(parent)
                _put(fs, file, encode_block(a, i, self.compression, self.layout.n5))
        return Written(found)

    def commit(self, messages) -> None:
        fs, root = open_folder(self.path)
        found: dict[tuple[int, int, int], tuple[list[int], str]] = {}
        for m in messages:
            for key, (extent, dtype) in (m.arrays if m else {}).items():
                before, kind = found.setdefault(key, ([0, 0, 0], dtype))
                if kind != dtype:
                    raise ValueError(f"chunks of {key} are of {kind} and {dtype}")
                before[:] = map(max, before, extent)
        for key in found:
            staged, final = f"{root}/{self.job}/{self.unit(*key)}", f"{root}/{self.unit(*key)}"
            if fs.type_name in OBJECT_STORES:
                continue
            if _exists(fs, final):  # what a lost job left, or the volume that this one replaces
                fs.delete_dir(final)
            fs.create_dir(final.rsplit("/", 1)[0])
            if _exists(fs, staged):
                fs.move(staged, final)
        folders: dict[str, tuple[list[int], str, list]] = {}
        for key, (extent, dtype) in found.items():
            shape, _, keys = folders.setdefault(self.layout.of(*key), ([0, 0, 0], dtype, []))
            shape[:] = map(max, shape, self.shapes.get(key[:2], extent))
            keys.append(key)
        for folder, (shape, dtype, keys) in folders.items():
            fs.create_dir(f"{root}/{folder}")
            self.describe(fs, f"{root}/{folder}", shape, dtype, keys)
        kinds = {f"setup{key[1]}": np.dtype(NUMPY[dtype]).name for key, (_, dtype) in found.items()}
        for name, text in self.attributes.items():
            if text.get("dataType", "") is None:
                text["dataType"] = kinds.get(name.split("/")[0])
            fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0])
            _put(fs, f"{root}/{name}", json.dumps(text).encode())
        self._clean(fs, root)

    def describe(self, fs, folder: str, shape: list[int], dtype: str, keys: list) -> None:
        """The array's metadata, which makes it one."""
        i = self.planned(dtype)
        if self.layout.n5:
            text = {"dimensions": shape, "blockSize": list(self.block), "dataType": np.dtype(NUMPY[dtype]).name, "compression": codecs.n5_entry(self.codec, self.compression)}
            _put(fs, f"{folder}/attributes.json", json.dumps(text).encode())
            return
        counts = self.counts or [max(k[0] for k in keys) + 1, max(k[1] for k in keys) + 1]
        by = dict(zip("xyz", shape, strict=True)) | ({"t": counts[0], "c": counts[1]} if self.layout.indexed else {"t": 1, "c": 1})
        text = {"zarr_format": 2, "shape": [by[a] for a in i.axes], "chunks": list(i.chunk), "dtype": i.stored, "compressor": codecs.zarr_entry(self.codec, self.compression), "fill_value": 0, "order": "C", "filters": None, "dimension_separator": i.separator}
        if self.layout.indexed and _exists(fs, f"{folder}/.zarray"):
            old = _load(fs, f"{folder}/.zarray")
            if {**old, "shape": 0} != {**text, "shape": 0}:
                raise ValueError(f"the array at {folder} is stored in another way")
            text["shape"] = [max(a, b) for a, b in zip(old["shape"], text["shape"], strict=True)]
        _put(fs, f"{folder}/.zarray", json.dumps(text).encode())

    def abort(self, messages) -> None:
        self._clean(*open_folder(self.path))

    def _clean(self, fs, root: str) -> None:
        if _exists(fs, f"{root}/{self.job}"):
            fs.delete_dir(f"{root}/{self.job}")


class Arrays(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(Arrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, arrays: list[tuple[int, int, int]], layout: str = "zarr", box: tuple | None = None) -> DataFrame:
    """Chunks of the arrays (tp, setup, level); of those that touch ``box`` ((x, y, z), (x, y, z), inclusive) if it is given."""
    if not arrays:
        return spark.createDataFrame([], SCHEMA)
    _register(spark)
    more = {} if box is None else {"box": json.dumps(box)}
    return spark.read.format(FORMAT).options(path=path, layout=layout, arrays=json.dumps(arrays), **more).load()


def write(chunks: DataFrame, path: str, layout: str, block, codec: str = "zstandard", level: int | None = None, counts: tuple[int, int] | None = None, shapes: dict[tuple[int, int], list[int]] | None = None, attributes: dict | None = None) -> None:
    """Chunks on the grid of ``block`` as arrays, with ``attributes`` (file: content) in the same commit. ``counts`` are the
    timepoints and channels of a five-dimensional array, ``shapes`` the voxels by (tp, setup) where chunks alone do not tell."""
    _register(chunks.sparkSession)
    given = {"counts": counts, "shapes": [[*v, shape] for v, shape in (shapes or {}).items()], "compressionLevel": level, "attributes": attributes}
    more = {k: json.dumps(v) for k, v in given.items() if v is not None}
    chunks.select(*NAMES).write.format(FORMAT).options(path=path, layout=layout, block=json.dumps([int(b) for b in block]), codec=codecs.named(codec), **more).mode("append").save()


def layout_of(path: str, default: str = "zarr") -> str:
    """The layout of a container: N5 by its ending, zarr by what lies in it; ``default`` for one that is not there yet."""
    if path.rstrip("/").lower().endswith(".n5"):
        return "n5"
    fs, root = open_folder(path)
    if not _exists(fs, root):
        return default
    if _exists(fs, f"{root}/.zattrs") and "multiscales" in _load(fs, f"{root}/.zattrs") and _exists(fs, f"{root}/0/.zarray"):
        return "ngff"
    import pyarrow.fs

    names = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root))]  # one for each view at most
    return "ngff-views" if any(re.fullmatch(r"s\d+-t\d+\.zarr", n) for n in names) else default


def n5_attributes(views: list[tuple[int, int]], factors, resolution=(1.0, 1.0, 1.0)) -> dict:
    """The files above the arrays of an N5 container that name levels and types; the commit knows the type."""
    levels: list = [list(f) for f in factors]
    out: dict = {"attributes.json": {"n5": "4.0.0"}}
    for tp, setup in views:
        out[f"setup{setup}/attributes.json"] = {"downsamplingFactors": levels, "dataType": None}
        out[f"setup{setup}/timepoint{tp}/attributes.json"] = {"resolution": list(resolution), "saved_completely": True, "multiScale": True}
    return out


def ngff_attributes(multiscales: dict, folder: str = "", more: dict | None = None) -> dict:
    """The files of an image's group."""
    at = f"{folder}/" if folder else ""
    return {f"{at}.zgroup": {"zarr_format": 2}, f"{at}.zattrs": multiscales | (more or {})}
