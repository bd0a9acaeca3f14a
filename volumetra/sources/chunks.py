"""Images as tables of chunks: one row per chunk with its array as bytes (x, y, z in C order).

Chunk tables are Parquet, partitioned by setup and level, with the chunk's box as plain columns whose statistics prune
row groups. N5 and zarr containers are read and written by the data source of ``arrays``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import options
from volumetra.operators.graph import stored
from volumetra.sources import arrays
from volumetra.sources.arrays import NAMES, NUMPY, SCHEMA

KEY = ["tp", "setup", "level", "gx", "gy", "gz"]


def decode(payload: bytes, dtype: str, shape) -> np.ndarray:
    return np.frombuffer(payload, NUMPY[dtype]).reshape([int(s) for s in shape])


def converted(a: np.ndarray, dtype: str) -> np.ndarray:
    """Rounded and clamped where the type is whole-numbered."""
    kind = np.dtype(NUMPY[dtype])
    if kind.kind == "f":
        return a.astype(kind)
    info = np.iinfo(kind)
    return np.clip(np.floor(a + 0.5), info.min, info.max).astype(kind)


def encode(a: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(converted(a, dtype)).tobytes()


def from_arrays(spark: SparkSession, images: dict[tuple[int, int], np.ndarray], block=(64, 64, 64), dtype: str = "FLOAT32") -> DataFrame:
    """Small images as chunks, keyed by (tp, setup): for tests and made-up data."""
    rows = []
    for (tp, setup), a in images.items():
        for o in np.ndindex(*[-(-n // b) for n, b in zip(a.shape, block, strict=True)]):
            lo = [i * b for i, b in zip(o, block, strict=True)]
            part = a[tuple(slice(x, x + b) for x, b in zip(lo, block, strict=True))]
            rows.append((tp, setup, 0, *o, *lo, *part.shape, dtype, encode(part, dtype)))
    return spark.createDataFrame(rows, SCHEMA)


def from_voxels(voxels: DataFrame, block=(32, 32, 8), dtype: str = "FLOAT32") -> DataFrame:
    """Chunks of sparse voxels (tp if there is one, setup, x, y, z, v); cells without voxel are 0, chunks without voxel are
    missing."""
    tp = F.col("tp").cast("int") if "tp" in voxels.columns else F.lit(0)
    cells = voxels.select(tp.alias("tp"), F.col("setup").cast("long").alias("setup"), "x", "y", "z", F.col("v").cast("double").alias("v"))
    cells = cells.withColumns({f"g{x}": F.floor(F.col(x) / b).cast("int") for x, b in zip("xyz", block, strict=True)})

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tp, setup, *g = key
        lo = [int(i) * b for i, b in zip(g, block, strict=True)]
        a = np.zeros(block)
        at = tuple((pdf[x] - o).to_numpy(int) for x, o in zip("xyz", lo, strict=True))
        a[at] = pdf["v"].to_numpy()
        return pd.DataFrame([(tp, setup, 0, *g, *lo, *block, dtype, encode(a, dtype))], columns=NAMES)

    return cells.groupBy("tp", "setup", "gx", "gy", "gz").applyInPandas(build, SCHEMA)


def boxes(chunks: DataFrame) -> DataFrame:
    """Chunks with inclusive bounds x0..z1."""
    return chunks.withColumns({f"{x}{i}": F.col(f"o{x}") + (F.col(f"s{x}") - 1 if i else 0) for x in "xyz" for i in (0, 1)})


def image_sizes(chunks: DataFrame) -> DataFrame:
    """(tp, setup, level, nx, ny, nz)."""
    return chunks.groupBy("tp", "setup", "level").agg(*[F.max(F.col(f"o{x}") + F.col(f"s{x}")).alias(f"n{x}") for x in "xyz"])


def non_empty(chunks: DataFrame) -> DataFrame:
    """Without the chunks that are all 0."""
    return chunks.filter(F.length(F.regexp_replace(F.hex("payload"), "0", "")) > 0)


def write(chunks: DataFrame, path: str, codec: str = "zstandard", mode: str = "errorifexists", level: int | None = None, by=("setup", "level")) -> None:
    """A chunk table; ``level`` is that of the codec, where Parquet's has one."""
    more = {} if level is None else options.parquet_level(codec, level)
    chunks.write.mode(mode).partitionBy(*by).option("compression", options.parquet_codec(codec)).options(**more).parquet(path)


def read(spark: SparkSession, path: str, level: int | None = 0) -> DataFrame:
    """The chunks of a level (all levels for None); partitions of other levels are not read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if level is None else df.filter(F.col("level") == level)


def downsampled(chunks: DataFrame, factors: tuple[int, int, int], block=(64, 64, 64)) -> DataFrame:
    """The next level: every chunk is halved where it lies, then the parts are gathered into blocks of the new level.

    Chunk offsets have to be multiples of the factors (chunk sizes are even), so that no cell crosses chunks.
    """
    if any(f not in (1, 2) for f in factors):
        raise ValueError("a level halves an axis or leaves it")
    return _regrouped(chunks, block, factors)


def rechunked(chunks: DataFrame, block) -> DataFrame:
    """The same images in blocks of another size (resaving)."""
    return _regrouped(chunks, block, (1, 1, 1))


def _regrouped(chunks: DataFrame, block, factors) -> DataFrame:
    from volumetra.operators.kernels.detection import halved

    up = 0 if factors == (1, 1, 1) else 1

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                a = halved(decode(r.payload, r.dtype, (r.sx, r.sy, r.sz)), factors)
                lo = [o // f for o, f in zip((r.ox, r.oy, r.oz), factors, strict=True)]
                if not a.size:
                    continue
                first = [x // b for x, b in zip(lo, block, strict=True)]
                last = [(x + n - 1) // b for x, n, b in zip(lo, a.shape, block, strict=True)]
                for g in np.ndindex(*[j - i + 1 for i, j in zip(first, last, strict=True)]):
                    g = [i + k for i, k in zip(first, g, strict=True)]
                    c = [(max(x, i * b), min(x + n, (i + 1) * b)) for x, n, i, b in zip(lo, a.shape, g, block, strict=True)]
                    part = a[tuple(slice(p - x, q - x) for (p, q), x in zip(c, lo, strict=True))]
                    rows.append((r.tp, r.setup, r.level + up, *g, *[p for p, _ in c], *part.shape, r.dtype, encode(part, r.dtype)))
            yield pd.DataFrame(rows, columns=NAMES)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo = [int(g) * b for g, b in zip(key[3:], block, strict=True)]  # what is missing is 0
        hi = [int((pdf[f"o{x}"] + pdf[f"s{x}"]).max()) for x in "xyz"]
        dtype = pdf["dtype"].iat[0]
        a = np.zeros([h - x for h, x in zip(hi, lo, strict=True)], NUMPY[dtype])
        for r in pdf.itertuples(index=False):
            at = tuple(slice(o - x, o - x + n) for o, n, x in zip((r.ox, r.oy, r.oz), (r.sx, r.sy, r.sz), lo, strict=True))
            a[at] = decode(r.payload, dtype, (r.sx, r.sy, r.sz))
        return pd.DataFrame([(*key, *lo, *a.shape, dtype, a.tobytes())], columns=NAMES)

    return chunks.select(*NAMES).mapInPandas(cut, SCHEMA).groupBy(*KEY).applyInPandas(join, SCHEMA)


def pyramid(chunks: DataFrame, relative: list[tuple[int, int, int]], block=(64, 64, 64), store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """All levels; ``relative`` holds each level's factors against the one before, the first is full resolution. Each level is
    written by ``store`` and the next one made of what it reads back."""
    out = level = store(chunks)
    for f in relative[1:]:
        level = store(downsampled(level, f, block))
        out = out.unionByName(level)
    return out


def write_pyramid(chunks: DataFrame, path: str, factors: list[tuple[int, int, int]], block=(64, 64, 64), codec: str = "zstandard", level: int | None = None, sizes: dict[tuple[int, int], tuple] | None = None) -> None:
    """All levels at ``path``, a chunk table or a container, each made of the stored one before; ``factors`` are against
    full resolution."""
    if is_container(path):
        write_container(chunks, path, factors, block, codec, level, list(sizes) if sizes else None, sizes=sizes)
        return
    write(chunks, path, codec, "append", level)
    for i, f in enumerate(options.relative_factors(factors)[1:]):
        write(downsampled(read(chunks.sparkSession, path, i), f, block), path, codec, "append", level)


def to_voxels(chunks: DataFrame) -> DataFrame:
    """One row per voxel: (tp, setup, level, x, y, z, v)."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                a = decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))
                x, y, z = (i.ravel() for i in np.indices(a.shape))
                yield pd.DataFrame({"tp": r.tp, "setup": r.setup, "level": r.level, "x": x + r.ox, "y": y + r.oy, "z": z + r.oz, "v": a.ravel().astype(float)})

    return chunks.select(*NAMES).mapInPandas(explode, "tp int, setup long, level int, x long, y long, z long, v double")


# --- containers of arrays ----------------------------------------------------------------------------------------


def write_zarr(chunks: DataFrame, path: str, block, codec: str = "gzip", level: int | None = None) -> None:
    """One array per (tp, setup, level) at ``path``/tp/setup/level, along x, y, z."""
    arrays.write(rechunked(chunks, block), path, "zarr", block, codec, level)


def read_zarr(spark: SparkSession, path: str, tp: int, setup: int, level: int = 0) -> DataFrame:
    """Chunks of one array; chunks that are not there are missing (all fill value)."""
    return read_zarr_arrays(spark, path, [(tp, setup, level)])


def read_zarr_arrays(spark: SparkSession, path: str, wanted: list[tuple[int, int, int]]) -> DataFrame:
    """Chunks of the arrays (tp, setup, level) below ``path``, in one scan."""
    return arrays.read(spark, path, wanted, arrays.layout_of(path))


def is_container(path: str) -> bool:
    """Whether a path is an N5 or zarr container; a chunk table else. HDF5 is refused."""
    try:
        kind = options.storage_format(path)
    except ValueError:
        return False
    if kind == "HDF5":
        raise ValueError("HDF5 images are not read or written here; resave them as N5 or zarr")
    return kind in ("N5", "ZARR")


def read_images(spark: SparkSession, path: str, views: list[tuple[int, int]], level: int | None = 0, levels: int = 1, box: tuple | None = None) -> DataFrame:
    """The chunks of a level (of all ``levels`` for None) of the views, from a chunk table or a container; only those that
    touch ``box`` (at that level, inclusive) if it is given."""
    if is_container(path):
        return arrays.read(spark, path, [(t, s, i) for t, s in views for i in (range(levels) if level is None else [level])], arrays.layout_of(path), box)
    df = read(spark, path, level)
    if box is not None:
        for x, low, high in zip("xyz", *box, strict=True):
            df = df.filter((F.col(f"o{x}") <= high) & (F.col(f"o{x}") + F.col(f"s{x}") > low))
    return df


def _views(chunks: DataFrame) -> list[tuple[int, int]]:
    return [(r["tp"], r["setup"]) for r in chunks.select("tp", "setup").distinct().collect()]  # one row per image


def write_container(chunks: DataFrame, path: str, factors: list[tuple[int, int, int]], block=(64, 64, 64), codec: str = "zstandard", level: int | None = None, views: list[tuple[int, int]] | None = None, layout: str | None = None, counts: tuple[int, int] | None = None, sizes: dict[tuple[int, int], tuple] | None = None) -> None:
    """A pyramid of arrays with ``factors`` against full resolution, each level made of the stored one before; the files that
    make it an image come with the last level. ``chunks`` lie on the grid of ``block``; ``sizes`` of full resolution
    by (tp, setup) are needed where chunks of zeros may be missing."""
    spark, steps = chunks.sparkSession, options.relative_factors(factors)
    layout = layout or arrays.layout_of(path, "ngff-views")
    views = _views(chunks) if views is None else views
    for i, step in enumerate(steps):
        part = chunks if i == 0 else downsampled(arrays.read(spark, path, [(t, s, i - 1) for t, s in views], layout), step, block)
        attributes = _group(layout, views, factors) if i + 1 == len(steps) else None
        shapes = {v: [max(1, n // f) for n, f in zip(size, factors[i], strict=True)] for v, size in (sizes or {}).items()}
        arrays.write(part, path, layout, block, codec, level, counts, shapes, attributes)


def _group(layout: str, views: list[tuple[int, int]], factors) -> dict:
    from volumetra.sources.container import multiscales

    if layout == "n5":
        return arrays.n5_attributes(views, factors)
    image = multiscales({"levels": [{"factors": list(f)} for f in factors]}, "image")
    if layout == "ngff":
        return arrays.ngff_attributes(image)
    out: dict = {".zgroup": {"zarr_format": 2}}
    for tp, setup in views if layout == "ngff-views" else []:
        out |= arrays.ngff_attributes(image, arrays.LAYOUTS[layout].of(tp, setup, 0).rsplit("/", 1)[0])
    return out
