"""Option values: lists of ids, vectors, view ids, pyramids, and the rules between options."""

from __future__ import annotations


def ids(text: str | None) -> list[int] | None:
    """A comma list of ids; None, meaning all, if blank."""
    if text is None or not text.strip():
        return None
    return [int(x) for x in text.split(",")]


def vector(text: str, size: int = 3, kind=int) -> tuple:
    """A comma list of numbers."""
    out = tuple(kind(x) for x in text.split(","))
    if len(out) != size:
        raise ValueError(f"{text!r} has {len(out)} numbers, not {size}")
    return out


def view_ids(texts: list[str] | None) -> list[tuple[int, int]] | None:
    """'timepoint,setup' each."""
    return None if not texts else [vector(t, 2) for t in texts]


def pyramid(text: str | None, absolute: bool = True) -> list[tuple[int, int, int]] | None:
    """'1,1,1;2,2,1;...': factors of each level; absolute ones start with 1,1,1."""
    if not text:
        return None
    levels = [vector(t) for t in text.split(";")]
    if absolute and not is_full_resolution(levels[0]):
        raise ValueError("the first level has to be 1,1,1")
    return levels


def is_full_resolution(factors) -> bool:
    return all(f == 1 for f in factors)


def propose_pyramid(size, voxel=(1.0, 1.0, 1.0), smallest: int = 64) -> list[tuple[int, int, int]]:
    """Halve the axes whose voxels are the finest until the image has at most ``smallest`` cells along every axis."""
    levels, factor = [(1, 1, 1)], [1, 1, 1]
    while max(s / f for s, f in zip(size, factor, strict=True)) > smallest:
        step = [v * f for v, f in zip(voxel, factor, strict=True)]
        limit = min(t for t, s, f in zip(step, size, factor, strict=True) if s / f > 1)
        halve = [t < 2 * limit and s / f > 1 for t, s, f in zip(step, size, factor, strict=True)]
        factor = [f * 2 if h else f for f, h in zip(factor, halve, strict=True)]
        levels.append(tuple(factor))
    return levels


def pyramid_levels(automatic: bool, manual: str | None, size) -> list[tuple[int, int, int]]:
    """One of automatic and manual at most; full resolution alone without either."""
    if automatic and manual:
        raise ValueError("a pyramid is either automatic or given")
    return propose_pyramid(size) if automatic else pyramid(manual) or [(1, 1, 1)]


def one_selection(explicit: list | None, **attributes: list | None) -> None:
    """Explicit view ids exclude attribute lists."""
    if explicit and any(attributes.values()):
        raise ValueError("explicit view ids cannot be combined with attribute lists")


def fusion_indices(timepoint: int | None, channel: int | None, filtered: bool) -> None:
    """Both indices or neither; view filters only with them."""
    if (timepoint is None) != (channel is None):
        raise ValueError("timepoint and channel index belong together")
    if filtered and timepoint is None:
        raise ValueError("view filters need a timepoint and a channel index")


def exactly_one(**given) -> str:
    """The name of the one option that is set."""
    names = [k for k, v in given.items() if v is not None]
    if len(names) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} is needed")
    return names[0]


def storage_format(path: str) -> str:
    """The storage format that a path's ending names."""
    for ending, name in ((".zarr", "ZARR"), (".n5", "N5"), (".h5", "HDF5"), (".hdf5", "HDF5"), (".parquet", "PARQUET")):
        if path.rstrip("/").lower().endswith(ending):
            return name
    raise ValueError(f"the ending of {path!r} names no storage format")


CODECS = ("lz4", "gzip", "zstandard", "blosc", "bzip2", "xz", "raw")
#: Parquet's name and default level for each codec; those it lacks map to the nearest it has.
PARQUET_CODECS = {"lz4": "lz4raw", "gzip": "gzip", "zstandard": "zstd", "blosc": "zstd", "bzip2": "gzip", "xz": "zstd", "raw": "none"}
DEFAULT_LEVELS = {"gzip": 1, "zstandard": 3, "xz": 6}


def parquet_codec(name: str) -> str:
    if name.lower() not in PARQUET_CODECS:
        raise ValueError(f"no codec {name!r}; there are {', '.join(CODECS)}")
    return PARQUET_CODECS[name.lower()]


def parquet_level(codec: str, level: int) -> dict[str, str]:
    """The writer's option for a codec's level; an error for codecs without one."""
    names = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}
    if parquet_codec(codec) not in names:
        raise ValueError(f"{codec} has no level")
    return {names[parquet_codec(codec)]: str(level)}


def block_name(low, high) -> str:
    """A name made of a box."""
    return "_".join(str(x) for x in (*low, *high)).replace("-", "m")


def relative_factors(levels) -> list[tuple[int, ...]]:
    """Each level's factors relative to the level before; 1 and 2 are supported."""
    out = [tuple(levels[0])]
    for a, b in zip(levels, levels[1:]):
        step = tuple(y // x for x, y in zip(a, b, strict=True))
        if any(y % x or s not in (1, 2) for x, y, s in zip(a, b, step, strict=True)):
            raise ValueError(f"level {b} is not one or two times {a} along each axis")
        out.append(step)
    return out
