"""Compression of blocks of arrays, and how N5 and zarr metadata name it."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib

#: Names of the codecs as commands give them, and their default levels where they have one.
NAMES = {"raw": "raw", "gzip": "gzip", "zstandard": "zstd", "lz4": "lz4", "bzip2": "bzip2", "xz": "xz"}
LEVELS = {"gzip": 1, "zstd": 3, "xz": 6, "bzip2": 9}
# Fixed values of the framed LZ4 stream: its mark, its methods with a block size of 64 KiB, the seed and mask of its checksum.
LZ4_MARK, LZ4_RAW, LZ4_PACKED, LZ4_BLOCK, LZ4_SEED, LZ4_MASK = b"LZ4Block", 0x16, 0x26, 65536, 0x9747B28C, 0x0FFFFFFF


def named(codec: str) -> str:
    if codec.lower() not in NAMES:
        raise ValueError(f"blocks of arrays are not compressed by {codec!r} here, but by {', '.join(NAMES)}")
    return NAMES[codec.lower()]


def _lz4(data: bytes) -> bytes:
    import pyarrow as pa
    import xxhash

    out = []
    for i in range(0, len(data), LZ4_BLOCK):
        part = data[i : i + LZ4_BLOCK]
        packed = pa.compress(part, "lz4_raw", asbytes=True)
        method, body = (LZ4_PACKED, packed) if len(packed) < len(part) else (LZ4_RAW, part)
        out += [LZ4_MARK, struct.pack("<BIII", method, len(body), len(part), xxhash.xxh32_intdigest(part, LZ4_SEED) & LZ4_MASK), body]
    return b"".join([*out, LZ4_MARK, struct.pack("<BIII", LZ4_RAW, 0, 0, 0)])


def _un_lz4(data: bytes) -> bytes:
    import pyarrow as pa

    out, at = [], 0
    while at < len(data):
        if data[at : at + 8] != LZ4_MARK:
            raise ValueError("not a framed LZ4 stream")
        method, packed, size, _ = struct.unpack_from("<BIII", data, at + 8)
        body = data[at + 21 : at + 21 + packed]
        if not size:
            break
        out.append(body if method & 0xF0 == 0x10 else pa.decompress(body, size, "lz4_raw", asbytes=True))
        at += 21 + packed
    return b"".join(out)


def compress(data: bytes, codec: str, level: int | None = None) -> bytes:
    level = LEVELS.get(codec) if level is None else level
    if codec == "gzip":
        return gzip.compress(data, level, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    if codec == "bzip2":
        return bz2.compress(data, level)
    if codec == "xz":
        return lzma.compress(data, preset=level)
    if codec == "lz4":
        return _lz4(data)
    if codec == "lz4raw":
        import pyarrow as pa

        return struct.pack("<I", len(data)) + pa.compress(data, "lz4_raw", asbytes=True)
    return data


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return zlib.decompressobj(47).decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "bzip2":
        return bz2.decompress(data)
    if codec == "xz":
        return lzma.decompress(data)
    if codec == "lz4":
        return _un_lz4(data)
    if codec == "lz4raw":
        import pyarrow as pa

        return pa.decompress(data[4:], struct.unpack("<I", data[:4])[0], "lz4_raw", asbytes=True)
    return data


def n5_entry(codec: str, level: int | None) -> dict:
    """The compression entry of an N5 dataset."""
    level = LEVELS.get(codec) if level is None else level
    more = {"gzip": {"level": level, "useZlib": False}, "zstd": {"level": level}, "xz": {"preset": level}, "bzip2": {"blockSize": level}, "lz4": {"blockSize": LZ4_BLOCK}}
    return {"type": codec} | more.get(codec, {})


def n5_codec(entry: dict | str) -> str:
    """The codec of an entry; ``compressionType`` of old datasets is a plain string."""
    kind = entry if isinstance(entry, str) else entry["type"]
    if kind not in NAMES.values():
        raise ValueError(f"no codec for {kind!r} blocks")
    return kind


def zarr_entry(codec: str, level: int | None) -> dict | None:
    """The compressor entry of a zarr array, version 2; LZ4 blocks are plain there, behind their size."""
    level = LEVELS.get(codec) if level is None else level
    return {"raw": None, "gzip": {"id": "gzip", "level": level}, "zstd": {"id": "zstd", "level": level}, "bzip2": {"id": "bz2", "level": level}, "xz": {"id": "lzma", "format": 1, "check": -1, "preset": level, "filters": None}, "lz4": {"id": "lz4", "acceleration": 1}}[codec]


def zarr_codec(entry: dict | None) -> str:
    kind = (entry or {"id": "raw"})["id"]
    known = {"raw": "raw", "gzip": "gzip", "zlib": "gzip", "zstd": "zstd", "bz2": "bzip2", "lzma": "xz", "lz4": "lz4raw"}
    if kind not in known:
        raise ValueError(f"no codec for {kind!r} chunks")
    return known[kind]
