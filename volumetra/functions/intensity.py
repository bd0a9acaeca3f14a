"""Intensities: storage types, unsigned numbers, and rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark types that hold each pixel type; unsigned ones are widened.
PIXEL_TYPES = {"UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "FLOAT32": "float", "FLOAT64": "double"}
FULL_RANGE = {"UINT8": 255, "UINT16": 65535}


def spark_type(pixel_type: str) -> str:
    if pixel_type.upper() not in PIXEL_TYPES:
        raise ValueError(f"no pixel type {pixel_type!r}; there are {', '.join(PIXEL_TYPES)}")
    return PIXEL_TYPES[pixel_type.upper()]


def rescale(v: Column, low: float, high: float, pixel_type: str) -> Column:
    """[low, high] onto the whole range of an unsigned type, rounded half up and clamped; FLOAT32 stays as it is."""
    if pixel_type == "FLOAT32":
        return v.cast("float")
    top = FULL_RANGE[pixel_type]
    scaled = F.floor((v - F.lit(low)) * F.lit(float(top)) / F.lit(float(high - low)) + F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(top), scaled)).cast(spark_type(pixel_type))


def mask_value(pixel_type: str) -> float:
    """What a mask holds where there is an image."""
    return float(FULL_RANGE.get(pixel_type, 1))


def as_unsigned16(v: Column) -> Column:
    """A signed 16-bit number read as unsigned."""
    return F.pmod(v.cast("int"), F.lit(65536))


def as_signed16(v: Column) -> Column:
    """The way back."""
    return F.when(v >= 32768, v - 65536).otherwise(v).cast("smallint")
