"""Points as comma-separated lines ``x,y,z``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
LINE = f"^{_NUMBER},{_NUMBER},{_NUMBER}$"


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, bad lines) of a column ``value``; blank lines are neither."""
    lines = lines.filter(F.trim("value") != "")
    good = lines.filter(F.col("value").rlike(LINE))
    parts = F.split("value", ",")
    points = good.select(*[F.trim(parts[i]).cast("double").alias(x) for i, x in enumerate("xyz")])
    return points, lines.filter(~F.col("value").rlike(LINE))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parsed(spark.read.text(path))


def from_literals(spark: SparkSession, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    return parsed(spark.createDataFrame([(t,) for t in texts], "value string"))


def write(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(",", "x", "y", "z")).write.text(path)
