"""Connected components of view pairs, for independent subsets and for unconnected views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task contracts at a time.
TASK_EDGES = 500_000


def shared(spark: SparkSession) -> str:
    """The folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loops"
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's state with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def contracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (a, b) of one task as stars: each node with the smallest node it is connected to here."""
    edges = [p[["a", "b"]].to_numpy(np.int64) for p in parts]
    ids, at = np.unique(np.concatenate(edges) if edges else np.zeros((0, 2), np.int64), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def components(nodes: DataFrame, edges: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, subset): the smallest id of each node's component. ``nodes`` has id, ``edges`` has a and b; ``store`` writes the
    state of a loop and reads it again.

    Tasks first contract up to TASK_EDGES edges each. Then every round a node takes the smallest label of its neighbours and then the label of that label; labels only fall,
    so the loop ends when their sum stands still, after about the logarithm of the longest path.
    """
    edges = store(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    edges = store(edges.coalesce(tasks).mapInPandas(contracted, "a long, b long"))
    if tasks == 1:  # one task has seen all edges: the stars are the components
        return nodes.select("id").distinct().join(edges.select(F.col("a").alias("id"), F.col("b").alias("s")), "id", "left").select("id", F.coalesce("s", "id").alias("subset"))
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = store(nodes.select("id", F.col("id").alias("subset")).distinct())
    before = None
    while True:
        least = both.join(label.select(F.col("id").alias("b"), F.col("subset").alias("s")), "b").groupBy(F.col("a").alias("id")).agg(F.min("s").alias("s"))
        new = label.join(least, "id", "left").select("id", F.least("subset", F.coalesce("s", "subset")).alias("subset"))
        jump = label.select(F.col("id").alias("subset"), F.col("subset").alias("j"))
        label = store(new.join(jump, "subset", "left").select("id", F.least("subset", F.coalesce("j", "subset")).alias("subset")))
        now = label.agg(F.sum(F.col("subset").cast("decimal(38,0)"))).first()[0]
        if now == before or now is None:
            return label
        before = now
