"""Exact top-k by inner product: one ball tree per shard, searched by branch and bound.

Vectors are quantized to whole numbers, so that scores are exact. Rows are dealt into shards of about ``SHARD_ROWS`` by
a hash of their id; each shard's tree is built once and stored as one binary row. A tree halves its rows along the widest
direction down to leaves of ``LEAF_ROWS``; a node with centre c and radius r can hold no score above q.c + |q| r. Queries
descend together: at each node every query takes the child of its larger bound first, and comes back for the other one
only if that bound still reaches its k-th score, so whole subtrees are left out.

The k-th score is shared: shards are searched in waves, each ``WAVE`` times as many as before, and a wave starts from the
k-th scores of all waves before it; within a task, from those of the shards it has already searched.

Scale: queries lie in blocks of ``BLOCK_QUERIES``, one binary row each, which are copied to the shards of a wave; no shard
is copied (a stated query set against all rows, in blocks). A shard returns at most k rows for each query. Nothing but
counts reaches the driver.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those of which
a quantized component is beyond 2**62; scores outside the range of a long count as its ends; ties go to the smaller id,
repeated ids to either row; of vectors of unequal length the shorter counts as padded with zeros, so that empty ones score 0; extra columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volumetra.llm import scratch

SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, SCALE, WAVE, LONG = 16384, 128, 2048, 1024, 16, 2**63 - 1
#: Query blocks whose k-th scores a task remembers.
REMEMBERED = 1024


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component; rows that take no part are gone."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(2.0**62 / scale)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).cast("array<long>").alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(v) for v in rows), default=0) or 1
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number products; by floating point where no sum can leave its exact range."""
    d = min(q.shape[1], x.shape[1])
    q, x = q[:, :d], x[:, :d]
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -LONG - 1, LONG).astype(np.int64)


class BallTree:
    """A ball tree over integer rows, as arrays: centres, radii, row ranges, and each node's children (0 for leaves)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids, self.x, f = ids, x, x.astype(np.float64)
        order = np.arange(len(ids))
        centres, radii, ranges, children, todo = [], [], [], [], [(0, len(ids), None)]
        while todo:
            begin, end, place = todo.pop()
            me = len(radii)
            if place is not None:
                children[place[0]][place[1]] = me
            rows = f[order[begin:end]]
            centre = rows.mean(axis=0)
            away = ((rows - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max())))
            ranges.append((begin, end))
            children.append([0, 0])
            if end - begin > leaf_rows and radii[me] > 0:
                far = rows[away.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                order[begin:end] = order[begin:end][np.argsort(rows @ (far - other), kind="stable")]
                middle = (begin + end) // 2
                todo += [(begin, middle, (me, 0)), (middle, end, (me, 1))]
        self.ids, self.x = ids[order], x[order]
        self.centres, self.radii, self.ranges, self.children = np.array(centres), np.array(radii), ranges, children
        self.visited = 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's best k of this shard that reach ``kth``, ties by smaller id; ``kth`` rises
        to the k-th score found."""
        d, qf = min(q.shape[1], self.x.shape[1]), q.astype(np.float64)
        q, qf, norm = q[:, :d], qf[:, :d], np.sqrt((qf**2).sum(axis=1))
        # Rounding of the bound itself stays far below this.
        slack = 1e-9 * (1 + np.abs(qf).sum(axis=1)) * (1 + np.abs(self.centres).max(initial=0) + self.radii.max(initial=0)) + 1e-6
        scores, ids = np.full((len(q), k), -LONG - 1, np.int64), np.full((len(q), k), LONG, np.int64)
        none = np.ones((len(q), k), bool)
        bound = lambda node, at: qf[at] @ self.centres[node, :d] + norm[at] * self.radii[node] + slack[at]

        def leaf(node: int, at: np.ndarray) -> None:
            begin, end = self.ranges[node]
            s, i = _products(q[at], self.x[begin:end]), self.ids[begin:end]
            usable = (s >= kth[at, None]) & (i[None, :] != q_ids[at, None])
            some = usable.any(axis=1)
            at, s, usable = at[some], s[some], usable[some]
            if not len(at):
                return
            all_s, all_i = np.concatenate([scores[at], s], axis=1), np.concatenate([ids[at], np.broadcast_to(i, s.shape)], axis=1)
            gone = np.concatenate([none[at], ~usable], axis=1)
            top = _exact_order(all_s, all_i, gone)[:, :k]
            take = lambda v: np.take_along_axis(v, top, axis=1)
            scores[at], ids[at], none[at] = take(all_s), take(all_i), take(gone)
            full = ~none[at, k - 1]
            kth[at[full]] = np.maximum(kth[at[full]], scores[at[full], k - 1])

        todo = [(0, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            at = at[bound(node, at) >= kth[at]]
            if not len(at):
                continue
            self.visited += 1
            left, right = self.children[node]
            if not left:
                leaf(node, at)
                continue
            first = bound(left, at) >= bound(right, at)
            # The last one in is searched first: every query's better child, then the other ones.
            todo += [(n, some) for n, some in ((left, at[~first]), (right, at[first]), (right, at[~first]), (left, at[first])) if len(some)]
        row, place = np.nonzero(~none)
        return row, ids[row, place], scores[row, place]


def _exact_order(scores: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Columns by score (falling) and id, those that are gone last, where scores exceed the exact range of floats."""
    high, low = scores >> 32, scores & 0xFFFFFFFF
    return np.lexsort((ids, -low, -high, gone), axis=1)


def _packed(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the smallest whole-number type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return ids, x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def stored_trees(dealt: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(shard, tree): one binary row per shard of (shard, vec_id, v)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        tree = BallTree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]), leaf_rows)
        tree.ids, tree.x = _packed(tree.ids, tree.x)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)]})

    return dealt.groupBy("shard").applyInPandas(build, "shard int, tree binary")


def stored_blocks(asked: DataFrame) -> DataFrame:
    """(block, queries): one binary row of ids and vectors per block of (block, vec_id, v)."""

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"block": [key[0]], "queries": [pickle.dumps(_packed(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"])))]})

    return asked.groupBy("block").applyInPandas(gather, "block int, queries binary")


FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    """A map over rows (shard, block, data, floors) in the order of shards: a shard's tree, without block, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, kth = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, data = batch.column("block")[i].as_py(), pickle.loads(batch.column("data")[i].as_py())
                if block is None:
                    tree = data
                    tree.x = tree.x.astype(np.int64)
                    continue
                q_ids, q = data
                floors = batch.column("floors")[i].as_py() or ()
                known = {r["query_id"]: r["low"] for r in floors}
                floor = np.array([known.get(x, -LONG - 1) for x in q_ids.tolist()], np.int64)
                floor = np.maximum(floor, kth.pop(block, floor))
                at, ids, scores = tree.search(q_ids, q.astype(np.int64), floor, k)
                kth[block] = floor
                if len(kth) > REMEMBERED:
                    kth.pop(next(iter(kth)))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


@contextmanager
def _few_rows_a_batch(spark: SparkSession, rows: int = 32):
    """Rows of megabytes go to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The operator: (query_id, rank, vec_id, score) for the rows for which ``queries`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    rows = scratch.table(quantized(vectors, id_col, vector_col, scale), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-rows.filter(queries).count() // BLOCK_QUERIES))
    place = lambda salt, m, of="vec_id": F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(m)).cast("int")
    trees = scratch.table(stored_trees(rows.withColumn("shard", place("shard", shards)), leaf_rows), "trees")
    asked = scratch.table(rows.filter(queries).withColumn("block", place("block", blocks)), "asked")
    packed = scratch.table(stored_blocks(asked), "blocks")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    found, begin, size = None, 0, 1
    while begin < shards:
        end = min(shards, begin + size)
        floors = F.lit(None).cast("array<struct<query_id:long,low:long>>")
        wave = packed.withColumn("floors", floors)
        if found is not None:
            # At most BLOCK_QUERIES or so in a list.
            low = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k)
            low = low.withColumn("at", place("block", blocks, "query_id")).groupBy("at").agg(F.collect_list(F.struct("query_id", "low")).alias("floors"))
            wave = packed.join(low, F.col("block") == F.col("at"), "left").select("block", "queries", "floors")
        wave = wave.select(F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("shard"), "block", F.col("queries").alias("data"), "floors")
        mine = trees.filter((F.col("shard") >= begin) & (F.col("shard") < end)).select("shard", F.lit(None).cast("int").alias("block"), F.col("tree").alias("data"), floors.alias("floors"))
        met = mine.unionAll(wave).repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
        new = met.mapInArrow(_search(k), FOUND)
        with _few_rows_a_batch(spark):
            found = scratch.table(ranked(new if found is None else found.unionAll(new)).select("query_id", "vec_id", "score"), "found")
        begin, size = end, size * WAVE
    if found is None:
        found = scratch.table(rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), "found")
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
