"""Centroid clustering of whole-number vectors with exact arithmetic, by scalar lookup tables.

Vectors are quantized once and stored in blocks of about ``BLOCK_ROWS``: for each dimension the integer values that occur in
the block, in order, and for each vector the place of its value among them. A round tabulates the squared difference for
each dimension, occurring value and centroid; distances are sums of rows gathered from these tables with numpy. New
centroids come from counts: how often each value occurs in a cluster, times the value.

Scale: a round is one pass over the stored blocks. A task sends k x (dimensions + 2) numbers, summed by partial
aggregation, so the driver sees that many rows a round; centroids travel in the function's closure. No vector is shuffled,
and no key can be hot. Blocks lie in the shared folder, so that a lost executor costs its tasks alone.

Exactness: sums travel as 32-bit limbs, and where squares could leave 64 bits a block's tables hold Python integers, so that
any finite component counts. What does not fit in a long in the result is given as the long's end.

Defined results: vectors take no part that are null, of another length, or hold null or non-finite components; a null id
hashes as an empty string; repeated ids are vectors of their own (starting centroids: in the order of their components);
with fewer vectors than k each one starts a centroid; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import scratch

BLOCK_ROWS, SCALE = 8192, 1024
COUNT, INERTIA = -1, -2
LONG = 2**63 - 1
BLOCKS = "ids array<bigint>, sizes binary, whole boolean, vals binary, codes binary"
PARTS = "cluster int, dim int, limb int, value long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def quantized(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where one is beyond 2**62; ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    out = np.empty(y.size, object)
    out[:] = [int(v) if math.isfinite(v) else int(w) * scale for v, w in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return out.reshape(y.shape)


class Block:
    """Vectors as places among the values that occur in each dimension."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, q: np.ndarray) -> Block:
        found = [np.unique(q[:, d], return_inverse=True) for d in range(q.shape[1])]
        return cls([v for v, _ in found], np.array([c for _, c in found]).reshape(q.shape[1], len(q)))

    def stored(self) -> tuple[bytes, bool, bytes, bytes]:
        """Sizes, whether values are 64-bit integers, values, codes of 16 bits."""
        sizes = np.array([len(v) for v in self.values], "<i4").tobytes()
        whole = all(v.dtype != object for v in self.values)
        flat = np.concatenate(self.values) if self.values else np.zeros(0, np.int64)
        return sizes, whole, flat.astype("<i8").tobytes() if whole else ",".join(map(str, flat)).encode(), self.codes.astype("<u2").tobytes()

    @classmethod
    def read(cls, sizes: bytes, whole: bool, vals: bytes, codes: bytes) -> Block:
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        if whole:
            flat = np.frombuffer(vals, "<i8")
        else:
            flat = np.empty(int(ends[-1]), object)
            flat[:] = [int(x) for x in vals.split(b",")]
        return cls(np.split(flat, ends[:-1]), np.frombuffer(codes, "<u2").reshape(len(ends), -1))

    def distances(self, centroids: list[list[int]]) -> np.ndarray:
        """Squared distances, a row for each vector and a column for each centroid."""
        most = max(max(abs(int(v[0])), abs(int(v[-1]))) for v in self.values)
        most = max(most, max(abs(x) for c in centroids for x in c))
        kind = np.int64 if 4 * most * most * len(self.values) < 2**62 else object
        total = np.zeros((self.codes.shape[1], len(centroids)), kind)
        for d, (values, codes) in enumerate(zip(self.values, self.codes, strict=True)):
            apart = values.astype(kind)[:, None] - np.array([c[d] for c in centroids], kind)[None, :]
            total += (apart * apart)[codes]
        return total

    def sums(self, labels: np.ndarray, k: int) -> list[list[int]]:
        """The sum of each cluster's vectors."""
        out = []
        for values, codes in zip(self.values, self.codes, strict=True):
            u = len(values)
            times = np.bincount(labels * u + codes, minlength=k * u).reshape(k, u)
            small = values.dtype != object and max(abs(int(values[0])), abs(int(values[-1]))) * len(labels) < 2**62
            out.append((times @ values if small else times.astype(object) @ values.astype(object)).tolist())
        return [list(c) for c in zip(*out, strict=True)]


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    i = 0
    while not -(2**32) < x < 2**32:
        yield i, x & 0xFFFFFFFF
        x, i = x >> 32, i + 1
    yield i, x


def _store(dims: int, scale: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0

        def block() -> pa.RecordBatch:
            x, kept = np.concatenate(rows), pa.chunked_array(ids).combine_chunks()
            row = Block.of(quantized(x, scale)).stored()
            listed = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([v], t) for v, t in zip(row, (pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True))], ["ids", "sizes", "whole", "vals", "codes"])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            at = 0
            while at < len(x):
                part = min(block_rows - n, len(x) - at)
                ids.append(batch.column(0).slice(at, part))
                rows.append(x[at : at + part])
                at, n = at + part, n + part
                if n == block_rows:
                    yield block()
                    ids, rows, n = [], [], 0
        if n:
            yield block()

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Block]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].values, Block.read(*(batch.column(j)[i].as_py() for j in range(1, 5)))


def stored_blocks(vectors: DataFrame, dims: int, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, v) as a stored table of blocks; codes have 16 bits, so a block has 65536 rows at most."""
    if not 0 < block_rows <= 65536:
        raise ValueError("block_rows must be from 1 to 65536")
    return scratch.table(vectors.select("vec_id", "v").mapInArrow(_store(dims, scale, block_rows), BLOCKS), "blocks")


def totals(blocks: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """The sum of each (cluster, dimension), with the cluster's size at COUNT and its squared distances at INERTIA."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, block in _read(batch):
                far = block.distances(centroids)
                labels = far.argmin(axis=1).astype(np.int64)
                least = np.take_along_axis(far, labels[:, None], 1)[:, 0].astype(object)
                sums, sizes = block.sums(labels, k), np.bincount(labels, minlength=k)
                for c in np.flatnonzero(sizes).tolist():
                    row = {COUNT: int(sizes[c]), INERTIA: int(least[labels == c].sum()), **dict(enumerate(sums[c]))}
                    for d, v in row.items():
                        found[c, d] = found.get((c, d), 0) + v
        rows = [(c, d, i, v) for (c, d), x in found.items() for i, v in _limbs(x)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "limb", "value"])

    out: dict[tuple[int, int], int] = {}
    # k x (dimensions + 2) rows, for each limb.
    for r in blocks.mapInArrow(run, PARTS).groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["cluster"], r["dim"]] = out.get((r["cluster"], r["dim"]), 0) + (r["value"] << (32 * r["limb"]))
    return out


@dataclass
class Model:
    """Centroids with the size and the inertia of their clusters."""

    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int = SCALE) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    rows = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)).orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in quantized(np.array(r["v"], np.float64), scale)] for r in rows]


def fit(blocks: DataFrame, centroids: list[list[int]], rounds: int) -> Model:
    """Rounds of assignment to the nearest centroid and its replacement by the floor of its vectors' mean."""
    for _ in range(rounds if centroids else 0):
        t = totals(blocks, centroids)
        centroids = [[t[c, d] // t[c, COUNT] for d in range(len(old))] if (c, COUNT) in t else old for c, old in enumerate(centroids)]
    t = totals(blocks, centroids) if centroids else {}
    return Model(centroids, *([t.get((c, what), 0) for c in range(len(centroids))] for what in (COUNT, INERTIA)))


def assigned(blocks: DataFrame, model: Model) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids]
    inertias, whole = [min(x, LONG) for x in model.inertias], min(sum(model.inertias), LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shown = np.array(inertias, np.int64), pa.array(names, pa.string())
        for batch in batches:
            for ids, block in _read(batch):
                far = block.distances(model.centroids)
                labels = far.argmin(axis=1).astype(np.int64)
                least = np.minimum(np.take_along_axis(far, labels[:, None], 1)[:, 0], LONG).astype(np.int64)
                columns = [ids, pa.array(labels.astype(np.int32)), pa.array(least), pa.array(sums[labels]), pa.array(np.full(len(labels), whole)), shown.take(pa.array(labels))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return blocks.mapInArrow(run, RESULT)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The operator: each kept vector with its cluster."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v"), dims))
    blocks = stored_blocks(rows, dims, scale, block_rows)
    return assigned(blocks, fit(blocks, first_centroids(rows, k, seed, scale), rounds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = 10) -> str:
    """The rounds one after another: c, the centroids in long form, f, each vector's nearest."""

    def nearest(i: int) -> str:
        return f"""f{i} AS MATERIALIZED (SELECT vec_id, (min(far * 8 + c) % 8)::INTEGER AS c, min(far * 8 + c) // 8 AS far FROM
  (SELECT v.vec_id, c, sum((v.x - c{i}.x) * (v.x - c{i}.x)) AS far FROM v JOIN c{i} USING (d) GROUP BY ALL) GROUP BY vec_id)"""

    steps = []
    for i in range(rounds):
        steps.append(nearest(i))
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.d, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN
  (SELECT c, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM f{i} JOIN v USING (vec_id) GROUP BY c, d) m
  ON m.c = c{i}.c AND m.d = c{i}.d)""")
    rest = ",\n".join([*steps, nearest(rounds)])
    return f"""
WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, d, floor(1024 * e[d]::DOUBLE)::BIGINT AS x FROM k, range(1, 65) AS r(d)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c FROM k QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, d, x FROM s JOIN v USING (vec_id)),
{rest},
h AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, f.c AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
       (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
FROM f{rounds} f JOIN h ON h.c = f.c
"""


SQL = _sql()
