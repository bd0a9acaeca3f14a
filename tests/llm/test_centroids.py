"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from volumetra.llm import centroids


def brute(rows, k=8, rounds=10, seed=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(x) * 1024) for x in v], v))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    middle = [r[1] for r in start[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, q, _ in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        middle = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(middle)]
    found = [(i, *nearest(q)) for i, q, _ in kept]
    within = {j: sum(f for _, f, c in found if c == j) for j in range(k)}
    top = 2**63 - 1
    return [(i, c, min(f, top), min(within[c], top), min(sum(within.values()), top), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, f, c in found]


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def check(spark, rows, **options):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids int")
    got = [tuple(r) for r in centroids.cluster(table, **options).collect()]
    options.pop("block_rows", None)
    assert sorted(got, key=key) == sorted(brute(rows, **options), key=key)
    return got


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_against_plain_integers(spark, block_rows):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0, 0.25, 1 / 3, rng.gauss(0, 1)]) for _ in range(5)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(5, rows[9][1]), (5, rows[8][1]), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [0.0] * 6), (304, [0.0, None, 0, 0, 0]), (305, [math.nan, 0, 0, 0, 0]), (306, [0, math.inf, 0, 0, 0])]
    assert len(check(spark, rows, k=6, rounds=4, dims=5, block_rows=block_rows)) == 183


def test_any_finite_component_counts_exactly(spark):
    rng = random.Random(5)
    sizes = [1.0, 1e6, 1e18, 1e30, 1e308, -1e308, 5e-324]
    rows = [(i, [rng.choice(sizes) * rng.random() for _ in range(3)]) for i in range(60)] + [(i, [0.5, 2.0**17, -(2.0**18)]) for i in range(60, 70)]
    check(spark, rows, k=5, rounds=3, dims=3, block_rows=16)
    check(spark, rows[60:] + [(i, [0.1 * i, 1.0, 2.0**50]) for i in range(9)], k=5, rounds=3, dims=3)


def test_few_and_no_vectors(spark):
    assert len(check(spark, [(i, [float(i), 0.0]) for i in range(3)], k=8, rounds=2, dims=2)) == 3
    check(spark, [(1, [1.0, 2.0])] * 9 + [(2, [1.0, 2.0])] * 3, k=4, rounds=2, dims=2)  # ties: all in cluster 0, others stay empty
    assert check(spark, [], k=4, rounds=2, dims=2) == []
    assert check(spark, [(1, None), (2, [1.0])], k=4, rounds=2, dims=2) == []


def test_blocks_are_kept_as_stored():
    rng = np.random.default_rng(2)
    q = rng.integers(-50, 50, (300, 9))
    for x in (q, q.astype(object) * 10**30):
        block = centroids.Block.read(*centroids.Block.of(x).stored())
        assert all((block.values[d][block.codes[d]] == x[:, d]).all() for d in range(9))
    for x in (0, 1, -1, 2**32, -(2**32), 2**64 + 5, -(10**40), 10**40):
        assert sum(v << (32 * i) for i, v in centroids._limbs(x)) == x
    with pytest.raises(ValueError):
        centroids.stored_blocks(None, 3, block_rows=65537)
