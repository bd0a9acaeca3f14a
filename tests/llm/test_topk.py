import math

from pyspark.sql import functions as F

import numpy as np

from volumetra.llm import topk
from volumetra.llm.topk import BallTree, top_k


def brute(rows, k):
    ok = {i: [math.floor(1024 * float(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, shard int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, **kw).collect())


def test_against_brute_force_with_ties_and_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 1200)]  # one vector a great many times
    rows += [(1301, None), (1302, []), (1303, [1.0, None]), (1304, [float("nan")] * 6), (1305, [float("inf")] * 6)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, shard_rows=200, leaf_rows=16) == brute(rows, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [0.5, -1.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_tree_skips_leaves():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 4)) * 10 + c for c in ([1000, 0, 0, 0], [0, 1000, 0, 0], [-1000, 0, 0, 0])]).astype(np.int64)
    tree = BallTree(np.arange(1500), x, 50)
    q = np.array([[1, 0, 0, 0]])
    at, ids, scores = tree.search(np.array([-1]), q, np.array([-np.inf]), 5)
    want = sorted((-int(x[i, 0]), i) for i in range(1500))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want


def test_components_and_scores_beyond_a_long(spark):
    rows = [(0, [1e18, 0.0]), (100, [3e9, 1.0]), (1, [2e9, -1.0]), (2, [-3e9, 5.0]), (3, [0.5, 0.5]), (4, [1e15, 2.0]), (5, [-1e15, 0.0])]
    got = run(spark, rows)
    assert {r[0] for r in got} == {100} and all(r[2] != 0 for r in got)  # 1e18 * 1024 is beyond 2**62
    exact = {c: sum(math.floor(1024 * float(np.float32(a))) * math.floor(1024 * float(np.float32(b))) for a, b in zip(dict(rows)[100], v)) for c, v in rows[2:]}
    want = sorted((-max(-(2**63), min(2**63 - 1, s)), c) for c, s in exact.items())
    assert [(-r[3], r[2]) for r in got] == want


def test_descent_leaves_subtrees_out():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(64, 3))[rng.integers(0, 64, 6400)] * 1000 + rng.normal(size=(6400, 3))).astype(np.int64)
    tree = BallTree(np.arange(6400), x, 32)
    q = (rng.normal(size=(3, 3)) * 100).astype(np.int64)
    at, ids, scores = tree.search(np.array([-1, -2, -3]), q, np.full(3, -(2**63), np.int64), 5)
    for i in range(3):
        assert sorted(zip(-scores[at == i], ids[at == i])) == sorted(zip(-(x @ q[i]), range(6400)))[:5]
    assert tree.visited < len(tree.radii) / 2
    before = tree.visited
    floor = np.array([scores[at == i].min() for i in range(3)])
    again = tree.search(np.array([-1, -2, -3]), q, floor.copy(), 5)
    assert sorted(again[2]) == sorted(scores) and tree.visited - before <= before


def test_shards_are_not_multiplied_by_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(7)
    rows = [(100 * i if i < 40 else 100 * i + 1, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(600)]
    built = []
    real = topk.stored_trees
    monkeypatch.setattr(topk, "stored_trees", lambda dealt, leaf_rows: built.append(real(dealt, leaf_rows)) or built[0])
    assert run(spark, rows, shard_rows=100, leaf_rows=16) == brute(rows, 10)
    assert built[0].count() == 6


def test_empty_vectors_score_zero(spark):
    got = sorted(run(spark, [(0, []), (100, [1.0, 0.5]), (1, [-1.0]), (2, []), (3, None)]))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 2, 0), (100, 3, 1, -(1024**2))]
    assert sorted(run(spark, [(0, []), (1, [])])) == [(0, 1, 1, 0)]
