"""Suffix-tree scores against a model of plain dictionaries, and that its probabilities are probabilities."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.llm import suffixtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START, RARE = "</s>", "<s>", None


def words_of(text):
    return [(w,) for w in WORD.findall((text or "").translate(LOW))] + [END]


def brute(rows, nodes, min_count, depth, divergence):
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    texts = [words_of(t) for _, t in rows]
    c, every = Counter(), Counter()
    for use, t in zip(learn, texts, strict=True):
        every.update(t)
        if use:
            c.update(t)
    n, v = sum(c.values()), len(c)
    least, least_node = max(min_count, -(-sum(every.values()) // nodes)), max(min_count, -(-n // nodes))
    numbered = {w for w, k in every.items() if k >= least and w != END}
    named = [[w if w in numbered or w == END else RARE for w in t] for t in texts]
    after = [defaultdict(Counter) for _ in range(depth + 1)]  # by length
    for use, t in zip(learn, named, strict=True):
        if use:
            s = [START, *t]
            for i in range(1, len(s)):
                for d in range(1, min(depth, i) + 1):
                    after[d][tuple(s[i - d : i])][s[i]] += 1
    states = [{} for _ in range(depth + 1)]

    def root(w):
        return (c[w] + 1) / (n + v + 1)

    def prob(history, w, name):
        """By the longest state that ends the history."""
        for d in range(min(depth, len(history)), 0, -1):
            if (s := tuple(history[-d:])) in states[d]:
                listed, back = states[d][s]
                return listed[name] if name in listed else back * prob(history[-d + 1 :] if d > 1 else [], w, name)
        return root(w)

    node = {s for s in after[1] if s[0] is not RARE} if depth else set()
    for d in range(1, depth + 1):
        longer = set()
        for s in node:
            total, listed = sum(after[d][s].values()), {x: k for x, k in after[d][s].items() if x is not RARE and k >= least_node}
            longer |= {(*s, x) for x in listed if x != END}
            kinds = sum(k if x is RARE else 1 for x, k in after[d][s].items())
            lower = {x: prob(list(s[1:]), x, x) for x in listed}
            rest, left = total - sum(listed.values()), max(1 - sum(lower.values()), 1e-9)
            apart = sum(k * math.log(k / total / lower[x]) for x, k in listed.items()) + (rest * math.log(rest / total / left) if rest else 0)
            if listed and apart >= divergence * len(listed):
                states[d][s] = {x: (k + kinds * lower[x]) / (total + kinds) for x, k in listed.items()}, max(rest + kinds * left, 1e-9) / (total + kinds) / left
        node = longer
    out = []
    for (i, _), use, t, name in zip(rows, learn, texts, named, strict=True):
        s, total = [START, *name], 0.0
        for j, w in enumerate(t):
            total += math.log10(prob(s[max(0, j + 1 - depth) : j + 1], w, name[j]))
        out.append((i, not use, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(root(w)) for w in t), total))
    return out, sum(map(len, states))


def made(seed, n=150):
    rng = random.Random(seed)
    zipf = [f"W{i}" for i in range(40) for _ in range(1 + 40 // (i + 1))] + ["É", "é", "\xa0", "", "x" * 400]
    phrases = [" ".join(rng.choice(zipf) for _ in range(4)) for _ in range(6)]
    texts = [" ".join(rng.choice(phrases).lower() if rng.random() < 0.4 else rng.choice(zipf) + rng.choice(["", "\n", "\t"]) for _ in range(rng.choice([1, 3, 30]))) for _ in range(n)]
    return [*enumerate(texts), (None, texts[3]), (None, None), (7, None), (8, ""), (8, ""), (9, " \n "), (5, texts[5]), (1000, "one two three " * 3000), (1001, "never0 never1 never1 w1 w2")]


@pytest.mark.parametrize(("nodes", "depth", "divergence", "states"), [(1 << 20, 3, 2.0, True), (150, 3, 0.5, True), (1 << 20, 1, 0.0, True), (5, 2, 2.0, False)])
def test_against_dictionaries(spark, monkeypatch, nodes, depth, divergence, states):
    monkeypatch.setattr(suffixtree, "WORDS", 50)
    monkeypatch.setattr(suffixtree, "KEYS", 500)
    monkeypatch.setattr(suffixtree, "RUN_BYTES", 300)
    rows = made(depth)
    docs = spark.createDataFrame([(i, t, True, 1, "r") for i, t in rows], "doc_id long, text string, learn boolean, row int, word string")
    got = suffixtree.suffix_tree_scores(docs.repartition(3), nodes=nodes, min_count=3, depth=depth, divergence=divergence).collect()
    want, found = brute(rows, nodes, 3, depth, divergence)
    assert not states or found > 20
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert suffixtree.suffix_tree_scores(docs.limit(0)).count() == 0
    none = suffixtree.suffix_tree_scores(docs, learn_on=F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(none)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_each_state_is_a_distribution(spark):
    rows = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("learn", F.lit(True))
    tree, least = suffixtree.learn(docs, suffixtree.counted_words(docs), min_count=3, divergence=0.5)
    words = Counter(w for _, t in rows for w in words_of(t))
    few = sum((k + 1) / (tree.n + tree.v + 1) for w, k in words.items() if w != END and k < least) + 1 / (tree.n + tree.v + 1)
    x = np.array([suffixtree.END, *range(suffixtree.FIRST, len(tree.counts))])
    for d, level in enumerate(tree.levels, 1):
        assert level.state.any()
        for s in np.flatnonzero(level.state):
            open_share = 10 ** tree.logp(np.array([s]), np.array([suffixtree.RARE]), d)[0] * (tree.n + tree.v + 1)
            assert (10 ** tree.logp(np.full(len(x), s), x, d)).sum() + few * open_share == pytest.approx(1, rel=1e-6)


def test_better_than_the_base_on_held_out_rows(spark):
    got = suffixtree.query(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] > got[0] + 0.1 * got[2]
