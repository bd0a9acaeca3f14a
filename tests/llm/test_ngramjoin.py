import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from volumetra.llm import ngramjoin
from volumetra.llm.ngramjoin import connected, forest, prefix_length, similar, similarity_classes
from volumetra.operators import graph


def brute(rows):
    """{doc_id: (class_id, n_copies, n_links)}; ids are distinct."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, copies = {}, Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = (frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), tuple(w))
        copies[tuple(w)] += 1
    links, parent = defaultdict(int), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a][0], sets[b][0]
            if x and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (find(i), copies[sets[i][1]] if sets[i][1] else 1, links[i]) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, c string")
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in similarity_classes(df).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_chains_and_odd_rows(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(8)]
    texts = [None, "", "  \n ", "one", "one", "Two words", "two  WORDS", "a b c d e", "x " * 30_000]
    for n, b in enumerate(base):
        texts += [" ".join(b)] * (n % 3 + 1) + [edited(rng, b, k % 3) for k in range(25 if n == 0 else 4)]
    chain = list(base[1])
    for i in range(0, 60, 3):  # neighbours are similar, the ends are not
        chain[i] = f"c{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("few", [0, 16])
def test_open_buckets_are_compared_exhaustively(spark, monkeypatch, few):
    """With one short prefix nearly all texts share buckets, so that most links come from the blocks."""
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "LISTED", 3)
    monkeypatch.setattr(ngramjoin, "prefix_length", lambda *_: 1)
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for n in range(12):
        own = [f"o{n}_{i}" for i in range(40)]
        texts += [edited(rng, shared + own, k) for k in range(3)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_null_ids_and_empty_table(spark):
    got = run(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (4, None)])
    assert got[3] == (None, 2, 1) and got[None] == (None, 2, 1) and got[4] == (4, 1, 0)
    assert run(spark, []) == {}
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    assert run(spark, [(1, one), (1, two), (2, one), (3, two)])[1] in ((1, 2, 1),)


def test_components_by_stars(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {r.c: r.comp for r in connected(df).collect()}
    assert all(want[i] == 0 for i in range(41)) and all(want[100 + i] == 100 for i in range(40))
    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    assert {r.c: r.comp for r in connected(df).collect()} == want


def test_prefix_and_similar():
    assert prefix_length(0.8) == 5 and prefix_length(0.1) == 1
    a = [np.arange(10, dtype=np.int64), np.arange(5, dtype=np.int64)]
    b = [np.arange(8, dtype=np.int64), np.arange(2, 12, dtype=np.int64), np.zeros(0, np.int64)]
    assert similar(a, b).tolist() == [[True, False, False], [False, False, False]]
    with pytest.raises(ValueError):
        similar([], [])


def test_rows_of_repeated_ids_are_documents(spark):
    import corpus_pipeline as cp

    one, two, three = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z u v w x")
    rows = [(1, one), (5, one), (5, two), (5, three), (7, two), (8, three), (8, three), (None, "n " * 9), (None, "n " * 9), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or -1, r.text) for r in cp.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted([(1, one), (5, two), (5, three), (-1, "n " * 9), (-1, "only here")])
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_copies, r.n_links) for r in similarity_classes(docs).collect())
    want = [(1, 1, 2, 1), (5, 1, 2, 1), (5, 5, 2, 1), (5, 5, 3, 2), (7, 5, 2, 1), (8, 5, 3, 2), (8, 5, 3, 2), (-1, -1, 2, 1), (-1, -1, 2, 1), (-1, -1, 1, 0)]
    assert got == sorted(want)


def test_recall_on_the_table(spark):
    """Classes and numbers of links of whole documents at sf0.01, against all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, got = brute(rows), run(spark, rows)
    assert sum(n for _, _, n in want.values()) > 100
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    linked = [i for i in want if want[i][2]]
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)


def test_forest_over_partition_borders(spark):
    """Whatever shares a prefix in a small node is a candidate, and large nodes are named with all their members."""
    rng = np.random.default_rng(4)
    trees, depth, need = 2, 6, 3
    keys = rng.integers(0, 3, (400, trees * depth)).astype(">u2")
    keys[:60, :depth] = keys[0, :depth]
    rows = [(i, k.tobytes()) for i, k in enumerate(keys)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found = forest(spark.createDataFrame(rows, "c long, keys binary"), need, trees, depth).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pairs, nodes = {(r.a, r.b) for r in found if r.b is not None}, defaultdict(set)
    for r in found:
        if r.node is not None:
            nodes[r.node].add(r.a)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        for t in range(trees):
            groups[t, tuple(k[t * depth : t * depth + need])].append(i)
    for g in groups.values():
        if len(g) <= ngramjoin.SMALL:
            assert all((a, b) in pairs for n, a in enumerate(g) for b in g[n + 1 :])
        else:
            assert set(g) in nodes.values()
    assert max(map(len, groups.values())) >= 60
