"""Scores from all contexts, however rare and however large, against the model of plain dictionaries."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_suffixtree import brute, made
from volumetra.llm import suffixcounts, suffixtree

ALL = 10**12


def compared(spark, rows, depth, divergence):
    docs = spark.createDataFrame([(i, t, True, 1, "r") for i, t in rows], "doc_id long, text string, learn boolean, row int, word string")
    got = suffixtree.suffix_tree_scores(docs.repartition(3), depth=depth, divergence=divergence).collect()
    want, states = brute(rows, ALL, 1, depth, divergence)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-8, abs=1e-8)
    return states


@pytest.mark.parametrize(("depth", "divergence", "numbered", "bucket", "split"), [(3, 2.0, 1 << 19, 1 << 19, 1 << 20), (3, 0.5, 20, 700, 150), (2, 2.0, 1000, 100, 40), (4, 1.0, 10, 5000, 60), (1, 0.0, 1000, 300, 100), (0, 2.0, 5, 300, 100)])
def test_every_context_is_learned(spark, monkeypatch, depth, divergence, numbered, bucket, split):
    """Words without numbers, many buckets, and contexts of all lengths that are split change no score."""
    for name, value in {"NUMBERED": numbered, "BUCKET": bucket, "SPLIT": split, "HELD": 900, "RUN_BYTES": 300}.items():
        monkeypatch.setattr(suffixcounts, name, value)
    real, found = suffixcounts.large_contexts, []
    monkeypatch.setattr(suffixcounts, "large_contexts", lambda *a: (found.append(real(*a)), found[-1])[1])
    assert compared(spark, made(depth), depth, divergence) > (20 if depth else -1)
    assert len(found[0][0].keys) == depth


def test_a_passage_that_occurs_twice_is_known(spark):
    """Contexts that a hundred thousand others outnumber are learned too: a held-out copy of a single training text is likely."""
    copied = " ".join(f"rare{i}" for i in range(200))
    rows = [(i, " ".join(f"w{(i * j * 7919 + j) % 997}" for j in range(400))) for i in range(300)] + [(1000, copied), (1001, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.suffix_tree_scores(docs, learn_on=F.col("doc_id") != 1001).collect()}
    assert got[1001].held_out and got[1001].score / got[1001].n_tokens > -0.5 > got[1001].base_score / got[1001].n_tokens


def test_words_are_cut_as_by_bytes():
    texts = ["", None, "a", "  a\x1cb\x0bC \x0c d\xa0É\x85 \r\n", "\t\n", "B  b\x1f a"]
    words, code, sizes = suffixcounts.cut(pa.array(texts))
    want = [suffixtree.tokens((t or "").encode()) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [words[c] for c in code] == [w for t in want for w in t]
