"""Fill-in-middle against plain Python, over the words of its arithmetic and over odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


def texts(seed, n=300):
    rng = random.Random(seed)
    atoms = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "a", "bcd", "é", "ж", "語", "\U0001f600", "\x00", "\x7f", "\x80", "\x85", "\xa0", " ", "<", "P", ">", "longer-word-than-eight"]
    return ["".join(rng.choice(atoms) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 40, 300]))) for _ in range(n)]


def test_spaces_of_every_byte_at_every_place():
    every = np.arange(256, dtype=np.uint8)
    want = np.isin(every, [0x20, *range(9, 14)])
    rng = np.random.default_rng(1)
    for place in range(8):
        raw = rng.integers(0, 256, (256, 8), dtype=np.uint8)
        raw[:, place] = every
        got = infill.spaces(raw.reshape(-1).view("<u8")).view(np.uint8).reshape(256, 8)
        assert (got[:, place] == np.where(want, 0x80, 0)).all()
        assert (got == np.where(np.isin(raw, [0x20, *range(9, 14)]), 0x80, 0)).all()


@pytest.mark.parametrize("part", [1, 3, 1 << 14])
def test_ranks_and_selection(monkeypatch, part):
    monkeypatch.setattr(infill, "PART", part)
    found = [t.encode() for t in texts(5, 60)]
    bounds = np.cumsum([0, *map(len, found)])
    units = infill.Units(np.frombuffer(b"".join(found), np.uint8), bounds)
    ends, place = [], 0
    for t in found:
        for u in UNIT.findall(t.decode()):
            place += len(u.encode())
            ends.append(place)
    assert units.after(np.arange(1, len(ends) + 1)).tolist() == ends
    assert units.rank(np.arange(place + 1)).tolist() == [sum(e <= p for e in ends) for p in range(place + 1)]


def test_against_plain_python(spark):
    rows = [*enumerate(texts(9)), (None, "a null id and its text"), (None, None), (7, None), (8, ""), (9, " "), (9, " "), (10, "\n\n x"), (11, "one <S> in it"), (12, "é " * 300_000), (13, "x" * 2_000_003)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, form string, row int")
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "row", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_rates_and_one_python_pass(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    forms = {r.form for r in infill.fill_in_middle(docs, rate=100, spm_rate=0, seed=1).collect()}
    assert forms == {"psm"}
    plan = infill.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
