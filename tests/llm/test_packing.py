import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from volumetra.llm import packing
from volumetra.llm.packing import WINDOW, WordEncoder, combinations, pack, plan_windows, solve_counts
from volumetra.llm.tokencount import vocabulary

PATH = vocabulary("word_bpe_49k.json")
ODD = [None, "", " ", "Ω ΣΣ É ´́x", "a\x1cb c\x85d", "x<|endoftext|>y z", "it's 12  34\n\nok", "word " * 9000, "word " * 9000, "ﬁ İI", "é ́e"]


def same_ids(texts, encoder=None):
    library = Tokenizer.from_file(PATH)
    ids, bounds = (encoder or WordEncoder(PATH)).encode(pa.array(texts, pa.string()), 2)
    for text, x, y in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[x:y].tolist() == library.encode(text, add_special_tokens=False).ids + [2], text


def test_encoder_equals_library():
    same_ids([t or "" for t in ODD])
    same_ids([])


def test_encoder_equals_library_on_random_texts():
    r = random.Random(5)
    some = ["'", "s", "T", "ll", "LL", "ré", "Ω", "Σ", "ς", "ſ", "ß", "ẞ", "İ", "ı", "7", "½", "²", "!", "<|", "|>", "<|endoftext|>", "_", "-", "中文", "한", "\u0301", "\u200b", "\x1c", "\x85", "\xa0", "ǅ", "ﬁ", "Ж", "ѐ", "ͅ", "ʰ", "Ấ", "ạ̀", "🙂", "\x00", " ", " ", "\n"]
    texts = ["".join(r.choices(some, k=r.randint(0, 12))) for _ in range(4000)] + ["".join(chr(r.choice([r.randint(1, 0x52F), r.randint(0x1E00, 0x20FF), r.randint(0x2100, 0xD7FF)])) for _ in range(9)) for _ in range(4000)]
    same_ids(texts)


def test_encoder_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ROWS", 20)
    encoder = WordEncoder(PATH)
    for i in range(30):
        same_ids([" ".join(f"word{j} It's, {'long' * 40}{j % 3}" for j in range(i, i + 9)), "it's"], encoder)


def check(rows, texts, window):
    """Every id in exactly one piece, sequences gapless, little padding."""
    library = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_pack_odd_texts(spark):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int")
    check(pack(docs, PATH).collect(), texts, WINDOW)


def test_pack_small_window(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(["the"] * int(n)) for i, n in enumerate(rng.integers(0, 40, 400))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check(pack(docs, PATH, window=64).collect(), texts, 64)


def test_pack_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, WINDOW)


def test_pack_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, PATH).count() == 0


def test_least_squares_uses_the_histogram():
    hist = np.zeros(64, np.int64)
    hist[[16, 24, 40, 32]] = [400, 100, 100, 50]
    a, k, b = combinations(hist, 64)
    x = solve_counts(hist.astype(float), a, k, b)
    used = np.bincount(a, k * x, 64) + np.bincount(b, (b > 0) * x, 64)
    used[0] = 0
    assert np.abs(used - hist).max() < 1
    plan = plan_windows(hist, 64)
    assert plan["total"] <= 4 * 64
