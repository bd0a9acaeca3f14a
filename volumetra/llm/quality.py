"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters (case kept), of digits, or of symbols. Each word of the vocabulary has a sparse random index
vector, seeded by the word; its word vector is the sum of the index vectors of its neighbours in a sample of texts. A
word outside the vocabulary takes the vector of its shape (case and length). A document is the mean of its words'
vectors with two pooled numbers beside it, the share of distinct words and the log of the number of words. A network
with one hidden layer, in numpy, learns from the labelled rows; a temperature fitted on rows set aside calibrates it.

Bounds: word vectors and network are fitted on at most ``MAX_TRAIN`` labelled rows (a documented sample: those with the
smallest hash of their id), never on held-out rows (crc32 of the id as text, modulo 3, is 1). Vocabulary, vectors and
network have a fixed size; the executors send one matrix of co-occurrences for each of ``FIT_PARTS`` partitions. Scoring
is one scan and one Arrow map of whole texts. Labels, language, source and id are no inputs.

Defined results: null or empty text is scored like any other (no words: zero vector); without labels of both kinds
every score is the share of label 1, 0.5 without any; labels that are neither 0 nor 1 do not count, and of a document's
repeated labels the largest does; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import scratch

MAX_TRAIN, VOCABULARY, WIDTH, NONZERO, HIDDEN, FIT_PARTS, SEED = 4000, 3000, 64, 4, 24, 12, 7
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_SHAPES, PAIRS = 24, 65_536


def shape(word: str) -> int:
    """The number of a word's shape, from 0 to _SHAPES - 1."""
    c = word[0]
    kind = 0 if not c.isalnum() else 1 if c.isdigit() else 2 if len(word) > 1 and word.isupper() else 3 if c.isupper() else 4 if word.islower() else 5
    return kind * 4 + min(3, len(word).bit_length() - 1)


def index_vectors(words: list[str]) -> np.ndarray:
    """A sparse vector of +1 and -1 for each word, the same wherever it is made."""
    out = np.zeros((len(words), WIDTH), np.float32)
    for i, w in enumerate(words):
        rng = np.random.default_rng(zlib.crc32(w.encode("utf-8", "surrogatepass")))
        out[i, rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


class Pooler:
    """Texts to rows of pooled features."""

    def __init__(self, vocabulary: list[str], vectors: np.ndarray):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.vectors = vectors  # one for each word, then one for each shape
        self.shapes: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        n, place = len(self.place), self.place
        return np.fromiter((place[w] if w in place else n + shape(w) for w in words), np.int64, len(words))

    def pool(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1] + 2), np.float64)
        n, place = len(self.place), self.place
        for row, text in enumerate(texts):
            found = _WORD.findall(text)
            if not found:
                continue
            counts = Counter(found)
            at = np.fromiter((place[w] if w in place else n + shape(w) for w in counts), np.int64, len(counts))
            weight = np.fromiter(counts.values(), np.float64, len(counts))
            out[row, :-2] = np.bincount(at, weight, len(self.vectors)) @ self.vectors / len(found)
            out[row, -2:] = len(counts) / len(found), math.log1p(len(found)) / 10
        return out


class Network:
    """Standardized features, one hidden layer, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, epochs: int = 60):
        fit = ~aside if (~aside & (y == 1)).any() and (~aside & (y == 0)).any() else np.ones(len(y), bool)
        self.mean, self.std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z, t = (x - self.mean) / self.std, y.astype(np.float64)
        rng = np.random.default_rng(SEED)
        p = [rng.normal(size=(z.shape[1], HIDDEN)) / math.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / math.sqrt(HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        rows = np.flatnonzero(fit)
        for _ in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), 128):
                b = rows[i : i + 128]
                h = np.tanh(z[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[b]) / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[b].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
                step += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - 0.01 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            logits = self.logits(x[aside])
            losses = {c: np.logaddexp(0, -np.where(t[aside] == 1, 1, -1) * logits / c).mean() for c in np.geomspace(0.5, 8, 41)}
            self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Constant:
    """What stands in for a network where there is nothing to learn."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, label_col: str = "quality") -> DataFrame:
    """(doc_id, text, y, aside): at most ``most`` labelled rows that are not held out; of rows that repeat an id, the one whose
    text has the smallest hash."""
    y = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.max("y").alias("y"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0
    return one.select("doc_id", "least.text", "y", aside.alias("aside"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, label_col: str = "quality") -> tuple[Pooler, Network | Constant]:
    """Vocabulary, then word vectors, then the network; each from one pass over the training rows."""
    rows = scratch.table(training_rows(docs, labels, most, label_col), "training")
    parts = rows.coalesce(FIT_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(set(_WORD.findall(text)))
        top = found.most_common(4 * VOCABULARY)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counted = parts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = [r["word"] for r in counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    n = len(vocabulary)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.concatenate([index_vectors(vocabulary), index_vectors([f"<shape {i}>" for i in range(_SHAPES)])]) if n else index_vectors([f"<shape {i}>" for i in range(_SHAPES)])
        pooler, total = Pooler(vocabulary, index), np.zeros((n + _SHAPES, WIDTH), np.float64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = pooler.ids(_WORD.findall(text))
                for gap in (1, 2):
                    a, b = ids[:-gap], ids[gap:]
                    pairs, times = np.unique(np.concatenate([a * len(index) + b, b * len(index) + a]), return_counts=True)
                    for i in range(0, len(pairs), PAIRS):  # a bounded part of a long text's pairs at once
                        p, k = pairs[i : i + PAIRS], times[i : i + PAIRS, None]
                        np.add.at(total, p // len(index), index[p % len(index)] * k)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

    sums = np.zeros((n + _SHAPES, WIDTH))
    for r in parts.select("text").mapInArrow(neighbours, "sums binary").collect():  # FIT_PARTS rows of fixed size
        sums += np.frombuffer(r["sums"], "<f8").reshape(sums.shape)
    vectors = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)
    # Its own index vector keeps apart words that have the same neighbours.
    vectors += 0.5 / math.sqrt(NONZERO) * np.concatenate([index_vectors(vocabulary).reshape(n, WIDTH), index_vectors([f"<shape {i}>" for i in range(_SHAPES)])])
    pooler = Pooler(vocabulary, vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooler.pool(batch.column(1).to_pylist())
            kept = [batch.column(i) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "aside", "x"])

    pooled = parts.select("doc_id", "text", "y", "aside").mapInArrow(pool, "doc_id long, y int, aside boolean, x binary").toPandas()  # MAX_TRAIN rows at most
    pooled = pooled.sort_values(["doc_id", "x"])
    y = pooled["y"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return pooler, Constant(float(y.mean()) if len(y) else 0.5)
    x = np.array([np.frombuffer(b) for b in pooled["x"]])
    return pooler, Network(x, y, pooled["aside"].to_numpy(bool))


def score(docs: DataFrame, pooler: Pooler, network: Network | Constant, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out_col``, the probability of label 1."""
    model = scratch.share(docs.sparkSession, (pooler, network))
    kept = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    names = [*kept, *({text_col} - set(kept))]
    at, places = names.index(text_col), [names.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler, network = model.value
        for batch in batches:
            x = pooler.pool([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(np.round(network.score(x), 6))], [*kept, out_col])
        scratch.give_back()

    return docs.select(*names).mapInArrow(run, docs.select(*kept).schema.add(out_col, "double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: (doc_id, held_out, score, predicted) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = score(texts, *fit(texts, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
