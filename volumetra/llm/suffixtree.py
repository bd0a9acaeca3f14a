"""Language-model scoring by a probabilistic suffix tree over words.

Words of training rows are counted whole and exactly. By default, and in the query, all contexts of one to ``DEPTH`` words (or
the start of a text and the words after it) are learned, however rare, and counted where tokens meet: see ``suffixcounts``.

A caller may ask for a tree that is bounded by ``nodes`` or ``min_count`` instead: ``learn`` keeps contexts that occur often
enough; each level is counted in a pass of its own, which extends the nodes of the level before. A context becomes a state if
its next-word counts diverge from what its longest shorter state predicts: the Kullback-Leibler divergence times the
context's count has to reach ``DIVERGENCE`` nats for each next word listed. A state's distribution is smoothed with that of its
parent (Witten-Bell); words that it does not list share the rest in proportion to the parent's, so that every state's
probabilities sum to 1. The root is the base: counts plus one over all words, and a share for unseen ones. A token is scored
by the longest suffix of its history that is a state. Such a tree is sent to the driver and broadcast, at most ``nodes`` words
and ``nodes`` contexts a level; words below the threshold are scored by an exact join on their 64-bit hashes.

Defined results: null text counts as empty (one end token); a null id hashes as an empty string and is trained on; repeated
rows are trained on and scored one by one; without training rows N and V are 0, so that both scores are 0; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import scratch, suffixcounts
from volumetra.llm.tokencount import runs_of

NODES, MIN_COUNT, DEPTH, DIVERGENCE = 1 << 20, 4, 3, 2.0
#: Bits of a word's number; numbers of words that are no nodes, of the end, of the start, and of the first node.
BITS, RARE, END, START, FIRST = 21, 0, 1, 2, 3
#: Bytes of text that are numbered at once, distinct words a task holds, n-grams it sorts at once.
RUN_BYTES, WORDS, KEYS = 1 << 21, 300_000, 1 << 22
#: Logarithms of rare words are summed as whole numbers of 1e-10, so that a sum does not depend on its order.
FINE = 10**10


def training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case: in bytes, ``lower`` changes A-Z alone and ``split`` cuts at ASCII white space alone."""
    return text.lower().split()


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n, n_all): occurrences in training rows and in all; the null word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn, rest, ends = Counter(), Counter(), [0, 0]

        def rows() -> pa.RecordBatch:
            words = list(learn.keys() | rest.keys())
            n, other = ([c[w] for w in words] for c in (learn, rest))
            out = pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*n, ends[0]], pa.int64()), pa.array([*map(sum, zip(n, other, strict=True)), sum(ends)], pa.int64())], ["word", "n", "n_all"])
            learn.clear(), rest.clear()
            ends[:] = [0, 0]
            return out

        for batch in batches:
            for text, use in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (learn if use else rest).update(tokens(text))
                ends[not use] += 1
                if len(learn) + len(rest) > WORDS:
                    yield rows()
        yield rows()

    parts = docs.select("text", "learn").mapInArrow(run, "word binary, n long, n_all long")
    return scratch.table(parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")).filter("n_all > 0"), "words")


@dataclass
class Level:
    """Contexts of one length, and the words listed after them."""

    keys: np.ndarray  # context << BITS | word, in order; a pair's place is the number of the context one word longer
    logp: np.ndarray  # log10 of the word's probability
    state: np.ndarray  # by context: whether it is a state
    back: np.ndarray  # by context: log10 of the factor of its parent's probabilities for words not listed
    parent: np.ndarray  # by context: the context without its first word, one level up

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of pairs, -1 where they are none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Tree:
    """Word numbers and counts, and the levels counted so far."""

    words: dict[bytes, int]
    counts: np.ndarray  # by number of a word
    n: int
    v: int
    levels: list[Level] = field(default_factory=list)

    def root(self, x: np.ndarray) -> np.ndarray:
        return np.log10(self.counts[x] + 1.0) - math.log10(self.n + self.v + 1)

    def logp(self, context: np.ndarray, x: np.ndarray, level: int) -> np.ndarray:
        """log10 of the probability of each x after a context of ``level`` words that is a node."""
        if level == 0:
            return self.root(x)
        of = self.levels[level - 1]
        shorter, at = self.logp(of.parent[context], x, level - 1), of.find(context << BITS | x)
        return np.where(of.state[context], np.where(at >= 0, of.logp[at] if len(of.logp) else 0.0, of.back[context] + shorter), shorter)

    def numbers(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of texts with an empty word for each end, their numbers, and where each text begins."""
        found, starts = [], []
        for t in texts:
            starts.append(len(found))
            found += tokens(t)
            found.append(b"")
        get = self.words.get
        return found, np.fromiter((get(w, RARE) for w in found), np.int64, len(found)), np.array(starts, np.int64)

    def contexts(self, x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each level counted, and the next one, the number of the context before each token, or -1."""
        before = np.concatenate([[RARE], x[:-1]])
        before[starts] = START
        out = [np.where(before == RARE, -1, before)]
        for level in self.levels:
            at = np.full(len(x), -1)
            known = np.flatnonzero((out[-1] >= 0) & (x != RARE))
            at[known] = level.find(out[-1][known] << BITS | x[known])
            longer = np.concatenate([[-1], at[:-1]])
            longer[starts] = -1
            out.append(longer)
        return out

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; for rare words without their own count, so as if it were 0."""
        out, open_ = np.zeros(len(x)), np.arange(len(x))
        contexts = self.contexts(x, starts)
        for level, context in reversed(list(zip(self.levels, contexts, strict=False))):
            c = context[open_]
            here = np.flatnonzero((c >= 0) & level.state[c])
            at = level.find(c[here] << BITS | x[open_[here]])
            listed = at >= 0
            out[open_[here]] += np.where(listed, level.logp[at] if len(level.logp) else 0.0, level.back[c[here]])
            open_ = np.delete(open_, here[listed])
        out[open_] += self.root(x[open_])
        return out


def add_level(tree: Tree, context: np.ndarray, word: np.ndarray, n: np.ndarray, types: np.ndarray, divergence: float = DIVERGENCE) -> None:
    """The next level, of rows (context, word, count): a row for each listed word, and one with word -1 for all others,
    whose number of kinds is in ``types``."""
    size = len(tree.counts) if not tree.levels else len(tree.levels[-1].keys)
    depth = len(tree.levels)
    if depth == 0:
        parent = np.zeros(size, np.int64)
    elif depth == 1:
        parent = tree.levels[0].keys & ((1 << BITS) - 1)
    else:
        last = tree.levels[-1]
        parent = tree.levels[-2].find(last.parent[last.keys >> BITS] << BITS | last.keys & ((1 << BITS) - 1))
    listed = np.flatnonzero(word >= 0)
    listed = listed[np.argsort(context[listed] << BITS | word[listed])]
    c, x, k = context[listed], word[listed], n[listed].astype(float)
    by = lambda at, value: np.bincount(at, value, size)
    total = by(context, n.astype(float))
    kinds = by(c, np.ones(len(c))) + by(context[word < 0], types[word < 0].astype(float))
    shorter = 10.0 ** tree.logp(parent[c], x, depth)
    rest, left = np.maximum(total - by(c, k), 0.0), np.maximum(1.0 - by(c, shorter), 1e-9)
    some = np.maximum(total, 1.0)
    apart = by(c, k * np.log(k / some[c] / shorter)) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / some / left), 0.0)
    lists = by(c, np.ones(len(c)))
    state = (lists > 0) & (apart >= divergence * lists)
    logp = np.log10((k + kinds[c] * shorter) / np.maximum(total + kinds, 1.0)[c])
    back = np.log10(np.maximum(rest + kinds * left, 1e-9) / np.maximum(total + kinds, 1.0) / left)
    tree.levels.append(Level(c << BITS | x, logp, state, np.where(state, back, 0.0), parent))


def count_level(docs: DataFrame, tree: Tree, least: int) -> pa.Table:
    """Rows (context, word, n, types) of the next level: listed words are those with ``least`` occurrences after a context."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, kept, size = shared.value, [], 0

        def rows() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            texts = _texts(batch.column(0))
            for a, b in runs_of(map(len, texts), RUN_BYTES):
                _, x, starts = tree.numbers(texts[a:b])
                context = tree.contexts(x, starts)[-1]
                kept.append((context << BITS | x)[context >= 0])
                size += len(kept[-1])
                if size >= KEYS:
                    yield rows()
                    kept, size = [], 0
        if kept:
            yield rows()

    counted = docs.filter("learn").select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    word = F.col("key").bitwiseAND((1 << BITS) - 1)
    named = counted.select(F.shiftright("key", BITS).alias("context"), F.when((word != RARE) & (F.col("n") >= least), word).otherwise(-1).alias("word"), "n", F.when(word == RARE, F.col("n")).otherwise(1).alias("types"))
    try:
        # At most NODES listed words and a row for each of at most NODES contexts.
        return named.groupBy("context", "word").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toArrow()
    finally:
        shared.unpersist()


def learn(docs: DataFrame, words: DataFrame, nodes: int = NODES, min_count: int = MIN_COUNT, depth: int = DEPTH, divergence: float = DIVERGENCE) -> tuple[Tree, int]:
    """The tree, and the least count of a word in all rows that has a number in it."""
    sums = words.agg(F.sum("n"), F.sum("n_all"), F.sum((F.col("n") > 0).cast("long")), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    n, n_all, v, ends = (int(x or 0) for x in sums)
    least, least_node = (max(min_count, -(-x // nodes)) for x in (n_all, n))
    numbered = words.filter(F.col("word").isNotNull() & (F.col("n_all") >= least)).select("word", "n").toArrow().sort_by("word")
    names = numbered["word"].to_pylist()
    counts = np.concatenate([[0, ends, 0], numbered["n"].to_numpy()]).astype(np.int64)
    tree = Tree({w: i for i, w in enumerate(names, FIRST)} | {b"": END}, counts, n, v)
    while len(tree.levels) < depth and n and (not tree.levels or len(tree.levels[-1].keys)):
        found = count_level(docs, tree, least_node)
        add_level(tree, *(found[c].to_numpy().astype(np.int64) for c in ("context", "word", "n", "types")), divergence)
    return tree, least


SCORED = "doc_id long, learn boolean, n_tokens long, known long, base double, score double, rare array<struct<word:binary,times:int>>"


def score(docs: DataFrame, words: DataFrame, tree: Tree, least: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in runs_of(map(len, texts), RUN_BYTES):
                found, x, starts = tree.numbers(texts[a:b])
                ends = np.append(starts[1:], len(x))
                sums = [np.add.reduceat(y, starts) for y in ((tree.counts[x] > 0).astype(np.int64), tree.root(x), tree.score(x, starts))]
                at = np.flatnonzero(x == RARE)
                cuts = np.searchsorted(at, starts).tolist() + [len(at)]
                rare = [Counter(found[j] for j in at[p:q]) for p, q in zip(cuts, cuts[1:], strict=False)]
                listed = pa.array([[{"word": w, "times": k} for w, k in c.items()] for c in rare], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())])))
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(ends - starts), *map(pa.array, sums), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "learn", "n_tokens", "known", "base", "score", "rare"])

    made = docs.select("doc_id", "text", "learn").mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id())
    hashed = F.transform("rare", lambda r: F.struct(F.xxhash64(r["word"]).alias("h"), r["times"].alias("times")))
    scored = scratch.table(made.withColumn("rare", hashed), "scored")
    asked = scored.select("row", F.inline("rare"))
    few = words.filter((F.col("n") > 0) & (F.col("n_all") < least)).select(F.xxhash64("word").alias("h"), F.col("n").cast("int"))
    fine = F.round(F.log10(F.col("n") + F.lit(1.0)) * FINE).cast("long") * F.col("times")
    added = asked.join(few, "h").groupBy("row").agg(F.sum(fine).alias("fine"), F.sum("times").alias("more"))
    out = scored.join(added, "row", "left")
    more = F.coalesce(F.col("fine") / F.lit(float(FINE)), F.lit(0.0))
    known = (F.col("known") + F.coalesce("more", F.lit(0))).cast("long")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def suffix_tree_scores(docs: DataFrame, learn_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, divergence: float = DIVERGENCE, **least) -> DataFrame:
    """The operator: scores all rows by a model learned from those for which ``learn_on`` holds: from all of their contexts, or,
    if a caller asks for ``nodes`` or ``min_count``, by the tree that ``learn`` keeps to these."""
    on = training(F.col(id_col)) if learn_on is None else F.coalesce(learn_on, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), on.alias("learn"))
    words = counted_words(rows)
    if least:
        return score(rows, words, *learn(rows, words, depth=depth, divergence=divergence, **least))
    return suffixcounts.scores(rows, words, depth, divergence)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
