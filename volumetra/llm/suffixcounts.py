"""Suffix-tree scores from all contexts of the corpus, however rare: counts, states and scores are made where tokens meet.

The model is that of ``suffixtree`` without a least count: every context of up to ``depth`` words that occurs in a training
row is a node, and lists every word that follows it there. A context is a state if its counts diverge enough from what its
longest shorter state predicts; a state s gives x the probability (c(s, x) + T(s) P(x)) / (c(s) + T(s)), where T(s) is the
number of its words and P its parent's (Witten-Bell). A token's score is that of its longest context; contexts that are no
state, or that no training row holds, pass on what their parent gives.

1. Texts are cut into words once and stored as numbers: the ``NUMBERED`` most frequent words have one that is broadcast,
   others are named by their hash; the counts of these come by an exact join.
2. Each token goes, with the words before it, to the bucket of the word before it. A context's parent ends in the same
   word, so a bucket holds whole contexts with all their ancestors: one shuffle serves all levels, and training counts and
   the tokens to score are met in memory, a bucket of about ``BUCKET`` tokens at a time.
3. Contexts with ``SPLIT`` tokens or a ``SHARE``th of all and more are too large for a bucket. Their counts are added up by partial aggregation,
   level by level, and their tokens are dealt over several buckets by the next word of the context (by the row where there
   is none); to each of these the probabilities of that context are sent, and longer contexts are made in the bucket.
4. Logarithms are added by row as whole numbers, so that a score depends on no order.

Scale: the driver holds the words that have numbers and the contexts that are split, of a level at most one for each
``SPLIT`` tokens, or ``SHARE``. A task's memory is a bucket's, whatever the input; buckets grow in number with the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm import scratch
from volumetra.llm.tokencount import runs_of

#: Words with a number, tokens of a bucket, tokens of a context that is split, tokens that are dealt out at once.
NUMBERED, BUCKET, SPLIT, HELD = 1 << 20, 1 << 18, 1 << 19, 1 << 20
#: Contexts with this part of all tokens are split at any size, so that no bucket of a small table is much above the others.
SHARE = 256
#: Buckets that a task takes at most, on average.
TASK_BUCKETS = 32
#: Bits of a word's number; numbers of no word, of the end, of the start, and of the first word.
BITS, NONE, END, START, FIRST = 21, 0, 1, 2, 3
RUN_BYTES, FINE = 1 << 22, 10**10
#: In place of the number of a word that has none; bytes that are compressed as one.
UNNAMED, SMALL = (1 << 24) - 1, 4096


class Names:
    """Words with a number, in its order; a dictionary is made where they are looked up."""

    def __init__(self, names: pa.Array):
        self.names, self.number = names, None

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.number is None:
            self.number = {w: i for i, w in enumerate(self.names.to_pylist(), FIRST)}
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


@dataclass
class Words:
    """Counts of words, by number for those that have one."""

    counts: np.ndarray  # in training rows
    every: np.ndarray  # in all rows; for START the number of texts
    n: int
    v: int
    tokens: int  # in all rows
    least: int  # occurrences of words that have a number

    def root(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of each x without a context; ``count`` holds the counts of those without a number."""
        common = (x >= 0) & (x < len(self.counts))
        return (np.where(common, self.counts[np.where(common, x, NONE)], count) + 1.0) / (self.n + self.v + 1)


def numbered_words(words: DataFrame, most: int) -> tuple[Names, Words]:
    """``words`` has (word, n, n_all), the null word being the end."""
    sums = words.agg(F.sum("n"), F.sum("n_all"), F.sum((F.col("n") > 0).cast("long")), *[F.sum(F.when(F.col("word").isNull(), F.col(c))) for c in ("n", "n_all")]).first()
    n, n_all, v, ends, texts = (int(x or 0) for x in sums)
    # The least count that at most ``most`` words reach: one row for each count up to 2^16.
    real = words.filter(F.col("word").isNotNull())
    kinds = sorted(real.groupBy(F.least("n_all", F.lit(1 << 16)).alias("k")).count().collect(), reverse=True)
    least, so_far = -(-n_all // most), 0
    for k, count in kinds:
        so_far += count
        if so_far > most:
            break
        least = min(least, k)
    found = real.filter(F.col("n_all") >= least).toArrow().sort_by([("n_all", "descending"), ("word", "ascending")])
    counts, every = (np.concatenate([[0, e, s], found[c].to_numpy()]).astype(np.int64) for c, e, s in (("n", ends, 0), ("n_all", texts, texts)))
    return Names(found["word"].combine_chunks()), Words(counts, every, n, v, n_all, least)


@dataclass
class Split:
    """The contexts that are too large for a bucket, by level: ``keys`` are the numbers of the context without its first word
    and of that word, in order; ``base`` and ``parts`` tell the buckets of each."""

    keys: list[np.ndarray] = field(default_factory=list)
    base: list[np.ndarray] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)
    # By number among all levels: training count, words listed, and whether it is a state.
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, keys: np.ndarray, n: np.ndarray, large: int, buckets: int) -> None:
        order, level = np.argsort(keys), len(self.keys)
        self.keys.append(keys[order])
        self.base.append(_mixed(keys[order] * 8 + level) % np.uint64(buckets))
        self.parts.append(np.minimum(-(-n[order] // large), buckets).astype(np.uint64))

    def tell(self, c: np.ndarray, total: np.ndarray, kinds: np.ndarray, apart: np.ndarray, divergence: float) -> None:
        """What the last level's counts add up to; ``apart`` is the sum of n ln(n / low)."""
        order = np.argsort(c)
        total, kinds, apart = (x[order].astype(float) for x in (total, kinds, apart))
        state = (kinds > 0) & (apart - total * np.log(np.maximum(total, 1.0)) >= divergence * kinds)
        self.total, self.kinds, self.state = (np.concatenate(x) for x in ((self.total, total), (self.kinds, kinds), (self.state, state)))

    def p(self, c: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The probability of a word that follows context c n times and has ``low`` after its parent."""
        return np.where(self.state[c], (n + self.kinds[c] * low) / np.maximum(self.total + self.kinds, 1.0)[c], low)

    def first(self, level: int) -> int:
        """The number of a level's first context among those of all levels."""
        return sum(map(len, self.keys[:level]))

    def places(self, before: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the tokens whose context of that length is split, and its place in the level."""
        at, place = np.arange(len(before[0]) if before else 0), 0
        for keys, word in zip(self.keys, before, strict=False):
            w = word[at]
            key = place << BITS | w
            found = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            here = (w > NONE) & (w < 1 << BITS) & (keys[found] == key) if len(keys) else np.zeros(len(at), bool)
            at, place = at[here], found[here]
            yield at, place


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed whole numbers (the finisher of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def cut(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, the place of each word among them, and the number of words of each text. Words are in lower
    case, A-Z alone, and parted by ASCII white space alone."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    words, code = coded.dictionary.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist(), coded.indices.to_numpy()
    real = code != (words.index(b"") if b"" in words else -1)
    sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])
    return words, code[real].astype(np.int64), sizes


def _packed(*groups: tuple[np.ndarray, ...]) -> bytes:
    """Groups of columns, each compressed on its own unless they are short."""
    parts = [b"".join(c.tobytes() for c in g) for g in groups]
    if sum(map(len, parts)) < SMALL:
        parts = [b"".join(parts)]
    made = [pa.compress(p, "zstd", asbytes=True) for p in parts]
    return np.array([len(parts), *map(len, parts), *map(len, made)], np.int32).tobytes() + b"".join(made)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low byte and the others of words' numbers below 2^24."""
    return (x & 0xFF).astype(np.uint8), (x >> 8).astype(np.uint16)


class Unpacked:
    """Columns of ``_packed`` one after the other."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, np.int32, 1)[0])
        sizes, lengths = np.frombuffer(data, np.int32, 2 * n, 4).reshape(2, n).tolist()
        ends = np.cumsum([4 + 8 * n, *lengths]).tolist()
        self.data, self.at = b"".join(pa.decompress(data[a:b], k, "zstd", asbytes=True) for a, b, k in zip(ends, ends[1:], sizes)), 0

    def next(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out


STORED = "doc_id long, learn boolean, n_tokens long, known long, base double, ids binary, rare array<binary>"


def numbered(docs: DataFrame, names, words) -> DataFrame:
    """Rows (doc_id, text, learn) with their texts as numbers, stored: words without a number are the places in ``rare`` (the
    last is -1 and so on down), whose words are told by their hashes. ``base`` takes these as if they had no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        root = np.log10(w.counts + 1.0) - np.log10(w.n + w.v + 1)
        for batch in batches:
            for a, b in runs_of(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), RUN_BYTES):
                found, code, sizes = cut(batch.column(1).slice(a, b - a))
                number = names.value.numbers(found)
                starts = np.concatenate([[0], np.cumsum(sizes + 1)])
                x = np.full(starts[-1], END)
                inner = np.ones(len(x), bool)
                inner[starts[1:] - 1] = False
                x[inner] = number[code]
                few, row = np.flatnonzero(x < 0), np.repeat(np.arange(b - a), sizes + 1)
                named = np.zeros(len(x), np.int64)
                named[inner] = code
                key, which = np.unique(row[few] << 32 | named[few], return_inverse=True)
                first = np.searchsorted(key >> 32, np.arange(b - a + 1))
                known, base = ((y[np.maximum(x, NONE)]) for y in (w.counts > 0, root))
                known, base = (np.add.reduceat(y, starts[:-1]) for y in (known.astype(np.int64), base))
                x[few] = -1 - (which - first[row[few]])
                ids = [pa.compress(x[p:q].astype(np.int32).tobytes(), "zstd", asbytes=True) for p, q in zip(starts, starts[1:])]
                rare = pa.array([found[k] for k in (key & 0xFFFFFFFF).tolist()], pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rare)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(ids, pa.binary()), listed], ["doc_id", "learn", "n_tokens", "known", "base", "ids", "rare"])
        scratch.give_back()

    made = docs.select("doc_id", "text", "learn").mapInArrow(run, STORED).withColumn("row", F.monotonically_increasing_id())
    hashed = F.transform("rare", lambda w: F.xxhash64(w)).alias("rare")
    return scratch.table(made.select("row", "doc_id", "learn", "n_tokens", "known", "base", "ids", hashed), "numbered")


@dataclass
class Tokens:
    """Tokens with the words before them, nearest first (NONE before the start)."""

    x: np.ndarray
    row: np.ndarray
    use: np.ndarray
    before: list[np.ndarray]
    place: np.ndarray  # in the text


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each list begins, and the last ends; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def tokens_of(batches: Iterator[pa.RecordBatch], depth: int, held: int) -> Iterator[Tokens]:
    """Of rows (row, learn, n_tokens, ids, rare), about ``held`` at a time."""
    for batch in batches:
        column = {n: batch.column(n) for n in batch.schema.names}
        lengths = column["n_tokens"].to_pylist()
        for a, b in runs_of(lengths, held):
            part = {n: c.slice(a, b - a) for n, c in column.items()}
            size = np.array(lengths[a:b], np.int64)
            ids = np.frombuffer(b"".join(pa.decompress(t, 4 * n, "zstd", asbytes=True) for t, n in zip(part["ids"].to_pylist(), lengths[a:b], strict=True)), np.int32).astype(np.int64)
            at, start = np.repeat(np.arange(b - a), size), np.cumsum(size) - size
            few, first = np.flatnonzero(ids < 0), _offsets(part["rare"])
            place = first[at[few]] - 1 - ids[few]
            x = ids
            x[few] = part["rare"].flatten().to_numpy()[place]
            before, last = [], x
            for d in range(depth):
                last = np.concatenate([[NONE], last[:-1]])
                last[start] = NONE if d else START
                before.append(last)
            yield Tokens(x, part["row"].to_numpy()[at], part["learn"].to_numpy(zero_copy_only=False)[at], before, np.arange(len(x)) - start[at])


def large_contexts(texts: DataFrame, rare: DataFrame, words, depth: int, buckets: int, divergence: float) -> tuple[Split, DataFrame | None]:
    """The contexts that are split, and (c, x, n, low): how often word x follows the one with number c in training rows, for each
    that does in any, and its probability after the parent."""
    w, split, tables = words.value, Split(), []
    large = max(1, min(SPLIT, -(-w.tokens // SHARE)))
    often = np.flatnonzero(w.every >= large)
    keys = often[often >= START].astype(np.int64)
    n = w.every[keys]
    while len(keys) and len(split.keys) < depth:
        split.add(keys, n, large, buckets)
        level, spark = len(split.keys) - 1, texts.sparkSession
        shared = spark.sparkContext.broadcast(split)

        def run(batches: Iterator[pa.RecordBatch], level=level, shared=shared) -> Iterator[pa.RecordBatch]:
            counts = words.value.counts
            for t in tokens_of(batches, depth, HELD):
                *_, (at, place) = shared.value.places(t.before[: level + 1])
                x, use = t.x[at], t.use[at]
                for longer, value, n in ((False, x, use), (True, t.before[level + 1][at] if level + 1 < depth else x[:0], np.ones(len(at)))):
                    if longer:
                        k = (value > NONE) & (value < 1 << BITS)
                        c, value, n = place[: len(value)][k], value[k], n[: len(value)][k]
                    else:
                        c = place
                    code, names = pd.factorize(value)
                    key, kinds = pd.factorize(c << 32 | code)
                    names = names[kinds & 0xFFFFFFFF]
                    of = counts[np.where((names >= 0) & (names < len(counts)), names, NONE)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), longer)), pa.array(kinds >> 32), pa.array(names), pa.array(np.bincount(key, n, len(kinds)).astype(np.int64)), pa.array(of)], ["longer", "c", "x", "n", "own"])
            scratch.give_back()

        made = texts.select(*ASKED).mapInArrow(run, "longer boolean, c long, x long, n long, own long")
        found = scratch.table(made.groupBy("longer", "c", "x").agg(F.sum("n").alias("n"), F.max("own").alias("own")), "large")
        first = split.first(level)
        after = found.filter("not longer").select((F.col("c") + first).alias("c"), "x", "n", "own")
        if level == 0:
            # Counts of words that have a number came with them.
            root = lambda own: ((own + 1) / F.lit(float(w.n + w.v + 1))).alias("low")
            common = F.col("x").between(0, len(w.counts) - 1)
            others = after.filter(~common).join(rare.select(F.col("h").alias("x"), F.col("n").alias("few")), "x", "left")
            lower = after.filter(common).select("c", "x", "n", root(F.col("own"))).unionByName(others.select("c", "x", "n", root(F.coalesce("few", F.lit(0)))))
        else:
            parents = [split.first(level - 1) + int(k >> BITS) for k in split.keys[level]]
            up = [(first + i, c, float(split.total[c]), float(split.kinds[c]), bool(split.state[c])) for i, c in enumerate(parents)]
            up = spark.createDataFrame(up, "c long, up long, total double, kinds double, state boolean")
            over = tables[-1].select(F.col("c").alias("up"), "x", F.col("n").alias("n_up"), F.col("low").alias("low_up"))
            low = F.when(F.col("state"), (F.col("n_up") + F.col("kinds") * F.col("low_up")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("low_up"))
            lower = after.join(F.broadcast(up), "c").join(over, ["up", "x"]).withColumn("low", low)
        lower = scratch.table(lower.select("c", "x", "n", "low"), "split")
        tables.append(lower)
        some = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("low"))).otherwise(0.0))
        sums = lower.groupBy("c").agg(F.sum("n").alias("total"), F.sum((F.col("n") > 0).cast("long")).alias("kinds"), some.alias("apart")).toArrow()
        split.tell(*(sums[c].to_numpy() for c in ("c", "total", "kinds", "apart")), divergence)
        # At most one context of a level for each SPLIT tokens, or SHARE.
        next_ = found.filter("longer").filter(F.col("n") >= large).select((F.shiftleft("c", BITS).bitwiseOR(F.col("x"))).alias("key"), "n").toArrow()
        keys, n = (next_[c].to_numpy().astype(np.int64) for c in ("key", "n"))
        shared.unpersist()
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return split, out


def buckets_of(t: Tokens, split: Split, buckets: int) -> np.ndarray:
    """The bucket of each token."""
    n, size = np.uint64(buckets), len(t.x)
    base, parts, longest = np.zeros(size, np.uint64), np.full(size, n), np.zeros(size, np.int8)
    for level, (at, place) in enumerate(split.places(t.before), 1):
        base[at], parts[at], longest[at] = split.base[level - 1][place], split.parts[level - 1][place], level
    # The word before the longest context that is split; where there is none, tokens lie apart by their places.
    by = _mixed(t.row).astype(np.int64) + t.place
    for level, word in enumerate(t.before):
        by = np.where((longest == level) & (word != NONE), word, by)
    return ((base + _mixed(by) % parts) % n).astype(np.int32)


def counts_asked(texts: DataFrame, split, depth: int, buckets: int) -> DataFrame:
    """(row, bucket, h): where the words without a number are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokens_of(batches, depth, HELD):
            few = np.flatnonzero((t.x < 0) | (t.x >= 1 << BITS))
            t = Tokens(t.x[few], t.row[few], t.use[few], [b[few] for b in t.before], t.place[few])
            yield pa.RecordBatch.from_arrays([pa.array(t.row), pa.array(buckets_of(t, split.value, buckets)), pa.array(t.x)], ["row", "bucket", "h"])
        scratch.give_back()

    return texts.filter("size(rare) > 0").select(*ASKED).mapInArrow(run, "row long, bucket int, h long")


#: What a bucket is sent: tokens, counts of words without a number, and probabilities after contexts that are split.
TOKENS, COUNTS, GIVEN = 0, 1, 2
DEALT = "bucket int, kind int, n int, data binary"
ASKED = ["row", "learn", "n_tokens", "ids", "rare"]


def dealt(texts: DataFrame, split, depth: int, buckets: int) -> DataFrame:
    """Tokens packed by their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokens_of(batches, depth, HELD):
            bucket = buckets_of(t, split.value, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            row, use, columns, rare, rows = t.row[order], t.use[order], [], [], []
            for c in (t.x, *t.before):
                c = c[order]
                few = np.flatnonzero((c < 0) | (c >= 1 << BITS))
                rare.append((c[few], np.searchsorted(few, cuts)))
                c[few] = UNNAMED
                columns.append(_halves(c))
            near, far = columns[1:2], [*columns[:1], *columns[2:]]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = slice(cuts[k], cuts[k + 1])
                named = [h[e[k] : e[k + 1]] for h, e in rare]
                data = _packed((np.diff(row[at], prepend=0),), (use[at],), [c[at] for c, _ in far], [c[at] for _, c in far], [c[at] for n in near for c in n], named)
                rows.append((k, cuts[k + 1] - cuts[k], data))
            yield _rows(rows, TOKENS)
        scratch.give_back()

    return texts.select(*ASKED).mapInArrow(run, DEALT)


def _rows(rows: list[tuple], kind: int) -> pa.RecordBatch:
    buckets, ns, data = zip(*rows, strict=True) if rows else ((),) * 3
    columns = [pa.array(buckets, pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array(ns, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "n", "data"])


def told(known: DataFrame) -> DataFrame:
    """Counts (bucket, h, n) packed by their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, h, n = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            yield _rows([(bucket[a], b - a, _packed((h[a:b],), (n[a:b],))) for a, b in zip(cuts, cuts[1:])], COUNTS)

    return known.select("bucket", "h", F.col("n").cast("long")).sortWithinPartitions("bucket").mapInArrow(run, DEALT)


def given(table: DataFrame, split: Split, shared, buckets: int) -> DataFrame:
    """The probabilities of split contexts packed, once for each of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, x, n, low = (batch.column(i).to_numpy() for i in range(4))
            p = shared.value.p(c, n, low)
            cuts = np.flatnonzero(np.diff(c, prepend=-1, append=-1)).tolist()
            rows = [_packed((c[a : a + 1], x[a:b]), (p[a:b],)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c[cuts[:-1]]), pa.array(np.diff(cuts), pa.int32()), pa.array(rows, pa.binary())], ["c", "n", "data"])

    packed = table.repartition("c", F.pmod("x", F.lit(8))).sortWithinPartitions("c").mapInArrow(run, "c long, n int, data binary")
    places = [(split.first(d) + i, int(b), int(k)) for d in range(len(split.keys)) for i, (b, k) in enumerate(zip(split.base[d], split.parts[d], strict=True))]
    to = table.sparkSession.createDataFrame(places, "c long, base long, parts long")
    each = packed.join(F.broadcast(to), "c").withColumn("i", F.explode(F.expr("sequence(0L, parts - 1)")))
    return each.select(F.pmod(F.col("base") + F.col("i"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(GIVEN).alias("kind"), "n", "data")


def chances(x: np.ndarray, use: np.ndarray, p: np.ndarray, before: list[np.ndarray], skip: np.ndarray, divergence: float) -> np.ndarray:
    """The probability of each token after its longest state: ``p`` holds those after contexts of ``skip`` words, ``before`` the
    words before as small numbers, -1 for none."""
    p, at, s = p.copy(), np.arange(len(x)), np.zeros(len(x), np.int64)
    for d, word in enumerate(before):
        here = word[at] >= 0
        at = at[here]
        s = pd.factorize(s[here] << 32 | word[at])[0].astype(np.int64)
        own = skip[at] <= d  # the others' context of this length is split, and what comes after it is known
        if not own.any():
            continue
        t, c = at[own], s[own]
        kind, names = pd.factorize(c << 32 | x[t])
        low = np.empty(len(names))
        low[kind] = p[t]
        c, size = names >> 32, int(s.max()) + 1
        n = np.bincount(kind, use[t], len(names))
        total, listed = np.bincount(c, n, size), n > 0
        kinds = np.bincount(c[listed], minlength=size)
        apart = np.bincount(c[listed], n[listed] * np.log(n[listed] / total[c[listed]] / low[listed]), size)
        state = (kinds > 0) & (apart >= divergence * kinds)
        p[t] = np.where(state[c], (n + kinds[c] * low) / np.maximum(total + kinds, 1.0)[c], low)[kind]
    return p


def scored(packed: DataFrame, words, split, depth: int, tasks: int, divergence: float) -> DataFrame:
    """(row, fine): sums of the tokens' logarithms, a row for each text and bucket."""

    def bucket(known: list, counts: list, parts: list) -> pa.RecordBatch:
        s = split.value
        use, row, x, *before = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        of, kx, kp = (np.concatenate(c) for c in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 3
        h, of_h = (np.concatenate(c) for c in zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64),) * 2
        h, first = np.unique(h, return_index=True)
        at = np.minimum(np.searchsorted(h, x), max(0, len(h) - 1))
        p = words.value.root(x, np.where(h[at] == x, of_h[first[at]], 0) if len(h) else 0)
        skip, context = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for level, (at, place) in enumerate(s.places(before), 1):
            skip[at], context[at] = level, place + s.first(level - 1)
        # Numbers that are small, as a context's and a word's have to fit 64 bits.
        none = [b == NONE for b in before]
        code = pd.factorize(np.concatenate([x, kx, *before]))[0].astype(np.int64)
        del x, before, at
        x, kx, *before = np.split(code, np.cumsum([len(row), len(kx)] + [len(row)] * (depth - 1))[: depth + 1])
        for b, where in zip(before, none, strict=True):
            b[where] = -1
        if (deep := np.flatnonzero(skip)).size:
            keys = of << 32 | kx
            order, ask = np.argsort(keys), context[deep] << 32 | x[deep]
            found = order[np.minimum(np.searchsorted(keys, ask, sorter=order), len(keys) - 1)]
            if not (keys[found] == ask).all():
                raise ValueError("a split context lacks a word that follows it")
            p[deep] = kp[found]
        p = chances(x, use, p, before, skip, divergence)
        at, rows = pd.factorize(row)
        fine = np.zeros(len(rows), np.int64)
        np.add.at(fine, at, np.rint(np.log10(p) * FINE).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(fine)], ["row", "fine"])

    def tokens(n: int, data: Unpacked) -> tuple[np.ndarray, ...]:
        row, use = np.cumsum(data.next(np.int64, n)), data.next(np.bool_, n)
        low = [data.next(np.uint8, n) for _ in range(max(1, depth))]
        columns = [data.next(np.uint16, n).astype(np.int64) << 8 | c for c in low]
        if depth:
            c = data.next(np.uint8, n)
            columns.insert(1, data.next(np.uint16, n).astype(np.int64) << 8 | c)
        for c in columns:
            few = np.flatnonzero(c == UNNAMED)
            c[few] = data.next(np.int64, len(few))
        return use, row, *columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, counts, parts = None, [], [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            for i, (b, kind, n) in enumerate(zip(*columns, strict=True)):
                if b != now:
                    if parts:
                        yield bucket(known, counts, parts)
                    now, known, counts, parts = b, [], [], []
                data = Unpacked(batch.column(3)[i].as_py())
                if kind == TOKENS:
                    parts.append(tokens(n, data))
                elif kind == COUNTS:
                    counts.append((data.next(np.int64, n), data.next(np.int64, n)))
                else:
                    known.append((np.full(n, data.next(np.int64, 1)[0]), data.next(np.int64, n), data.next(np.float64, n)))
        if parts:
            yield bucket(known, counts, parts)
        scratch.give_back()

    met = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(run, "row long, fine long")


def scores(docs: DataFrame, words: DataFrame, depth: int, divergence: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text, learn); ``words`` are theirs."""
    spark = docs.sparkSession
    names, w = numbered_words(words, NUMBERED)
    shared, listed = scratch.share(spark, w), spark.sparkContext.broadcast(names)
    buckets = max(1, -(-w.tokens // BUCKET))
    texts = numbered(docs, listed, shared)
    listed.unpersist()
    few = words.filter(F.col("word").isNotNull() & (F.col("n") > 0) & (F.col("n_all") < w.least)).select(F.xxhash64("word").alias("h"), "n")
    split, table = large_contexts(texts, few, shared, depth, buckets, divergence)
    cuts = scratch.share(spark, split)
    known = scratch.table(counts_asked(texts, cuts, depth, buckets).join(few, "h"), "rare")
    packed = dealt(texts, cuts, depth, buckets).unionByName(told(known))
    if table is not None:
        packed = packed.unionByName(given(table, split, cuts, buckets))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))
    sums = scored(packed, shared, cuts, depth, tasks, divergence).groupBy("row").agg(F.sum("fine").alias("fine"))
    fine = F.round(F.log10(F.col("n") + F.lit(1.0)) * FINE).cast("long")
    more = known.groupBy("row").agg(F.sum(fine).alias("more"), F.count("*").alias("also"))
    out = texts.select("row", "doc_id", "learn", "n_tokens", "known", "base").join(sums, "row").join(more, "row", "left")
    base = F.col("base") + F.coalesce(F.col("more") / F.lit(float(FINE)), F.lit(0.0))
    known_ = (F.col("known") + F.coalesce("also", F.lit(0))).cast("long")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", known_.alias("n_known"), F.lit(w.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("fine") / F.lit(float(FINE))).alias("score"))
