"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Method: a MinHash LSH forest. Each text has a signature of ``DEPTH`` values in each of ``TREES`` trees. A tree's signatures
lie sorted, range-partitioned over the cluster; the common prefixes of neighbours in that order are its trie. A text's
prefix is shortened value by value from its full depth:
* to the length at which a pair at the threshold meets in some tree with ``RECALL`` (``prefix_length``: 5 values for 0.8);
  texts of a node that has up to ``SMALL`` entries there are all candidates of each other;
* further, to ``SPARSE`` values, where the node is still as small: in thin regions a pair at exactly 0.8 is missed with
  (1 - 0.8^4)^20 = 3e-5, in dense ones with (1 - 0.8^5)^20 = 3.6e-4 (higher similarity: less);
* in larger nodes only neighbours in the sorted order are candidates: there prefixes stay as deep as they match, and what
  this leaves apart in the node is compared exactly, see below.
Candidates are verified exactly on their shingle sets (64-bit hashes of shingles).

Groups are never expanded into all pairs of rows:
* equal texts are one class from the start (grouped by a 128-bit hash of their words);
* nodes that cross the border of two partitions are stitched from a few rows of each partition, so no node, however many
  texts it holds, has to meet in one task;
* connected components of the verified pairs are found by contraction on tables in the shared folder;
* large nodes that still hold several components, and components whose links are not all verified yet, are compared block
  against block in numpy (``_meetings``): blocks gather about ``BLOCK`` texts of similar size and equal smallest shingle. Two
  blocks meet only if their sizes allow the similarity and, in groups of over ``FEW`` blocks, some of their texts share a
  shingle among their smallest fifth (prefix filter; both tests are exact). So no link between different texts is lost, and a
  long chain costs in proportion to its length.
Nothing but counts, and ids below a stated number for a broadcast, reaches the driver.

Words are runs of non-white-space with A-Z lower-cased. Defined results: a text of one to four words is one shingle; null
or empty texts, or texts of white space, have no shingles and no links; where a doc_id (or null) repeats, every row is a document of its
own (``row_classes``) and has a row in the result; a null doc_id is the smallest; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import scratch
from volumetra.llm.hostrules import words
from volumetra.llm.linededup import LOWER, NO_ID, UPPER
from volumetra.operators import graph

SHINGLE, TREES, DEPTH, RECALL, SPARSE, SMALL, NEAR, BLOCK, BROADCAST_IDS = 5, 20, 8, 0.9995, 4, 8, 2, 256, 500_000
#: Entries of a tree that a task looks at together, blocks of one shingle that are listed, blocks that meet without a filter.
CHUNK, LISTED, FEW = 200_000, 64, 16
#: Similarity as a fraction of whole numbers, so that the test is exact.
THRESHOLD = (4, 5)


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall; 1 at least."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, w): d is the id (NO_ID if null), w the hashes of the words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    base = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("d"), low.alias("low"))
    return base.select("d", F.transform(words(F.col("low")), lambda x: F.xxhash64(x)).alias("w"))


def _named(hashed: DataFrame) -> DataFrame:
    """(d, k1, k2, w): two hashes of the words in their order name a text."""
    return hashed.select("d", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit("second"), "w").alias("k2"), "w")


def shingle_hashes(values: np.ndarray, lengths: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of each row of words; rows of fewer than n words have one, rows of none have none."""
    counts = np.where(lengths > 0, np.maximum(1, lengths - n + 1), 0)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    row = np.repeat(np.arange(len(lengths)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[row]
    end = (begin + lengths)[row]
    padded = np.concatenate([values.view(np.uint64), np.zeros(n, np.uint64)])
    h = np.full(len(start), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(n):
        w = np.where(start + j < end, padded[np.minimum(start + j, len(values))], np.uint64(j + 1))
        h = (h ^ w) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xC4CEB9FE1A85EC53), counts


def _chunks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, values, lengths) of a list column, in chunks that fit the processor's cache."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.concatenate([[0], np.cumsum(lengths)])
    for a, b in _chunks(lengths, 60_000):
        yield a, b, values[ends[a] : ends[b]], lengths[a:b]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(d, k1, k2, keys): k1 and k2 name the words in their order, keys has the signatures of all trees, two bytes a value."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, trees * depth), ">u2")
            some = np.zeros(batch.num_rows, bool)
            for a, b, values, lengths in _rows(batch.column(3)):
                h, counts = shingle_hashes(values, lengths)
                if not len(h):
                    continue
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                for i in range(trees * depth):
                    v = ((h * factors[i] + adds[i]) >> np.uint64(32)).astype(np.uint32)
                    keys[a + full, i] = np.minimum.reduceat(v, starts) & 0xFFFF
                some[a + full] = True
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * trees * depth)
            flat = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat], ["d", "k1", "k2", "keys"]).filter(pa.array(some))

    hashed = word_hashes(docs, id_col, text_col)
    return _named(hashed).mapInArrow(sign, "d long, k1 long, k2 long, keys binary")


def forest(classes: DataFrame, need: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The trees over the signatures ``keys`` of ``c``: rows (a, b) are candidates, rows (a, node) say that a is in a large
    node of depth ``need``; the other columns are null. A row may come twice."""
    width = 2 * depth
    each = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("keys", t * width + 1, width).alias("sig")) for t in range(trees)])
    entries = classes.select("c", F.explode(each).alias("e")).select("e.tree", "e.sig", "c")
    ordered = entries.repartitionByRange("tree", "sig", "c").sortWithinPartitions("tree", "sig", "c")
    schema = "a long, b long, node long, tree int, sig binary"
    found = scratch.table(ordered.mapInArrow(lambda parts: _climb(parts, need, depth, True), schema), "forest")
    # What lies at the borders of partitions, a few rows of each, once more together.
    borders = found.filter("tree is not null").select("tree", "sig", F.col("a").alias("c"))
    joined = borders.repartition(1).sortWithinPartitions("tree", "sig", "c").mapInArrow(lambda parts: _climb(parts, need, depth, False), schema)
    return found.filter("tree is null").unionAll(joined).select("a", "b", "node")


def _climb(batches: Iterator[pa.RecordBatch], need: int, depth: int, inner: bool) -> Iterator[pa.RecordBatch]:
    """Candidates, members of large nodes and border entries (if ``inner``) of sorted entries (tree, sig, c)."""
    least, held, first = min(need, SPARSE), [], True
    names = ["a", "b", "node", "tree", "sig"]

    def out(a: np.ndarray, b=None, node=None, of=None) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(a), kind)
        tree, sig = (none(pa.int32()), none(pa.binary())) if of is None else (pa.array(of.column("tree").to_pylist(), pa.int32()), pa.array(of.column("sig").to_pylist(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b), none(pa.int64()) if node is None else pa.array(node), tree, sig], names)

    def look(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        nonlocal first
        n, c = t.num_rows, t.column("c").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u2").reshape(n, depth)
        m = np.column_stack([t.column("tree").to_numpy().astype(np.int64), sig])
        common = np.logical_and.accumulate(m[1:] == m[:-1], axis=1).sum(axis=1) - 1  # -1 across trees
        run = {d: np.concatenate([[0], np.cumsum(common < d)]) for d in (need, least)}
        size = {d: np.bincount(r)[r] for d, r in run.items()}
        rows = []
        for gap in range(1, SMALL):
            if gap >= n:
                break
            same = {d: r[gap:] == r[:-gap] for d, r in run.items()}
            yes = same[least] & (size[least][gap:] <= SMALL) | same[need] & ((size[need][gap:] <= SMALL) | (gap <= NEAR))
            a, b = c[:-gap][yes], c[gap:][yes]
            rows.append(out(np.minimum(a, b), np.maximum(a, b)))
        if inner:
            large = size[need] > SMALL
            # Nodes at a border may go on in another partition.
            large |= (run[need] == 0) & first
            large |= (run[need] == run[need][-1]) & last
            node = _mixed_hash(m[:, : need + 1])
            rows.append(out(c[large], node=node[large]))
            edge = (run[least] == 0) & (np.arange(n) < SMALL) & first
            edge |= (run[least] == run[least][-1]) & (np.arange(n) >= n - SMALL) & last
            rows.append(out(c[edge], of=t.filter(pa.array(edge))))
        first = False
        tail = max(n - SMALL, int(np.searchsorted(run[least], run[least][-1])))
        return [r for r in rows if r.num_rows], t.slice(tail)

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= CHUNK:
            rows, tail = look(pa.concat_tables(held), False)
            yield from rows
            held = [tail]
    if held and (t := pa.concat_tables(held)).num_rows:
        yield from look(t, True)[0]


def _mixed_hash(m: np.ndarray) -> np.ndarray:
    h = np.full(len(m), 0x9E3779B97F4A7C15, np.uint64)
    for col in m.T:
        h = (h ^ col.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str = "d", text_col: str = "text") -> DataFrame:
    """(c, k1, k2, s): the distinct shingles of each row, and the name of its words as in ``signatures``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, lengths in _rows(batch.column(3)):
                h, counts = shingle_hashes(values, lengths)
                ends = np.cumsum(counts)
                own = [np.unique(h[e - n : e]) for e, n in zip(ends, counts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], ["c", "k1", "k2", "s"])

    return _named(word_hashes(docs, id_col, text_col)).mapInArrow(sets, "c long, k1 long, k2 long, s array<long>")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which of the sets ``a`` and ``b`` reach the similarity: all against all, by products of membership matrices."""
    both = [*a, *b]
    sizes = np.array([len(x) for x in both], np.int64)
    _, token, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = times[token] > 1
    place = np.cumsum(times > 1) - 1
    token, row = place[token[shared]], row[shared]
    common, step, n = np.zeros((len(a), len(b)), np.float32), 4096, int((times > 1).sum())
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    for v in range(0, n, step):
        lo, hi = np.searchsorted(token, (v, v + step))
        m = np.zeros((len(both), min(step, n - v)), np.float32)
        m[row[lo:hi], token[lo:hi] - v] = 1
        common += m[: len(a)] @ m[len(a) :].T
    inter = common.astype(np.int64)
    union = sizes[: len(a), None] + sizes[None, len(a) :] - inter
    return (threshold[1] * inter >= threshold[0] * union) & (union > 0)


def connected(edges: DataFrame) -> DataFrame:
    """(c, comp) of each node of ``edges`` (a, b): comp is the smallest node of its component."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id")))
    found = graph.components(nodes, edges, lambda t: scratch.table(t, "components"))
    return found.select(F.col("id").alias("c"), F.col("subset").alias("comp"))


def _small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _meetings(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (g, c and more) dealt to pairs of blocks: (bi, bj, own, s) and the columns of ``rows``, once for each block that
    the row's own block meets. Any two texts of a group g at the similarity are in one of these pairs."""
    # Sizes at the similarity are in the same class of the logarithm or in the next; s[0] is the smallest shingle.
    level = F.floor(F.log(F.size("s").cast("double")) / F.lit(float(np.log(THRESHOLD[1] / THRESHOLD[0] * 1.0001)))).cast("int")
    prefix = F.slice("s", 1, F.size("s") - F.expr(f"({THRESHOLD[0]} * size(s) + {THRESHOLD[1] - 1}) div {THRESHOLD[1]}") + 1)
    own = rows.join(sets, "c").select(*rows.columns, level.alias("level"), F.xxhash64(F.col("s")[0]).alias("like"))
    own = scratch.table(own, "members")
    parts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    for name, by, of in (("u", ["g", "level"], F.col("like")), ("v", ["g", "level", "u"], F.xxhash64("c", F.lit(1)))):
        n = own.groupBy(*by).agg(F.count("*").alias("m"))
        own = own.join(_small(scratch.table(n.filter(F.col("m") > BLOCK).select(*by, parts.alias("parts")), "sizes")), by, "left")
        own = own.withColumn(name, F.coalesce(F.pmod(of, F.col("parts")), F.lit(0))).drop("parts")
    own = scratch.table(own.withColumn("own", F.xxhash64("g", "level", "u", "v")), "members")

    blocks = scratch.table(own.groupBy("g", "level", "own").agg(F.count("*").alias("m")), "blocks")
    several = blocks.groupBy("g").agg(F.count("*").alias("k"))
    filtered = _small(scratch.table(several.filter(F.col("k") > FEW).select("g"), "filtered"))
    far = own.join(filtered, "g", "left_semi").select("g", "level", "own", "c").join(sets, "c")
    shared = scratch.table(far.select("g", "level", "own", F.explode(prefix).alias("p")).distinct(), "prefixes")
    wide = shared.groupBy("g", "p").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    few = shared.join(wide.filter(F.col("m") <= LISTED).drop("m"), ["g", "p"])
    lists = few.groupBy("g", "p").agg(F.sort_array(F.collect_list(F.struct("own", "level"))).alias("l"))
    each = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.lit(LISTED)), lambda y: F.struct(x["own"].alias("bi"), y["own"].alias("bj"), F.abs(x["level"] - y["level"]).alias("far")))))
    met = lists.select(F.explode(each).alias("x")).select("x.*").filter("far <= 1").select("bi", "bj")
    # Blocks of a shingle that more of them share, and the few of a small group, meet wherever their sizes allow.
    close = blocks.join(several.filter(F.col("k").between(2, FEW)).select("g"), "g", "left_semi").select("g", "level", "own")
    many = close.unionAll(shared.join(_small(scratch.table(wide.filter(F.col("m") > LISTED).drop("m"), "wide")), ["g", "p"], "left_semi").select("g", "level", "own").distinct())
    many = scratch.table(many, "wide")
    other = many.select("g", F.explode(F.array("level", F.col("level") - 1)).alias("level"), F.col("own").alias("bj"), F.col("level").alias("theirs"))
    dense = many.join(other, ["g", "level"]).filter((F.col("level") < F.col("theirs")) | (F.col("own") < F.col("bj")))
    met = met.union(dense.select(F.least("own", "bj").alias("bi"), F.greatest("own", "bj").alias("bj"))).distinct()
    met = met.union(blocks.filter("m > 1").select(F.col("own").alias("bi"), F.col("own").alias("bj")))
    met = scratch.table(met, "met")
    sides = met.select("bi", "bj", F.col("bi").alias("own")).union(met.filter("bi <> bj").select("bi", "bj", F.col("bj").alias("own")))
    return own.select(*rows.columns, "own").join(sides, "own").join(sets, "c")


def _two_blocks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    i, j = pdf[pdf["own"] == pdf["bi"].iat[0]], pdf[pdf["own"] == pdf["bj"].iat[0]]
    if not len(i) or not len(j):
        return i, j, np.zeros((len(i), len(j)), bool)
    yes = similar(list(i["s"]), list(j["s"]))
    return i, j, yes & (i["c"].to_numpy()[:, None] != j["c"].to_numpy()[None, :])


def _block_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the verified pairs of two blocks, as many as keep their rows connected."""
    i, j, yes = _two_blocks(pdf)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, ci, cj = [], i["c"].to_numpy(), j["c"].to_numpy()
    for p, q in zip(*np.nonzero(yes), strict=True):
        a, b = int(ci[p]), int(cj[q])
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each row of two blocks with the rows of the other block."""
    i, j, yes = _two_blocks(pdf)
    left = pd.DataFrame({"c": i["c"].to_numpy(np.int64), "links": yes.astype(np.int64) @ j["n"].to_numpy(np.int64)})
    if pdf["bi"].iat[0] == pdf["bj"].iat[0]:
        return left
    right = pd.DataFrame({"c": j["c"].to_numpy(np.int64), "links": yes.T.astype(np.int64) @ i["n"].to_numpy(np.int64)})
    return pd.concat([left, right])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. The set of ``a`` is shuffled once, not once for each pair."""
    b = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    a = sets.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    both = pairs.join(b, "b").join(a, "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    tested = both.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb") - inter).alias("u"))
    return tested.filter(THRESHOLD[1] * F.col("i") >= THRESHOLD[0] * F.col("u")).select("a", "b")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) where no id repeats."""
    signed = scratch.table(signatures(docs, id_col, text_col), "signatures")
    classes = scratch.table(signed.groupBy("k1", "k2").agg(F.min("d").alias("c"), F.count("*").alias("n"), F.first("keys").alias("keys")), "classes")

    found = forest(classes.select("c", "keys"), prefix_length(THRESHOLD[0] / THRESHOLD[1]))
    pairs = scratch.table(found.filter("b is not null").select("a", "b").distinct(), "pairs")
    large = scratch.table(found.filter("node is not null").select(F.col("node").alias("g"), F.col("a").alias("c")).distinct(), "nodes")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    text = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("d"), F.col(text_col).alias("text"))
    chosen = text.join(_small(wanted.withColumnRenamed("c", "d")), "d", "left_semi")
    sets = scratch.table(shingle_sets(chosen).select("c", "s"), "sets")

    edges = scratch.table(verified(pairs, sets), "verified")
    comps = scratch.table(connected(edges), "components")

    # Large nodes that the verified pairs leave in several components.
    big = large.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = big.groupBy("g").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = _small(scratch.table(mixed.filter((F.col("m") > SMALL) & (F.col("lo") < F.col("hi"))).select("g"), "mixed"))
    open_rows = scratch.table(large.join(mixed, "g"), "open")
    if not open_rows.isEmpty():
        more = _meetings(open_rows, sets).groupBy("bi", "bj").applyInPandas(_block_edges, "a long, b long")
        edges = scratch.table(edges.union(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "verified")
        comps = scratch.table(connected(edges), "components")

    # Components all of whose pairs are verified need no more; the others are counted block against block.
    sized = classes.select("c", "n").join(comps, "c")
    whole = edges.join(comps, edges["a"] == comps["c"]).groupBy("comp").agg(F.count("*").alias("e"))
    size = comps.groupBy("comp").agg(F.count("*").alias("m")).join(whole, "comp")
    size = scratch.table(size.withColumn("complete", F.col("e") * 2 == F.col("m") * (F.col("m") - 1)), "sizes")
    sized = sized.join(size.drop("e"), "comp")
    ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = sized.filter("complete").select("c", "n")
    direct = ends.join(known.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    dealt = _meetings(sized.filter(~F.col("complete")).select(F.col("comp").alias("g"), "c", "n"), sets)
    counted = dealt.groupBy("bi", "bj").applyInPandas(_block_links, "c long, links long")
    links = direct.union(counted.groupBy("c").agg(F.sum("links").alias("links")))
    info = classes.select("k1", "k2", "c", "n").join(comps, "c", "left").join(links, "c", "left")
    info = info.select("k1", "k2", F.coalesce("comp", "c").alias("class_id"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    info = scratch.table(info.filter("n > 1 or n_links > 0"), "classes")

    everyone = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("d"))
    named = signed.select("d", "k1", "k2").join(_small(info), ["k1", "k2"]).select("d", "class_id", "n", "n_links")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return everyone.join(named, "d", "left").select(
        real("d").alias("doc_id"),
        F.when(F.coalesce("class_id", "d") != NO_ID, F.coalesce("class_id", "d")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether an id, or null, is that of several rows."""
    return (docs.groupBy(id_col).count().agg(F.max("count")).first()[0] or 0) > 1


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a key of each row; written, so that the keys stay."""
    return scratch.table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def row_classes(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``with_rows`` as documents of their own: (row, doc_id, c, n_copies, n_links), where c names the class,
    and of each class (c, least): its smallest doc_id (null before all), of equal ones the smallest row."""
    own = keyed.select("row", F.col(id_col).cast("long").alias("doc_id"))
    found = _classes(keyed, "row", text_col).withColumnsRenamed({"doc_id": "row", "class_id": "c"})
    found = scratch.table(found.join(own, "row"), "rows")
    return found, found.groupBy("c").agg(F.min(F.struct("doc_id", "row")).alias("least"))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: (doc_id, class_id, n_copies, n_links), one row per document.

    class_id is the smallest doc_id of its connected class (its own without links), n_copies counts the documents with
    the same words, itself too, and n_links the other documents at the similarity or above, copies too.
    """
    if not ids_repeat(docs, id_col):
        return _classes(docs, id_col, text_col)
    found, least = row_classes(with_rows(docs.select(id_col, text_col)), id_col, text_col)
    # Only classes of several rows need their smallest id; they may be as large as they like, each is one row here.
    many = found.filter(F.col("row") != F.col("c")).select("c").distinct()
    named = _small(scratch.table(least.join(many, "c", "left_semi").select("c", F.col("least.doc_id").alias("class_id"), F.lit(True).alias("many")), "least"))
    out = found.join(named, "c", "left")
    return out.select("doc_id", F.when(F.col("many"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_copies", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
