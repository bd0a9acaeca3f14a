"""Packing of tokenized documents into windows of fixed length, planned by non-negative least squares.

1. Each text is tokenized once; its ids (two bytes each) are written to the shared folder with the length of what is left
   after whole windows and a rank among the rows of that length in the same task. Whole windows fill a sequence alone.
2. The histogram of left-over lengths (as many bins as a window has tokens) is all the driver sees. Shallow combinations
   that fill a window exactly, k times a and once b, are enumerated; non-negative least squares finds how often each is
   to be used; counts are rounded to the nearest and kept within what the histogram holds.
3. Left-overs of a length are numbered across tasks by prefix sums over (task, length) counts, so a number determines its
   sequence and offset by binary search in small arrays: nothing is collected and no key is hot.
4. What the combinations leave over is packed greedily, longest first, one after the other and cut where a window ends.
   The rest of the last window is cut at powers of two, which need no padding.

Defined results: null or empty text is its end id alone; an empty table gives no pieces; repeated rows are packed one by
one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from volumetra.llm import scratch
from volumetra.llm.tokencount import MISSES, of_worker, open_tokenizer, runs_of, vocabulary

WINDOW, END_ID, CACHE_ROWS, MAX_REPEAT, BROADCAST_OFFSETS = 4096, 2, 200_000, 8, 1_000_000
BATCH_BYTES, KEPT_CHARS = 2_000_000, 64
#: Arrow and str.split() part words here too, the tokenizer's own \\s does not.
_NOT_SPACE = "[\x1c-\x1f]"
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: ASCII punctuation and symbols.
_SIGNS = r"!-/:-@\[-`{-~"
#: Code points whose letters are looked at one by one when an encoder opens.
_LETTERS = (*range(0x80, 0x530), *range(0x1E00, 0x1F00))


class WordEncoder:
    """Ids as little-endian uint16. Words parted by white space are independent for this kind of vocabulary.

    Arrow parts a batch of texts into words and numbers the distinct ones; only these are looked up, and the ids of all
    words are gathered by number. Unknown words made of letters, digits and ASCII signs are cut into pre-tokens here, in
    the normal form and byte letters that the library itself gives for each letter, and merged by the library's model
    in one call; every other word goes to the library as it is.
    """

    def __init__(self, path: str):
        self.library, self.known, self.older = open_tokenizer(path), {"": b""}, {}
        self.model = Tokenizer(self.library.model)  # the same tables in memory, without normal form and pre-tokens
        names = self.library.get_vocab()
        if max(names.values()) > 65535:
            raise ValueError("ids of this vocabulary do not fit two bytes")
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        #: Byte letters of the normal form of each plain letter.
        self.form = {c: chr(c).lower() for c in range(0x21, 0x7F)}
        for c in map(chr, _LETTERS):
            one = self.library.normalizer.normalize_str(f"a{c}a")
            cut = self.library.pre_tokenizer.pre_tokenize_str(one) if c.isalpha() and len(one) == 3 else ()
            if len(cut) == 1:
                self.form[ord(c)] = cut[0][0][1:-1]
        letters = "A-Za-z" + "".join(chr(c) for c in self.form if c > 0x7F)
        self.plain = re.compile(f"[{letters}0-9{_SIGNS}]+").fullmatch
        self.cut = re.compile(f"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{letters}]+|[0-9]|[{_SIGNS}]+").findall

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), MISSES):
            out += [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts[i : i + MISSES], add_special_tokens=False)]
        return out

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, of many in one call, parted at the pre-tokens' ends."""
        out: list[bytes] = []
        for i in range(0, len(pieces), MISSES):
            some = pieces[i : i + MISSES]
            ids = np.array(self.model.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u2")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(some):
                raise ValueError("every pre-token of this kind of vocabulary ends in a token of its own")
            data, cuts = ids.tobytes(), [0, *(2 * at).tolist()]
            out += [data[x:y] for x, y in zip(cuts, cuts[1:])]
        return out

    def _learn(self, words: list[str]) -> None:
        known, form, parts, others = self.known, self.form, {}, []
        pieces, rest = [], []
        for w in words:  # words of lower-case ASCII letters are pre-tokens as they are
            (pieces if w.isascii() and w.isalpha() and w.islower() else rest).append(w)
        for w in rest:
            if self.plain(w) and "<|" not in w:
                parts[w] = [x.lower() if x.isascii() else x.translate(form) for x in self.cut(w)]
            else:
                others.append(w)
        new = set(chain.from_iterable(parts.values())).difference(pieces) - known.keys()
        if again := new & self.older.keys():
            known.update((x, self.older[x]) for x in again)
            new -= again
        pieces += new
        known.update(zip(pieces, self._ids_of_pieces(pieces), strict=True))
        known.update((w, b"".join(map(known.__getitem__, p))) for w, p in parts.items())
        known.update(zip(others, self._ids(others), strict=True))

    def forget(self) -> None:
        """Drops the words kept, not the tokenizer."""
        self.known, self.older = {"": b""}, {}

    def _bytes_of(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ROWS:
            self.known, self.older = {"": b""}, self.known
        known = self.known
        ids = list(map(known.get, words))
        gaps = [i for i, v in enumerate(ids) if v is None]
        misses = []
        for i in gaps:
            w = words[i]
            if (v := self.older.get(w)) is None:
                misses.append(w)
            else:
                known[w] = v
        self._learn(misses)
        for i in gaps:
            ids[i] = known[words[i]]
        for w in misses:  # the cache holds short words alone, so that its rows bound its bytes
            if len(w) > KEPT_CHARS:
                for x in (w, w.lower(), *(self.cut(w) if self.plain(w) else ())):
                    known.pop(x, None)
                    known.pop(x.translate(self.form), None)
        return ids

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts and where each text's begin; ``end`` follows each text if given."""
        # Lower case of ASCII saves words; special tokens would lose their case by it.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.utf8_split_whitespace(texts)
        if odd := pc.indices_nonzero(pc.match_substring_regex(texts, _NOT_SPACE)).to_pylist():
            lists = cut.to_pylist()
            for i in odd:
                lists[i] = _SPACE.split(texts[i].as_py())
            cut = pa.array(lists, pa.list_(pa.string()))
        per_text = cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        named = cut.flatten().dictionary_encode()
        number = named.indices.to_numpy()
        parts = self._bytes_of(named.dictionary.to_pylist())
        if end is not None:
            number = np.insert(number, np.cumsum(per_text), len(parts))
            parts, per_text = [*parts, np.array([end], "<u2").tobytes()], per_text + 1
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(parts), "<u2")
        n = size[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = data[np.arange(upto[-1]) + np.repeat(begin[number] - upto[:-1], n)]
        return ids, upto[np.concatenate([[0], np.cumsum(per_text)])]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, task, left, rank, ids) of each row; rank counts the rows of this task with the same left-over length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker((path,), lambda: WordEncoder(path))
        task, seen = TaskContext.get().partitionId(), [0] * window
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in runs_of(sizes, BATCH_BYTES):
                ids, bounds = encoder.encode(batch.column(1).slice(a, b - a), end_id)
                left = np.diff(bounds) % window
                rank = []
                for n in left.tolist():
                    rank.append(seen[n])
                    seen[n] += 1
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids)])
                cols = [batch.column(0).slice(a, b - a), pa.array([task] * (b - a), pa.int32()), pa.array(left, pa.int32()), pa.array(rank, pa.int64()), data]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "task", "left", "rank", "ids"])
        encoder.forget()
        scratch.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, task int, left int, rank long, ids binary")


def combinations(hist: np.ndarray, window: int = WINDOW, max_repeat: int = MAX_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, k, b): k pieces of length a and, if b > 0, one of length b fill the window; only lengths that occur."""
    a, k = (x.ravel() for x in np.meshgrid(np.arange(1, window), np.arange(1, max_repeat + 1), indexing="ij"))
    b = window - a * k
    ok = (b >= 0) & (hist[a] >= k) & ((b == 0) | (hist[np.maximum(b, 0)] > 0)) & (a != b) & ~((k == 1) & (a < b))
    ok &= k > 0
    return a[ok], k[ok], b[ok]


def solve_counts(hist: np.ndarray, a: np.ndarray, k: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: x >= 0 that brings the lengths used near the histogram, by accelerated projected gradient."""
    if not len(a):
        return np.zeros(0)
    kf, has = k.astype(float), (b > 0).astype(float)
    used = lambda x: np.bincount(a, kf * x, len(hist)) + np.bincount(b, has * x, len(hist))
    # The largest row sum times the largest column sum bounds the curvature.
    step = 1.0 / (used(np.ones(len(a))).max() * (kf + has).max())
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(rounds):
        gap = used(y) - hist
        new = np.maximum(0.0, y - step * (kf * gap[a] + has * gap[b]))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan_windows(hist: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Where each left-over goes. Slots: rank ranges of a length with their first sequence, pieces in each and offset;
    lengths' ranks beyond their slots are the residue, ordered by length, longest first."""
    hist = hist.astype(np.int64)
    a, k, b = combinations(hist, window)
    want = solve_counts(hist.astype(float), a, k, b)
    left, taken = hist.copy(), np.zeros(len(hist), np.int64)
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0
    for i in np.argsort(-want, kind="stable"):
        n = min(int(want[i] + 0.5), int(left[a[i]] // k[i]), int(left[b[i]]) if b[i] else 1 << 62)
        if n <= 0:
            continue
        for length, times, at in ((a[i], k[i], 0), (b[i], 1, a[i] * k[i])):
            if length:
                slots.append((int(length), int(taken[length]), int(taken[length] + n * times), sequence, int(times), int(at)))
                taken[length] += n * times
                left[length] -= n * times
        sequence += n
    slots.sort()
    size = np.arange(len(hist)) * left
    before = np.concatenate([[0], np.cumsum(size[::-1])])[:-1][::-1]  # tokens of all longer residues
    total = int(size.sum())
    return {"slots": np.array(slots, np.int64).reshape(-1, 6), "taken": taken, "before": before, "first": np.array(sequence), "total": np.array(total)}


def _tail_cuts(n: int) -> list[int]:
    """Ends of the power-of-two runs that make up ``n`` tokens, the longest first."""
    ends, at = [], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def _residue_pieces(start: int, length: int, plan: dict[str, np.ndarray], window: int) -> list[tuple[int, int, int, int]]:
    """(from, to, sequence, offset) of the residue tokens start..start+length of the greedy line."""
    full, total, first = int(plan["total"]) // window, int(plan["total"]), int(plan["first"])
    out, at, end = [], start, start + length
    ends = _tail_cuts(total - full * window)
    while at < end:
        i = at // window
        if i < full:
            lo, hi, sequence = i * window, (i + 1) * window, first + i
        else:
            inside = at - full * window
            j = next(j for j, e in enumerate(ends) if inside < e)
            lo, hi, sequence = full * window + (ends[j - 1] if j else 0), full * window + ends[j], first + full + j
        to = min(end, hi)
        out.append((at - start, to - start, sequence, at - lo))
        at = to
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The operator: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, its ids as little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    rows = scratch.table(tokenized(docs, path, end_id, window, id_col, text_col), "ids")
    counts = rows.groupBy("task", "left").agg(F.count("*").alias("n"))
    counts = scratch.table(counts.withColumn("from", F.sum("n").over(Window.partitionBy("left").orderBy("task")) - F.col("n")), "lengths")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("left").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        hist[r["left"]] = r["n"]
    hist[0] = 0
    plan = scratch.share(spark, plan_windows(hist, window))
    offsets = counts.select("task", "left", "from")
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    numbered = rows.join(offsets, ["task", "left"]).select("doc_id", "task", "left", (F.col("from") + F.col("rank")).alias("place"), "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, whole = plan.value, 0
        slots = p["slots"]
        keys = slots[:, 0] * (1 << 44) + slots[:, 1]
        base = (TaskContext.get().partitionId() + 1) << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, left, rank, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                tokens = np.frombuffer(ids, "<u2")
                n, pieces = len(tokens), []
                for i in range(n // window):
                    pieces.append((i * window, (i + 1) * window, base + whole, 0))
                    whole += 1
                at = n - left
                if left and rank < p["taken"][left]:
                    s = slots[np.searchsorted(keys, left * (1 << 44) + rank, "right") - 1]
                    i = int(rank - s[1])
                    pieces.append((at, n, int(s[3]) + i // int(s[4]), int(s[5]) + i % int(s[4]) * left))
                elif left:
                    start = int(p["before"][left] + (rank - p["taken"][left]) * left)
                    pieces += [(at + x, at + y, q, o) for x, y, q, o in _residue_pieces(start, left, p, window)]
                for x, y, q, o in pieces:
                    part = tokens[x:y].astype("<u4").tobytes()
                    for column, v in zip(out, (doc, x, y - x, zlib.crc32(part), n, q, o, part), strict=False):
                        column.append(v)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return numbered.mapInArrow(place, schema + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
