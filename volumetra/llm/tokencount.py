"""Token counts of whole texts, by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths, in tokens, of frequent pieces; tier two is a bounded cache in each Python
worker that holds what the table lacks, encoded by the tokenizer's own library. A piece is a run without white space,
with the single space before it: pre-tokens never cross its ends, so the counts of pieces add up to the count of the
text. No piece is ever shuffled; the plan is one scan and one Arrow map.

The table comes from a sample of about ``SAMPLE_DOCS`` documents from all partitions, whose pieces are counted where they
lie; it has at most ``TABLE_ROWS`` pieces. It only saves work: any table gives the same counts.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; extra columns are
ignored; strings of special tokens inside a text are read as the library reads them by default.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_DOCS, TABLE_ROWS, CACHE_ROWS, BATCH_CHARS, MISSES = 4096, 60_000, 150_000, 200_000, 4096
#: Pieces that a task tells of, and characters of a piece that is kept in a table or cache.
TASK_PIECES, KEPT_CHARS = 20_000, 40
#: Where a text is not a plain run of words parted by single spaces and line feeds; such texts are cut by _CAREFUL.
_ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
#: A piece that stands alone wherever it is: a run without white space, with its one space, or all the rest.
_CAREFUL = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def open_tokenizer(path: str):
    """The library's tokenizer, on the one core of its task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_OPEN: dict[tuple, object] = {}


def of_worker(key: tuple, make: Callable[[], object]):
    """What this worker process made for ``key``; only the last key's is kept."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = make()
    return _OPEN[key]


class PieceCounter:
    """Counts tokens with the table first and its own cache second."""

    def __init__(self, path: str, table: dict[str, int]):
        self.library = open_tokenizer(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table, self.known = table, dict(table)

    def encode(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), MISSES):
            out += [len(e.ids) for e in self.library.encode_batch_fast(texts[i : i + MISSES], add_special_tokens=False)]
        return out

    def pieces(self, text: str) -> list[str] | None:
        """Pieces whose counts add up to the text's; None if the text has to be encoded whole."""
        if not text:
            return []
        if any(a in text for a in self.added):
            return None
        if _ODD.search(text) is None:
            lines = text.split("\n")
            out: list[str] = ["\n"] * (len(lines) - 1)
            for line in lines:
                first, *rest = line.split(" ")
                out.append(first)
                out += [" " + x for x in rest]
            return out
        first, *rest = _CAREFUL.split(text)
        return [first, *(" " + x for x in rest)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > len(self.table) + CACHE_ROWS:
            self.known = dict(self.table)
        misses = list(set(chain.from_iterable(c for c in cut if c)) - self.known.keys())
        if misses:
            self.known.update(zip(misses, self.encode(misses), strict=True))
        of = self.known.__getitem__
        out = [self.encode([t])[0] if c is None else sum(map(of, c)) for t, c in zip(texts, cut, strict=True)]
        for p in misses:  # short pieces alone stay, so that the cache's rows bound its bytes
            if len(p) > KEPT_CHARS:
                del self.known[p]
        return out


def frequent_pieces(docs: DataFrame, text_col: str, path: str) -> dict[str, int]:
    """Lengths of the most frequent pieces of a bounded sample: counted by task, then summed; TABLE_ROWS rows at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counter, found = PieceCounter(path, {}), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(p for p in counter.pieces(text or "") or [] if len(p) <= KEPT_CHARS)
        top = [(p, n) for p, n in found.most_common(TASK_PIECES) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    every = max(1, docs.count() // SAMPLE_DOCS)
    rows = docs.select(F.col(text_col).alias("text")).filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    counted = rows.mapInArrow(cut, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(TABLE_ROWS).collect()]
    return dict(zip(top, PieceCounter(path, {}).encode(top), strict=True))


def runs_of(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum up to about ``most``, so that long texts don't pile up."""
    start = size = i = 0
    for i, n in enumerate(sizes, 1):
        size += int(n)
        if size >= most:
            yield start, i
            start, size = i, 0
    if start < i:
        yield start, i


def small_batches(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``most`` characters each."""
    return runs_of(map(len, texts), most)


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out_col``, the number of tokens of ``text_col``."""
    spark = docs.sparkSession
    table, key = spark.sparkContext.broadcast(frequent_pieces(docs, text_col, path)), uuid.uuid4().hex
    kept = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    names = [*kept, *({text_col} - set(kept))]
    at, places = names.index(text_col), [names.index(c) for c in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_worker((path, key), lambda: PieceCounter(path, table.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for a, b in small_batches(texts, BATCH_CHARS):
                n[a:b] = counter.count(texts[a:b])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(n)], [*kept, out_col])

    schema = docs.select(*kept).schema.add(out_col, "long")
    return docs.select(*names).mapInArrow(count, schema)


def count_query(path: str, limit: int = 1024) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        sized = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
        out = with_token_counts(sized, path, keep=["doc_id", "n_bytes"])
        return out.withColumn("over_limit", F.col("n_tokens") > limit)

    return query


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_query(vocabulary("byte_bpe_50k.json"))(spark, sf_dir)
