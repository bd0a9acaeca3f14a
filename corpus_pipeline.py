"""The corpus pipeline: five stages over ``documents``, each by one operator of volumetra.llm.

Every stage gets what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of documents. Tables that a stage has written for itself, and values it has shared, are deleted when the next stage begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import linededup, mixing, ngramjoin, packing, quality, scratch
from volumetra.llm.tokencount import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_IDS = 500_000
#: Rows that go to Python at once: whole texts and their words, so that a worker's peak is that of few documents.
BATCH_ROWS = 1000
#: Tables of the stage that ran last, and stage outputs that its result may still be read from.
_TABLES: list[str] = []
_OUTPUTS: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage sees the columns of documents; when it begins, what the stage before it wrote for itself is deleted."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear(spark, _TABLES)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with scratch.scope(_TABLES):
            return f(spark, docs.select(*COLUMNS), sf_dir)

    return run


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with ``text`` as the text and its length in code points."""
    return df.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents go whose probability of label 1 is below one half."""
    pooler, network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, pooler, network).filter("score >= 0.5").select(*COLUMNS)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that three documents hold stay in the one with the largest id; a document left without lines goes."""
    marked = linededup.with_kept_lines(docs)
    return _with_text(marked.filter("n_dropped < n_lines"), "kept")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram join: of each class of linked documents the one with the smallest id stays; where ids repeat, rows are documents."""
    key = "doc_id"
    if ngramjoin.ids_repeat(docs):
        key, docs = "row", ngramjoin.with_rows(docs)
        found, least = ngramjoin.row_classes(docs)
        gone = found.join(least.select("least.row"), "row", "left_anti")
    else:
        gone = ngramjoin.similarity_classes(docs).filter(~F.col("class_id").eqNullSafe(F.col("doc_id")))
    gone = scratch.table(gone.select(key), "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone.withColumnRenamed(key, "gone"), F.col(key).eqNullSafe(F.col("gone")), "left_anti").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: one row for each whole repetition of a document, and one with its first words for a part."""
    return _with_text(mixing.repeated(docs), "mixed")


@stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram join", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack windows", pack_windows),
]

#: The first stage is a trained model, so that no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows lie in the shared folder, until the stage after the next begins (the
    last ones until the next run)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{scratch.root(spark)}/pipeline-{uuid.uuid4().hex}"
    scratch.clear(spark, _OUTPUTS)
    for i, (_, function) in enumerate(STAGES):
        out = function(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        scratch.clear(spark, _OUTPUTS)
        _OUTPUTS.append(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
