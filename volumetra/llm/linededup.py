"""Line dedup: lines that many documents hold stay in one of them.

Method: each long line becomes a 128-bit hash with its document and position. The hashes are range-partitioned with
a secondary sort by document (largest first) and position, and one pass over each partition meets the first document
of every hash before the others. What comes back is a run-length bitmap for each document, never text.

Skew: a hash is hot if it has more rows than one task should stream: about a million, less in small tables and, beyond
10^11 lines, 1/131072 of them. Which hashes may be hot is counted on a sample of the rows, so that at most about 262,144
of them (two longs each) are broadcast. For these the number of documents and the largest document are pre-aggregated
map-side over all rows, so that no hot hash meets in one task. Which way a hash takes does not change the result.

Defined results: null or empty text is one empty line; a null doc_id counts as the smallest document; rows that
repeat a doc_id count as one document; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volumetra.llm import scratch

# The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
# A hash is hot from TASK_ROWS rows on, from 1/HOT_SHARE of the rows in small tables, and 1/MOST_HOT of them in huge ones; of
# that many rows about SAMPLED are looked at.
TASK_ROWS, HOT_SHARE, MOST_HOT, SAMPLED = 2**20, 1000, 2**17, 64


def line_key(line: Column) -> Column:
    """The line stripped at both ends with A-Z lower-cased (``lower`` alone would change other letters too)."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(SPACE))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("d"),
        F.xxhash64(text).alias("rid"),
        text.alias("text"),
    )


def line_hashes(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, rid, pos, h1, h2) of each line whose key has ``min_chars`` code points."""
    lines = _prepared(docs, id_col, text_col).select("d", "rid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.filter(F.octet_length("line") >= min_chars).select("d", "rid", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    return lines.select("d", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def hot_from(n: int) -> int:
    """Rows from which a hash is hot among ``n`` rows."""
    return max(1, n // MOST_HOT, min(n // HOT_SHARE, TASK_ROWS))


def _hot(hashes: DataFrame) -> DataFrame:
    """(h1, h2) of the hashes that may be hot: those with half as many sampled rows as a hot one should have, so at most
    about two for each ``hot_from`` rows. The sample decides only how a hash is counted."""
    least = hot_from(hashes.count())
    rate = min(1.0, SAMPLED / least)
    seen = hashes if rate == 1.0 else hashes.sample(rate, seed=1)
    return scratch.table(seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") * 2 >= rate * least).select("h1", "h2"), "hot")


def dropped_lines(hashes: DataFrame, min_docs: int = 3) -> DataFrame:
    """(d, rid, pos) of the lines that go: their hash is in ``min_docs`` documents and not here in the largest. ``hashes`` is
    a stored table, as it is read several times."""
    hot, key = F.broadcast(_hot(hashes)), ["h1", "h2"]
    ordered = hashes.join(hot, key, "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("d"), "pos")
    group = Window.partitionBy("h1", "h2")
    ranked = ordered.withColumn("rank", F.dense_rank().over(group.orderBy(F.desc("d")))).withColumn("docs", F.max("rank").over(group))
    cold = ranked.filter((F.col("rank") > 1) & (F.col("docs") >= min_docs)).select("d", "rid", "pos")
    rows = hashes.join(hot, key, "left_semi")
    known = rows.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    known = F.broadcast(known.filter(F.col("n") >= min_docs))
    return cold.unionAll(rows.join(known, key).filter("d < last").select("d", "rid", "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(d, rid, runs): each document's dropped lines as runs (first, last), its run-length bitmap."""
    at = dropped.groupBy("d", "rid").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    first = "filter(p, (x, i) -> i = 0 or x - p[greatest(i - 1, 0)] > 1)"
    last = "filter(p, (x, i) -> i = size(p) - 1 or p[least(i + 1, size(p) - 1)] - x > 1)"
    return at.selectExpr("d", "rid", f"zip_with({first}, {last}, (a, b) -> struct(a as first, b as last)) as runs")


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: (d, rid, runs) for each document that loses lines. ``d`` is its id, ``rid`` its text's hash."""
    hashes = scratch.table(line_hashes(docs, min_chars, id_col, text_col), "lines")
    return drop_bitmaps(dropped_lines(hashes, min_docs))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again; cost in proportion to the lines."""

    def join(x: Column) -> Column:
        ends = F.array_prepend(F.transform(x["runs"], lambda r: r["last"]), F.lit(-1))
        starts = F.array_append(F.transform(x["runs"], lambda r: r["first"]), F.size(x["lines"]))
        spans = F.zip_with(ends, starts, lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n")))
        parts = F.transform(F.filter(spans, lambda s: s["n"] > 0), lambda s: F.slice(x["lines"], s["at"], s["n"]))
        return F.array_join(F.flatten(parts), "\n")

    return scratch.let(F.struct(lines.alias("lines"), runs.alias("runs")), join)


def with_kept_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped, runs and kept: the bitmaps joined to the texts they belong to.

    Columns of docs by these names are replaced.
    """
    new = ("n_lines", "n_dropped", "runs", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("d"),
        F.xxhash64(text).alias("rid"),
        text.alias("text"),
        F.struct(*(c for c in docs.columns if c not in (*new, text_col))).alias("row"),
        F.col(text_col).isNull().alias("none"),
    )
    marked = base.join(line_bitmaps(docs, min_chars, min_docs, id_col, text_col), ["d", "rid"], "left")
    lines = F.split("text", "\n")
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return marked.select(
        "row.*",
        F.when(~F.col("none"), F.col("text")).alias(text_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
        "runs",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(_kept(lines, F.col("runs"))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM base),
keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM rows),
known AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < n.last, false) AS gone FROM keyed k LEFT JOIN known n ON k.key = n.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
