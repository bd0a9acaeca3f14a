"""Mixing sources to target weights by capped water-filling.

All words are shared out by the sources' weights; a source stops at ``MAX_EPOCHS`` times its size, and what it cannot
take is shared again by weight until no source is above its cap. A source's share is then whole repetitions of all its
documents and a fraction of one: the documents in the order of a seeded hash up to the words that are left, the last of
them in part, so that the words taken meet the target within one word.

Scale and skew: rows are narrow (id, size, source, hash). The seeded order is cut into 4096 hash slices; sums by source
and slice are pre-aggregated, and only the one slice in which a source's share ends is sorted (1/4096 of a source). What
each row takes then follows from its own hash and the row of its source. The water level comes from prefix sums over the sources, which are the rows of a mixture's recipe, not of its data.

Defined results: null text has size 0, a null source is a source of its own, last in order; documents of size 0 take
nothing; rows of one id are ordered by a hash of the text, rows of one id and text by their place in the table;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volumetra.llm import scratch
from volumetra.llm.hostrules import words

WEIGHTS, MAX_EPOCHS, SEED, BROADCAST_SOURCES = (5, 2, 1), 3, "mix-1", 100_000


def sizes(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, h, t, row) and the columns ``keep`` of each row: size in words, h its place in the seeded order, t
    among equal h, row (a number of its own by default) among equal texts."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    t = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    number = F.monotonically_increasing_id() if row is None else row
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), h.alias("h"), t.alias("t"), number.cast("long").alias("row"), *keep)


def water_levels(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    In the order of cap / weight the capped sources come first; the level is what is left over by the remaining weight
    at the first place where the next source stays below its cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = by_source.select("source", "source_size", weight.alias("w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    s = s.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("lambda", first["level"])
    target = F.when(F.col("lambda").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("lambda") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mixture(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The recipe, one row per source: (source, source_size, target, epochs, end_h, end_t, end_row, rest, equal), from ``sizes``.

    Every document is taken ``epochs`` times, once more where its (h, t, row) lies before (end_h, end_t, end_row), and the one
    there with its first ``rest`` words; ``equal`` rows share its h and t.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    levels = water_levels(by_source, weights, max_epochs)
    # A target within rounding of whole epochs has no fraction.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    extra = F.when(F.col("source_size") > 0, F.round(F.col("target") - epochs * F.col("source_size"))).otherwise(F.lit(0))
    plan = levels.select("source", "source_size", "target", epochs.cast("long").alias("epochs"), F.greatest(extra, F.lit(0)).cast("long").alias("extra"))
    plan = scratch.table(plan, "mixture")
    few = plan.count() <= BROADCAST_SOURCES

    # Where a source's share ends: in the order of h; where several documents are there, by text; of equal texts, by row.
    there, ends, budget = rows, None, plan.select("source", "extra")
    for key, part in (("h", F.substring("h", 1, 3)), ("t", F.substring("t", 1, 3)), ("row", F.shiftright("row", 33))):
        end = scratch.table(_end(there, budget, key, part, few), "ends")
        budget = end.select("source", F.col("rest").alias("extra"))
        named = end.select("source", F.col("end").alias(f"end_{key}"), *([F.col("n").alias("equal")] if key == "t" else []), *(["rest"] if key == "row" else []))
        there = joined(there, named.select("source", f"end_{key}"), few).filter(F.col(key) == F.col(f"end_{key}")).drop(f"end_{key}")
        ends = named if ends is None else joined(ends, named, few)
    p = plan.drop("extra").withColumnRenamed("source", "s1")
    return scratch.table(p.join(ends.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2").withColumnRenamed("s1", "source"), "mixture")


def _end(rows: DataFrame, plan: DataFrame, key: str, part: Column, few: bool) -> DataFrame:
    """(source, end, rest, n): in the order of ``key``, cut into the slices ``part``, where each source's ``extra`` words end; n rows are there."""
    rows = rows.withColumn("slice", part)
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    slices = joined(by_slice.withColumn("upto", upto), plan, few)
    ends = slices.filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
    ends = ends.select("source", F.col("slice").alias("end_slice"), (F.col("extra") - F.col("upto") + F.col("n")).alias("budget"))
    # The one slice of each source in which its share ends.
    inside = joined(rows, ends, few).filter(F.col("slice") == F.col("end_slice")).groupBy("source", "budget", key).agg(F.sum("size").alias("tied"), F.count("*").alias("n"))
    run = F.sum("tied").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("run", run).filter((F.col("run") >= F.col("budget")) & (F.col("run") - F.col("tied") < F.col("budget")))
    return last.select("source", F.col(key).alias("end"), (F.col("budget") - F.col("run") + F.col("tied")).alias("rest"), "n")


def joined(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of ``plan`` for their source; broadcast if the sources were counted to be few."""
    p = plan.withColumnRenamed("source", "its_source")
    return rows.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h and more) with source_size, target, ``whole`` repetitions and first words ``part``."""
    out = joined(rows, plan, plan.count() <= BROADCAST_SOURCES)
    before, same = F.col("h") < F.col("end_h"), F.col("h") == F.col("end_h")
    for key in ("t", "row"):
        before, same = before | same & (F.col(key) < F.col(f"end_{key}")), same & (F.col(key) == F.col(f"end_{key}"))
    extra = F.coalesce(F.when(before, F.col("size")).when(same, F.col("rest")), F.lit(0)).cast("long")
    full = (extra == F.col("size")) & (F.col("size") > 0)
    whole = (F.col("epochs") + full.cast("int")).cast("long")
    return out.withColumns({"whole": whole, "part": F.when(full, F.lit(0)).otherwise(extra).cast("long")}).drop("epochs", "end_h", "end_t", "end_row", "rest", "equal", "t", "row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The operator: (doc_id, source, size, h, source_size, target, whole, part) of each row.

    ``whole`` full copies of the document and its first ``part`` words go into the mix. Texts are read once.
    """
    rows = scratch.table(sizes(docs, seed, id_col, text_col, source_col), "sizes")
    return take(rows, mixture(rows, weights, max_epochs))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source and more) once for each repetition, with their text in
    ``mixed``, and for a part once with its first words there. Texts are read twice and never shuffled; they are stored
    once where a source's share ends among rows of one id and text."""
    plan, row = mixture(scratch.table(sizes(docs, seed), "sizes"), weights, max_epochs), F.lit(0)
    if plan.filter("equal > 1").isEmpty():
        plan = plan.withColumn("end_row", F.lit(0).cast("long"))
    else:  # rows with the same id and text: only their stored number tells them apart
        docs, row = scratch.table(docs.withColumn("mix_row", F.monotonically_increasing_id()), "rows"), F.col("mix_row")
        plan = mixture(scratch.table(sizes(docs, seed, row=row), "sizes"), weights, max_epochs)
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "mix_row")).alias("all"), row.alias("mix_row"), *(F.col(c).alias(c) for c in ("doc_id", "text", "source")))
    sized = sizes(rows, seed, row=F.col("mix_row"), keep=("all",))
    text = F.coalesce(F.col("all.text"), F.lit(""))
    part = F.when(F.col("part") > 0, F.array(_first_words(text, F.col("part")))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(text, F.col("whole").cast("int")), part)
    return take(sized, plan).select("all", F.explode(copies).alias("mixed")).select("all.*", "mixed")


def _first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, parted by single spaces."""
    return F.array_join(F.slice(words(text), F.lit(1), n.cast("int")), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS t FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s0),
rounds AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level
  UNION ALL
  SELECT r.i + 1, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (cap < r.level * w), 0)) / sum(w) FILTER (cap >= r.level * w) FROM s)
  FROM rounds r WHERE r.i < 40 AND EXISTS (SELECT 1 FROM s WHERE cap >= r.level * w)),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM rounds)) AS target FROM s),
u AS (SELECT *, floor(target / source_size + 1e-12)::BIGINT AS epochs FROM t),
v AS (SELECT *, greatest(0, round(target - epochs * source_size))::BIGINT AS extra FROM u),
o AS (SELECT d.*, v.source_size, v.target, v.epochs, v.extra,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, t ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (epochs * size + greatest(0, least(size, extra - run + size)))::BIGINT AS taken FROM o
"""
