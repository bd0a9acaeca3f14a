"""Quality rules for documents, with a verdict on the host they come from.

Each text gets its counts from array functions (nothing is exploded, no Python). Four rules read them (``failures``): the
base rule, too many symbols, too many repeated lines, words of odd length. Failures are aggregated by host. For each rule a
beta prior is fitted to the rates of all hosts by the method of moments, and every host's rate is shrunk towards it. A
host is rejected with all its documents if a shrunken rate lies above the rule's limit: two standard deviations above the
prior's mean, but from ``MAX_HOST_RATE`` to ``TOP_LIMIT``. The verdict is joined back.

Scale and skew: the counts are written once, so texts are read once. The aggregation is partial, so a host with a third
of all rows sends one row from each task. Rejected hosts are broadcast only if at most ``BROADCAST_HOSTS`` were counted;
otherwise the join shuffles the narrow count rows and adaptive execution splits its skewed partitions.

Defined results: null or empty text has no words (all counts 0, base_failed true); a null host is a host of its own;
repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import scratch
from volumetra.llm.scratch import let

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE, TOP_LIMIT, BROADCAST_HOSTS = 50, 50, 0.5, 0.9, 100_000
#: Symbols and repeated lines per hundred words, and characters per word, beyond which a text fails a rule of its host.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 20, 10, (2, 20)
# White space, and the symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Bits for the position when a hash and a position share a long.
_POS = 20


def words(text: Column) -> Column:
    """The words of a text; an empty array if there are none."""
    parts = F.split(text, SPACE + "+")
    return F.when(F.regexp_like(text, F.lit("^" + SPACE)) | F.regexp_like(text, F.lit(SPACE + r"\z")) | (text == ""), F.filter(parts, lambda w: w != "")).otherwise(parts)


def _covered(at: Column) -> Column:
    """Words in 3-word windows that start at the sorted positions ``at``."""
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(gaps, F.lit(0), lambda n, g: n + g.cast("int")))


def _repeated_at(grams: Column) -> Column:
    """Sorted positions of the hashes that are there twice or more.

    Hash and position share one long where no two hashes of the text agree in the upper bits (a sort of plain longs);
    else, or in texts of over 2**20 words, pairs are sorted.
    """
    low = (1 << _POS) - 1

    def twice(s: Column, key) -> Column:
        same = lambda a, b: key(s[a]) == key(s[b])
        n = F.size(s)
        return F.filter(s, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(F.least(i + 1, n - 1), i)))

    packed = F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    upper = F.transform(grams, lambda h: F.shiftright(h, _POS))
    plain = let(F.sort_array(packed), lambda s: F.transform(twice(s, lambda x: F.shiftright(x, _POS)), lambda x: x.bitwiseAND(F.lit(low))))
    pairs = let(
        F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))),
        lambda s: F.transform(twice(s, lambda x: x["h"]), lambda x: x["i"]),
    )
    fits = (F.size(grams) <= low) & (F.size(F.array_distinct(upper)) == F.size(F.array_distinct(grams)))
    return F.sort_array(F.when(fits, plain).otherwise(pairs))


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        grams = let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2])))
        count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(_repeated_at(g), _covered)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(count)

    return of(tokens).cast("long")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))

    def measure(x: Column) -> Column:
        w, t = x["w"], x["t"]
        lines = F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    m = base.select("doc_id", "host", let(F.struct(words(F.col("text")).alias("w"), F.col("text").alias("t")), measure).alias("m"))
    m = m.select("doc_id", "host", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.withColumn("base_failed", failed)


def failures() -> dict[str, Column]:
    """Rules over the counts of a text; true where it fails."""
    n = F.col("n_words")
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * n,
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * n,
        "lengths": (F.col("word_chars") < WORD_LENGTH[0] * n) | (F.col("word_chars") > WORD_LENGTH[1] * n),
    }


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, rejected) of each host; failed and rate are those of the base rule.

    With mean m and variance v of a rule's rates over the hosts (each host counts once), its prior is beta(m k, (1-m) k)
    with k = m (1-m) / v - 1, at least 1; without spread or with one host k is 1.
    """
    rules = failures()
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()])
    raw = {r: F.col(r) / F.col("n") for r in rules}
    prior = hosts.agg(*[f(c).alias(f"{r}_{x}") for r, c in raw.items() for x, f in (("m", F.avg), ("v", F.var_pop))]).first()
    rate, rejected = {}, F.lit(False)
    for r in rules:
        m, v = prior[f"{r}_m"] or 0.0, prior[f"{r}_v"] or 0.0
        k = max(1.0, m * (1 - m) / v - 1) if v > 0 else 1.0
        rate[r] = (F.col(r) + F.lit(m * k)) / (F.col("n") + F.lit(k))
        rejected = rejected | (rate[r] > max(max_rate, min(TOP_LIMIT, m + 2 * v**0.5)))
    return hosts.select("host", "n", F.col("base").alias("failed"), rate["base"].alias("rate"), rejected.alias("rejected"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The operator: the counts of each row and ``kept``."""
    counts = scratch.table(rule_counts(docs, id_col, text_col, host_col), "rules")
    rejected = host_verdicts(counts, max_rate).filter("rejected").select(F.col("host").alias("bad"), F.lit(True).alias("host_rejected"))
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    joined = counts.join(rejected, counts["host"].eqNullSafe(F.col("bad")), "left").drop("bad")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_rejected").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT b.doc_id, b.source, len(b.w)::BIGINT AS n_words, length(array_to_string(b.w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(b.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN dups d ON b.doc_id = d.doc_id LEFT JOIN covered c ON b.doc_id = c.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, unnest(['base', 'symbols', 'lines', 'lengths']) AS rule,
    unnest([sum(base_failed::INT), sum((100 * n_symbols > 20 * n_words)::INT), sum((100 * n_dup_lines > 10 * n_words)::INT),
      sum((word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT)])::DOUBLE AS failed FROM f GROUP BY source),
p AS (SELECT rule, avg(failed / n) AS m, var_pop(failed / n) AS v FROM h GROUP BY rule),
k AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS k,
    greatest(0.5, least(0.9, m + 2 * sqrt(v))) AS top FROM p),
bad AS (SELECT source, bool_or((failed + m * k) / (n + k) > top) AS rejected FROM h JOIN k USING (rule) GROUP BY source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT rejected) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""
