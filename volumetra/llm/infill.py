"""Fill-in-middle transformation: texts cut at two unit borders and laid out as prefix, suffix, middle or suffix, prefix, middle.

A unit is a word with the white space before it, or the white space at the end of a text. Which byte ends a unit shows in
UTF-8 itself, as white space is ASCII: a byte outside white space before one inside, and the text's last byte. The bytes of
a run of texts are viewed as 64-bit words, eight bytes a word; white space and unit ends are marked in the high bit of each
byte by arithmetic on whole words. ``bitwise_count`` gives the ends in each word and their running sum the rank of any place.
The k-th end of a text is selected by a binary search for its word and arithmetic within the word. Python returns three
numbers a text (an Arrow function); the text is cut, laid out and restored by column expressions, and is never sent back.

Scale: one scan, no shuffle, no state. Memory is in proportion to an Arrow batch, or to its longest text.

Defined results: null text counts as empty, and is plain; a null id hashes as an empty string; repeated rows are
transformed one by one, alike if their ids are; a text that holds one of the three marks is plain; columns that the
operator adds replace those of the same name, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm.tokencount import runs_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts that are marked at once, and words of them that lie in a processor's cache.
RUN_BYTES, PART = 1 << 22, 1 << 14
CUTS = "n long, first int, second int"
_ONES = np.uint64(0x0101010101010101)
_HIGH = _ONES * np.uint64(0x80)
_LOW = _ONES * np.uint64(0x7F)
_TOP, _BYTE, _SEVEN = np.uint64(56), np.uint64(8), np.uint64(7)


def spaces(w: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or in 0x09 to 0x0D; no sum or difference crosses a byte."""
    low = w & _LOW
    control = (low + _ONES * np.uint64(0x80 - 0x09)) & ~(low + _ONES * np.uint64(0x80 - 0x0E)) & ~w
    other = w ^ (_ONES * np.uint64(0x20))
    blank = ~(((other & _LOW) + _LOW) | other)
    return (control | blank) & _HIGH


class Units:
    """Unit ends of texts that lie one after another in ``data``, text i from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.bounds = bounds.astype(np.int64)
        size = len(data) // 8 + 1
        raw = np.full(8 * (size + 1), 0x20, np.uint8)
        raw[: len(data)] = data
        words = raw.view("<u8")
        self.ends = np.zeros(size, np.uint64)
        for i in range(0, size, PART):
            j = min(size, i + PART)
            space = spaces(words[i : j + 1])
            after = (space[:-1] >> _BYTE) | (space[1:] << _TOP)
            self.ends[i:j] = after & ~space[:-1]
        a, b = self.bounds[:-1], self.bounds[1:]
        self.ends.view(np.uint8)[b[b > a] - 1] = 0x80
        self.sums = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many ends lie before each byte."""
        word = place >> 3
        below = (np.uint64(1) << ((place & 7).astype(np.uint64) * _BYTE)) - np.uint64(1)
        return self.sums[word] - np.bitwise_count(self.ends[word] & ~below).astype(np.int64)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th end, counted from 1 over all texts."""
        word = np.searchsorted(self.sums, k)
        flags = self.ends[word]
        left = (k - self.sums[word] + np.bitwise_count(flags)).astype(np.uint64)
        upto = ((flags >> _SEVEN) & _ONES) * _ONES  # byte j: ends in bytes 0 to j
        reached = ((upto | _HIGH) - left * _ONES) & _HIGH
        return word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)

    def cuts(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's units and the bytes before its middle and before its suffix."""
        start, before = self.bounds[:-1], self.rank(self.bounds[:-1])
        n = self.rank(self.bounds[1:]) - before
        x, y = h1 % (n + 1), h2 % (n + 1)
        at = [np.where(k > 0, self.after(np.maximum(before + k, 1)) - start, 0) if len(n) and self.sums[-1] else np.zeros_like(n) for k in (np.minimum(x, y), np.maximum(x, y))]
        return n, *at


def _cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    raw = text.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset) if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    one, two = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
    found = [np.zeros(len(raw), np.int64) for _ in range(3)]
    for a, b in runs_of(np.diff(offsets), RUN_BYTES):
        units = Units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for out, part in zip(found, units.cuts(one[a:b], two[a:b]), strict=True):
            out[a:b] = part
    return pa.StructArray.from_arrays([pa.array(found[0]), *(pa.array(x.astype(np.int32)) for x in found[1:])], ["n", "first", "second"])


def cut_places(text: Column, h1: Column, h2: Column) -> Column:
    """(n, first, second): units of a text that is not null, and the bytes before its middle and its suffix."""

    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return _cut(text, h1, h2)

    return F.arrow_udf(cut, CUTS)(text, h1, h2)


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form: a mark occurs once in it, where it was put."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: ``docs`` with n (units), form, output, prefix_chars and middle_chars.

    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of these with the suffix first.
    """
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    kept = F.struct(*(c for c in docs.columns if c not in new))
    base = docs.select(kept.alias("row"), text.alias("text"), digest.alias("h"))
    base = base.select("row", "text", *(x.alias(f"h{i + 1}") for i, x in enumerate(h)))
    cut = base.withColumn("cut", cut_places(F.col("text"), F.col("h1"), F.col("h2")))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    raw, a, b = F.col("text").cast("binary"), F.col("cut.first"), F.col("cut.second")
    piece = lambda start, size: F.substr(raw, start + 1, size).cast("string")
    parts = cut.select(
        "row",
        "text",
        F.col("cut.n").alias("n"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        piece(F.lit(0), a).alias("p"),
        piece(a, b - a).alias("m"),
        piece(b, F.octet_length("text") - b).alias("s"),
    )
    p, s, m = F.concat(F.lit(PREFIX), "p"), F.concat(F.lit(SUFFIX), "s"), F.concat(F.lit(MIDDLE), "m")
    changed, length = F.col("form") != "plain", lambda c: F.char_length(c).cast("long")
    output = F.when(~changed, F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return parts.select("row.*", "n", "form", output.alias("output"), F.when(changed, length("p")).alias("prefix_chars"), F.when(changed, length("m")).alias("middle_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS units FROM d),
k AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
             array_to_string(units[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
