"""Quality rules with cross-document line frequency, in DataFrame functions only.

A document is judged by its own words first. Then its lines are normalised and hashed, and
for each host (``source``) the documents that hold a line are counted, copies of one text
once. Lines above the limit are boilerplate: they go, and a document that loses most of its
words with them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import SPACE, table

MIN_WORDS = 50
LINE_SHARE = 0.05
"""A line is boilerplate when more than this share of its host's texts hold it ..."""
LINE_TEXTS = 20
"""... and more than so many texts."""
LINE_MOST = 1000
"""Or, however large its host, when more than so many texts of the host hold it."""
KEEP_SHARE = 0.5
"""A document that keeps less than this share of its words is depleted."""

_GAPS = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAPS))


def repeated_words(windows: Column) -> Column:
    """Words inside windows of three words that the text has twice or more.

    ``windows`` has the hash of the window at each start. Sorted with their starts, equal
    windows are neighbours; each start found adds three words less its overlap with the next.
    """

    def from_sorted(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        starts = F.filter(
            F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])),
            lambda i: i.isNotNull(),
        )
        return _bind(F.array_sort(starts), covered)

    def covered(p: Column) -> Column:
        steps = F.zip_with(
            p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _bind(F.array_sort(pairs), from_sorted)
    )


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again for each element it looks up."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    words = words_of(text)

    def window_hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        each = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(3))))
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(each)

    # each figure binds what it needs, so that it stays cheap wherever a filter on it is moved
    return (
        docs.withColumn("_words", words)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _bind(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn(
            "n_repeat_words", _bind(F.col("_words"), lambda w: _bind(window_hashes(w), repeated_words)).cast("long")
        )
        .drop("_words")
        .withColumn(
            "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        )
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """(row_key, host, text_hash, pos, line, n): normalised lines with words, and how many.

    A null source is a host of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    line = F.posexplode(F.split(text, "\n"))
    normal = F.lower(F.btrim(F.regexp_replace("line", _GAPS, " ")))
    # the words of a normalised line are one more than its blanks
    n = F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) + 1
    return (
        docs.select(
            "row_key", F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("host"), F.xxhash64(text).alias("text_hash"), line.alias("pos", "line")
        )
        .select("row_key", "host", "text_hash", "pos", normal.alias("normal"))
        .where("normal != ''")
        .select("row_key", "host", "text_hash", "pos", F.xxhash64("normal").alias("line"), n.alias("n"))
    )


def frequent_lines(lines: DataFrame, share: float = LINE_SHARE, least: int = LINE_TEXTS, most: int | None = LINE_MOST) -> DataFrame:
    """(host, line, by_share, by_number) held by more than ``least`` of the host's different texts, and
    by more than ``share`` of them or by more than ``most``; None: the share alone decides."""
    texts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    held = (
        lines.select("host", "line", "text_hash")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_texts"))
        .where(F.col("n_texts") > least)
    )
    by_share = F.col("n_texts") > share * F.col("texts")
    by_number = F.lit(False) if most is None else F.col("n_texts") > most
    return held.join(texts, "host").where(by_share | by_number).select(
        "host", "line", by_share.alias("by_share"), by_number.alias("by_number")
    )


def apply_rules(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_TEXTS, most: int | None = LINE_MOST) -> DataFrame:
    """``docs`` with the base figures, ``removed_words``, ``kept`` and ``cleaned``.

    ``lines_by_share`` and ``lines_by_number`` say how many removed lines each condition of
    :func:`frequent_lines` gives; lines that meet both are in both.

    ``cleaned`` is the text without its boilerplate lines. Null text: no words, rejected.
    Null source: a host of its own. Repeated rows count as one text and each gets its row.
    Empty table: no rows. Columns of ``docs`` stay, whatever their names; those called like
    a column of the result are replaced.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "removed_words", "lines_by_share", "lines_by_number", "kept", "cleaned",
    ]
    stay = [c for c in docs.columns if c not in made]
    # other columns travel as one, away from the names used on the way
    others = F.struct(*[F.col(f"`{c}`") for c in stay if c != "text"]).alias("others")
    row_key = F.xxhash64("doc_id", F.coalesce("source", F.lit("\0")), F.coalesce("text", F.lit("\0"))).alias("row_key")
    keyed = docs.select(others, "source", "text", row_key)
    lines = line_rows(keyed)
    # rows of one key are equal in id, source and text: their lines count once
    loss = (
        lines.dropDuplicates(["row_key", "pos"])
        .join(frequent_lines(lines, share, least, most), ["host", "line"])
        .groupBy("row_key")
        .agg(
            F.collect_set("line").alias("boilerplate"),
            F.sum("n").alias("lost"),
            *(F.sum(F.col(f"by_{c}").cast("long")).alias(f"lines_by_{c}") for c in ("share", "number")),
        )
    )
    judged = base_rules(keyed).join(loss, "row_key", "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = lambda x: F.xxhash64(F.lower(F.btrim(F.regexp_replace(x, _GAPS, " "))))
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("boilerplate", hashed(x)))
    cleaned = F.when(F.col("boilerplate").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return (
        judged.withColumn("cleaned", cleaned)
        .withColumn("removed_words", F.coalesce("lost", F.lit(0)).cast("long"))
        .withColumn("lines_by_share", F.coalesce("lines_by_share", F.lit(0)).cast("long"))
        .withColumn("lines_by_number", F.coalesce("lines_by_number", F.lit(0)).cast("long"))
        .withColumn(
            "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= KEEP_SHARE * F.col("n_words"))
        )
        .select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in stay], *made)
    )


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


QUERIES = {"op4_line_frequency": op4_line_frequency}

ORACLES = {
    "op4_line_frequency": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g), (VALUES (0), (1), (2)) AS k(k)
  WHERE c > 1 GROUP BY rid
), ln AS (
  SELECT rid, host, t, l,
    lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY rid
), hosts AS (
  SELECT host, count(DISTINCT t) AS texts FROM ln GROUP BY host
), freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM ln GROUP BY host, norm) JOIN hosts USING (host)
  WHERE n > 20 AND (n > 0.05::DOUBLE * texts OR n > 1000)
), gone AS (
  SELECT rid, sum(len(string_split(norm, ' '))) AS removed_words FROM ln JOIN freq USING (host, norm) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed,
  coalesce(removed_words, 0)::BIGINT AS removed_words,
  NOT (len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws))
    AND len(ws) - coalesce(removed_words, 0) >= 0.5 * len(ws) AS kept
FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
"""
}
