"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows (``WINDOW`` consecutive words; a shorter item is one window) are sets of
shingles with their offsets, and a document contains a window where all of them stand at one
place. As all are necessary, the prefix that has to be joined is one shingle of each window:

1. **Rarity.** The documents' occurrences of every item shingle are counted. A window with a
   shingle that no document has is done; the others keep their rarest shingle.
2. **Join** of the documents' shingles with these. An occurrence gives one possible start;
   the positional and the length bound drop those where the window would begin before the
   document or end after it.
3. **Verification.** The document's words from that start on are the window's words.

Shingles have 4 words, or 2 or 1 where the window has fewer. Their hashes are made by
doubling, so each size costs one more step over the words. The documents are split into words
once, and these are written. Item shingles are broadcast in blocks of bounded size, each in a
scan of its own over those words, so no shingle of a document is ever shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemill.llm.common import table
from tablemill.session import materialize

WINDOW = 10
SIZES = (4, 2, 1)
"""Words of a shingle; a window takes the largest that it holds."""
BLOCK_ROWS = 100_000
"""Item shingles that are broadcast at once ..."""
BLOCK_BYTES = 8 << 20
"""... and bytes of their windows' words, up to one window more."""

# What separates words, as a pattern and as single characters.
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BETWEEN = "".join(c for c in map(chr, range(128)) if c not in string.digits + string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none."""
    # lower() is far quicker, but knows other letters than A-Z as well
    ascii_ = F.octet_length(text) == F.length(text)
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    trimmed = F.btrim(low, F.lit(_BETWEEN))
    return F.when(F.coalesce(trimmed == "", F.lit(True)), F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAPS))


def shingles(words: Column, size: int) -> Column:
    """Hash of the ``size`` words (1, 2, 4 ...) from each place on at which so many are left."""
    if size == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    half = size // 2
    # a lambda's variable, so that the half's hashes are made once
    def doubled(h: Column) -> Column:
        n = F.greatest(F.size(h) - half, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + half, n), lambda a, b: F.xxhash64(a, b))

    return F.get(F.transform(F.array(shingles(words, half)), doubled), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window_id, words, size, shingles) of the different windows; (window_id, item_id)."""
    words = items.select("item_id", words_of(F.col("text").cast("string")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    each = words.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all", F.col("at"), window).alias("words")
    ).distinct()
    size = F.lit(SIZES[-1])
    made = shingles(F.col("words"), SIZES[-1])
    for s in reversed(SIZES[:-1]):
        size = F.when(F.size("words") >= s, s).otherwise(size)
        made = F.when(F.size("words") >= s, shingles(F.col("words"), s)).otherwise(made)
    different = materialize(
        each.select("words").distinct().select(
            F.monotonically_increasing_id().alias("window_id"), "words", size.alias("size"), made.alias("shingles")
        ),
        "windows",
    )
    return different, materialize(each.join(different, "words").select("window_id", "item_id"), "window-items")


def _blocks(df: DataFrame, key: str, bytes_: Column | None = None) -> list[DataFrame]:
    """``df`` in parts that may be broadcast, dealt by a hash of ``key``."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(bytes_ if bytes_ is not None else F.lit(8)), F.lit(0))).first()
    n = max(1, -(-2 * rows // BLOCK_ROWS), -(-2 * size // BLOCK_BYTES))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def _occurrences(documents: DataFrame, size: int) -> DataFrame:
    """``documents`` (with ``words``) with ``at`` and ``shingle``, a row for each place."""
    return documents.select("*", F.posexplode(shingles(F.col("words"), size)).alias("at", "shingle"))


def rare_shingles(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, words, size, shingle, offset): the rarest shingle of each window that may occur."""
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())
    counts = None
    for s in sizes:
        wanted = materialize(windows.where(F.col("size") == s).select(F.explode("shingles").alias("shingle")).distinct(), "shingles")
        for block in _blocks(wanted, "shingle"):
            found = _occurrences(documents.select("words"), s).select("shingle").join(F.broadcast(block), "shingle")
            n = found.groupBy("shingle").agg(F.count("*").alias("n")).select(F.lit(s).alias("size"), "shingle", "n")
            counts = n if counts is None else counts.unionByName(n)
    if counts is None:
        counts = windows.select("size", F.lit(0).cast("long").alias("shingle"), F.lit(0).cast("long").alias("n")).where("false")
    each = windows.select("window_id", "size", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = (
        each.join(counts, ["size", "shingle"], "left")
        .groupBy("window_id")
        .agg(
            F.min(F.coalesce("n", F.lit(0))).alias("least"),
            F.min(F.struct(F.coalesce("n", F.lit(0)), "shingle", "offset")).alias("rarest"),
        )
        .where("least > 0")
    )
    return materialize(
        rarest.join(windows.drop("shingles"), "window_id").select(
            "window_id", "words", "size", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")
        ),
        "rare-shingles",
    )


def window_matches(documents: DataFrame, rare: DataFrame) -> DataFrame:
    """(rid, start, length, window_id): every occurrence of a window in a document.

    ``documents``: (rid, words).
    """
    out = documents.select(
        "rid", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("window_id")
    ).where("false")
    for s in sorted(r.size for r in rare.select("size").distinct().collect()):
        bytes_ = F.octet_length(F.array_join("words", " ")) + 16 * F.size("words")
        for block in _blocks(rare.where(F.col("size") == s), "window_id", bytes_):
            prefix = block.select("shingle", "offset", "window_id", F.col("words").alias("window"))
            start = F.col("at") - F.col("offset")
            length = F.size("window")
            met = (
                _occurrences(documents.select("rid", "words"), s)
                .join(F.broadcast(prefix), "shingle")
                .where((start >= 0) & (start + length <= F.size("words")))
                # the bounds hold from here on, so that the slice is one
                .where(F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window"))
            )
            out = out.unionByName(met.select("rid", start.alias("start"), length.alias("length"), "window_id"))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``spans`` and ``items``.

    ``spans``: array of (first, last) word numbers, from 0 and inclusive, that lie in an
    occurrence of a window; ``items``: the ids of the items with such windows, by value. Both
    are empty, not null, where nothing occurs.

    Null and empty texts have no words, on either side; an item without words has no window.
    Rows of one item id are one item with all their windows; an item without an id marks
    words but isn't listed. Null document ids and repeated documents: a row each. Empty
    tables: no rows, or no spans. Columns of ``docs`` with the names made here are replaced.
    """
    made = ("n_words", "spans", "items")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]).alias("row")
    words = words_of(F.col("text").cast("string"))
    base = materialize(docs.select(row, words.alias("words")).select("row", "words", F.monotonically_increasing_id().alias("rid")), "words")
    windows, listed = item_windows(items, window)
    matches = materialize(window_matches(base.select("rid", "words"), rare_shingles(base.select("words"), windows)), "matches")

    # matches of one document, which its length bounds, are added up along its words
    along = W.partitionBy("rid").orderBy("start")
    reach = F.max(F.col("start") + F.col("length")).over(along.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)
    spans = (
        matches.select("rid", "start", "length")
        .distinct()
        .withColumn("reach", reach)
        .withColumn("span", F.sum(begins).over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("rid", "span")
        .agg(F.min("start").alias("first"), (F.max(F.col("start") + F.col("length")) - 1).alias("last"))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    )
    ids = (
        matches.select("rid", "window_id")
        .distinct()
        .join(listed, "window_id")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    found = spans.join(ids, "rid", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(found.dtypes)[c])).alias(c)
    return base.select("row", "rid", F.size("words").cast("long").alias("n_words")).join(found, "rid", "left").select(
        "row.*", "n_words", none("spans"), none("items")
    )


def op12_prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op12_prefix_containment": op12_prefix_containment}

ORACLES = {
    "op12_prefix_containment": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + 9], ' ') AS t, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), place AS (
  SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS t
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT rid, i, n, item_id FROM place JOIN win USING (t, n)
), hits AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)
"""
}
