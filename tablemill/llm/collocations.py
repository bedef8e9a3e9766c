"""Phrases of words that stand together more often than their parts explain.

Everything is counted per language. In a text, pieces end at punctuation and line ends, and a
phrase is a stretch of up to ``LONGEST`` words of one piece.

1. **Candidates.** Every occurrence is a hash code; the range of codes is cut into parts.
   Chunks of texts count their codes, and a part merges these counts into one Misra-Gries
   summary. Its capacity is ``SLACK`` times the part's occurrences (announced before the
   counts) divided by the threshold: a summary is off by less than its mass divided by its
   capacity, so a code as frequent as the threshold always survives, however the merges fall.
   Codes that collide only add up, which loses nothing.
2. **Exact counts.** The survivors set bits in a map of bounded size. A second pass over the
   texts counts the phrases whose bits are set, by their words, and only those count that
   reach the threshold.
3. **Scores** are joins of the frequent phrases with each other: every part of a frequent
   phrase is frequent, so its count is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemill.llm.common import mix, pack, stored, table, unpack
from tablemill.session import materialize

LONGEST = 5
LEAST = 100
REPORT = 2000
SLACK = 4
CHUNK_BYTES = 1 << 22
"""Text that is counted together; a longer one is cut where a piece ends."""
PART_BYTES = 1 << 23
"""Text whose phrases one part holds."""
MOST_PARTS = 1 << 14
ADD_ROWS = 1 << 20
"""Rows of exact counts that a part holds before it adds them up."""
MOST_BITS = 1 << 26
"""Bits of the survivors' map at most; above, more phrases than needed are counted."""

_STOP = b"."
_LOWER = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _STOP * 9 + b" "
)
_TOTAL = ""


def _chunks(batches) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts in lower case with one mark for all ends of pieces)."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text.translate(_LOWER)
            while text:
                cut = text.find(_STOP, CHUNK_BYTES) + 1 or len(text)
                langs.append(lang)
                texts.append(text[:cut])
                held += cut
                text = text[cut:]
                if held >= CHUNK_BYTES:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


class Phrases:
    """The words of a chunk by number, 0 where a piece ends, and the codes of its phrases."""

    def __init__(self, langs: list[str], texts: list[bytes], bits: int):
        split = [t.replace(_STOP, b" . ").split() + [_STOP] for t in texts]
        flat = [w for words in split for w in words]
        numbers = {_STOP: 0}
        for w in dict.fromkeys(flat):
            numbers.setdefault(w, len(numbers))
        self.words = list(numbers)
        self.ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.langs = list(known)
        self.lang = np.repeat(np.array([known[x] for x in langs], np.int64), [len(s) for s in split])
        self.bits = bits

    def codes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, codes) of the phrases of 1, 2, ... words."""
        named = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        seed = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        word = named[self.ids]
        inside, gram = self.ids != 0, word
        for n in range(1, longest + 1):
            if n > 1:
                inside = inside[:-1] & (self.ids[n - 1 :] != 0)
                gram = mix(gram[:-1]) + word[n - 1 :]
            at = np.flatnonzero(inside)
            yield at, mix(mix(gram[at] + np.uint64(n)) + seed[self.lang[at]]) >> np.uint64(64 - self.bits)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, sorted, and their numbers."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[at], np.diff(np.r_[at, len(codes)])


class Summary:
    """Misra-Gries: at most ``capacity`` counts, none too high and none too low by over ``error``.

    The error is below the mass added divided by the capacity, merges included.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted different codes with their counts."""
        both = np.concatenate([self.codes, codes])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.counts, counts])[order]
        at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
        self.codes, self.counts = both[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(at) > self.capacity:
            # the largest count that finds no place is taken from all
            cut = int(np.partition(self.counts, len(at) - self.capacity - 1)[len(at) - self.capacity - 1])
            stays = self.counts > cut
            self.codes, self.counts = self.codes[stays], self.counts[stays] - cut
            self.error += cut

    def reaching(self, least: int) -> np.ndarray:
        """Codes that may have been added ``least`` times."""
        return self.codes[self.counts + self.error >= least]


def surviving_codes(docs: DataFrame, bits: int, parts: int, least: int = LEAST, longest: int = LONGEST, slack: int = SLACK) -> DataFrame:
    """(code): codes of all phrases that occur ``least`` times, and of some that don't.

    ``docs``: (lang string, text binary).
    """

    def count(batches):
        for langs, texts in _chunks(batches):
            chunk = Phrases(langs, texts, bits)
            codes, n = _counted(np.concatenate([c for _, c in chunk.codes(longest)]))
            if not len(codes):
                continue
            part = _part_of(codes, bits, parts)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            step = np.diff(codes.astype(np.int64), prepend=0)
            step[at] = codes[at]
            blobs = pack(part, [step, n])
            mass = pa.array(np.add.reduceat(n, at))
            none = pa.array([None] * len(at), pa.binary())
            for turn, blob in ((0, none), (1, blobs.column(1))):
                turns = pa.array(np.full(len(at), turn, np.int32))
                yield pa.RecordBatch.from_arrays([blobs.column(0), turns, mass, blob], ["part", "turn", "mass", "blob"])

    def survive(batches):
        now, mass, summary = None, 0, None

        def found():
            return pa.RecordBatch.from_arrays([pa.array(summary.reaching(least))], ["code"])

        for batch in batches:
            for part, turn, more, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if summary:
                        yield found()
                    now, mass, summary = part, 0, None
                if turn == 0:
                    mass += more
                    continue
                if summary is None:
                    summary = Summary(slack * mass // least + 1)
                step, n = unpack([blob], 2)
                summary.merge(np.cumsum(step), n)
        if summary:
            yield found()

    records = docs.mapInArrow(count, "part long, turn int, mass long, blob binary")
    # what a part will get is announced before its counts
    return records.repartition(parts, "part").sortWithinPartitions("part", "turn").mapInArrow(survive, "code long")


def _bit_map(survivors: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """64-bit words in which the survivors' bits are set; its size is a power of two up to ``most`` bits."""
    n = survivors.count()
    size = 64
    while size < min(16 * n, most):
        size *= 2
    slot = F.col("code").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    # no more rows than the map has words
    rows = survivors.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    found = rows.toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _part_of(codes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((codes >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _exact(langs: list[str], texts: list[bytes], bits: int, marked: np.ndarray, longest: int, parts: int) -> pa.RecordBatch:
    """(part, blob): a chunk's phrases whose bits are set and its number of words, counted, by part."""
    chunk = Phrases(langs, texts, bits)
    size = np.uint64(64 * len(marked) - 1)
    out: list[tuple] = []
    # the name of a phrase is its number among those of its length; -1: its bit isn't set
    name = chunk.lang * len(chunk.words) + chunk.ids
    for n, (at, codes) in enumerate(chunk.codes(longest), 1):
        if n == 1:
            for lang, words in enumerate(np.bincount(chunk.lang[at], minlength=len(chunk.langs)).tolist()):
                out.append((0, chunk.langs[lang], _TOTAL, 0, words))
        slot = codes & size
        found = (marked[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        if n > 1:
            found &= (name[at] >= 0) & (name[np.minimum(at + 1, len(name) - 1)] >= 0)  # parts of a frequent phrase are frequent
        at, codes = at[found], codes[found]
        key = name[at] * len(chunk.words) + chunk.ids[at + n - 1] if n > 1 else name[at]
        _, first, of, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        name = np.full(len(chunk.ids), -1)
        name[at] = of
        for a, part, count in zip(at[first].tolist(), _part_of(codes[first], bits, parts).tolist(), counts.tolist()):
            phrase = b" ".join([chunk.words[i] for i in chunk.ids[a : a + n].tolist()])
            out.append((part, chunk.langs[chunk.lang[a]], phrase, n, count))
    out.sort(key=lambda row: row[0])
    part, lang, phrase, words, n = zip(*out)
    text = pa.array([p or b"" for p in phrase], pa.binary()).cast(pa.string())
    rows = pa.RecordBatch.from_arrays([pa.array(lang), text, pa.array(words, pa.int32()), pa.array(n, pa.int64())], schema=_COUNTS)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    blobs = [_written(rows.slice(a, b - a)) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int64)[at]), pa.array(blobs, pa.binary())], ["part", "blob"])


def _written(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _COUNTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _added(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "phrase", "words"]
    return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).select(_COUNTS.names)


def _add_up(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Sums over the blobs of each part, and the phrases that reach ``least``."""

    def settled(held):
        found = _added(held)
        reach = pa.compute.or_(pa.compute.equal(found["words"], 0), pa.compute.greater_equal(found["n"], least))
        return found.filter(reach).to_batches()

    now, held, rows = None, [], 0
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != now and held:
                yield from settled(held)
                held, rows = [], 0
            now = part
            held.append(pa.ipc.open_stream(blob).read_all())
            rows += held[-1].num_rows
            if rows > ADD_ROWS:
                held = [_added(held)]
                rows = 0
    if held:
        yield from settled(held)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of phrases of 1 to ``longest`` words that occur ``least`` times,
    and (lang, n) with the number of all words."""
    source = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"),
    )
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, total // PART_BYTES + 1)
    # enough codes that few phrases share one, few enough that they pack well
    bits = min(62, max(40, total.bit_length() + 8))
    survivors = stored(surviving_codes(source, bits, parts, least, longest), "survivors")
    marked = _bit_map(survivors)

    def count(batches):
        for langs, texts in _chunks(batches):
            yield _exact(langs, texts, bits, marked, longest, parts)

    def add_up(batches):
        return _add_up(batches, least)

    # a chunk's counts travel packed: as rows they would be as many as chunks times phrases
    packed = source.mapInArrow(count, "part long, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    found = stored(packed.mapInArrow(add_up, "lang string, phrase string, words int, n long"), "phrases")
    totals = materialize(found.where("words = 0").select("lang", "n"), "totals")
    return found.where("words > 0"), totals


def score_phrases(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases that no longer one stands for."""
    long = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    side = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    # exact beyond 64 bits
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = (
        cuts.join(side("left", "l"), ["lang", "left"])
        .join(side("right", "r"), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("over", F.lit(1000).cast("decimal(4,0)") * whole("a", 16) * whole("n", 16))
        .withColumn("under", whole("l", 18) * whole("r", 18))
        .withColumn("score", F.expr("over div under"))
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))
    )
    # a phrase inside a longer one is the head or the tail of one with a word more, and that
    # one is at least as frequent as the longer
    inner = F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1)))
    covers = long.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    return (
        scored.join(covers, ["lang", "phrase"], "left")
        .where(F.col("covered").isNull() | (F.col("covered") < F.col("a")))
        .select("lang", "phrase", "a", *(F.col(f"best.{c}").alias(c) for c in ("l", "r", "n", "score")))
    )


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, report: int = REPORT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``report`` phrases of each language.

    ``docs``: (lang, text), other columns take no part. Null text: empty. Null lang: ``und``.
    Ids take no part, and repeated rows count as often as they come. Ties in score go to the
    more frequent phrase, then to the smaller in bytes. Empty table: no rows.
    """
    scored = score_phrases(*frequent_phrases(docs, least, longest))
    # one language may hold nearly all phrases: its first are found in salted shares of it
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.where(F.col("rank") <= report).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= report).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents").select("lang", "text"))
    return found.withColumn("rank", F.col("rank").cast("long"))


QUERIES = {"op13_misra_gries_phrases": op13_misra_gries_phrases}

ORACLES = {
    "op13_misra_gries_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), g AS (
  SELECT lang, k AS words, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS k(k) WHERE len(ws) >= k)
), total AS (
  SELECT lang, count(*) AS n FROM g WHERE words = 1 GROUP BY lang
), f AS (
  SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY lang, words, phrase HAVING count(*) >= 100
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 1
), cuts AS (
  SELECT *, array_to_string(ws[1 : k], ' ') AS x, array_to_string(ws[k + 1 :], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.words, cuts.a, k, l.a AS l, r.a AS r, n,
    (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
    JOIN total ON total.lang = cuts.lang
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN (
    SELECT lang, words, a, array_to_string(ws[i : i + m - 1], ' ') AS part, m
    FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM c))
  ) j ON j.lang = b.lang AND j.part = b.phrase AND 100 * j.a >= 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000
"""
}
