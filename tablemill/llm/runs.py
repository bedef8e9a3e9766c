"""Periodic runs of words: every maximal stretch that repeats itself three times or more.

A run of smallest period q is a stretch in which words q apart are identical and which no
neighbouring word extends. The texts of a group are numbered word by word and laid end to
end, each closed by a word of its own, so that nothing extends from one text into the next.

1. **Cover.** Every difference modulo ``MOD`` is that of two members of ``COVER``, so any two
   words are at most ``MOD - 1`` words before two sampled words at once. Only suffixes that
   start at sampled words are sorted: by their first ``MOD`` words, then by doubling (the
   sample ``h`` words later is a sample as well). Neighbours' common words are kept.
2. **Common extension** of two places: compare words up to the synchronised samples, then
   take the minimum of the neighbours' common words between them from a sparse table. The
   same structure over the reversed words extends to the left.
3. **Harmonic grid.** A run of period q has at least ``max(MIN_WORDS, 3 q)`` words, so one grid
   point in ``max(MIN_WORDS, 3 q) - q`` words lies in it together with the word q later. For
   all q that is n log n points; where the two words agree, both extensions give the run.

A stretch found with several periods has the smallest of them; the others are its multiples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import map_rows, table, text_bytes, with_columns
from tablemill.llm.quality import words_of

MIN_WORDS = 24
REPEATS = 3
# A difference cover.
MOD = 31
COVER = (1, 5, 11, 24, 25, 27)
GROUP_WORDS = 1 << 18
"""Words of texts that are searched together; a longer text is searched alone."""

_SAMPLED = np.isin(np.arange(MOD), COVER)
_FIRST = np.array([next(x for x in COVER if (x + d) % MOD in COVER) for d in range(MOD)])


class Extensions:
    """How many words from two places on are the same.

    ``w``: word numbers from 1; the last one occurs nowhere else.
    """

    def __init__(self, w: np.ndarray):
        self.w = np.r_[w, np.zeros(2 * MOD, w.dtype)].astype(np.int64)
        self.at = np.flatnonzero(np.resize(_SAMPLED, len(w)))
        self.sample = np.zeros(len(w) + 1, np.int64)
        self.sample[self.at] = np.arange(len(self.at))
        self._sort()

    def _sort(self) -> None:
        w, at, m = self.w, self.at, len(self.at)
        order, start = np.arange(m), np.zeros(m, np.int64)
        gap = np.full(m, -1)  # words in common with the sample before; -1: not known yet
        live = order.copy()  # places whose sample is not told apart from its neighbours
        bits, place_bits = int(w.max()).bit_length(), m.bit_length()
        take = max(1, (63 - place_bits) // bits)
        depth = 0

        def refine(key: np.ndarray) -> np.ndarray:
            """Sort the live places by key, which starts with the place their group starts at."""
            nonlocal live
            o = np.argsort(key)
            key = key[o]
            order[live] = order[live][o]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(key)])
            start[live] = np.repeat(live[first], size)
            before = live
            live = live[np.repeat(size > 1, size)]
            return before[first], key[first], np.r_[key[:1], key[first[1:] - 1]] if len(first) else key

        while depth < MOD and len(live):
            key, i = start[live], at[order[live]] + depth
            for x in range(take):
                key = (key << bits) | w[i + x]
            places, key, previous = refine(key)
            # where a group has split, the leading words that agree
            unlike, same = key ^ previous, np.full(len(key), depth)
            for x in range(take):
                same += (unlike >> (bits * (take - 1 - x))) == 0
            split = (unlike != 0) & ((unlike >> (bits * take)) == 0)
            gap[places[split]] = same[split]
            depth += take
        name = np.empty(m, np.int64)
        name[order] = start
        levels, h = [(MOD, name.copy())], MOD
        while len(live):
            refine((start[live] << place_bits) | name[self.sample[at[order[live]] + h]])
            name[order] = start
            h *= 2
            levels.append((h, name.copy()))
        late = np.flatnonzero(gap[1:] < 0) + 1
        i, j, known = at[order[late - 1]], at[order[late]], np.zeros(len(late), np.int64)
        for h, named in reversed(levels):
            # beyond the end of a text nothing agrees, so places stay inside
            a, b = (np.minimum(x + known, len(self.sample) - 2) for x in (i, j))
            known += np.where(named[self.sample[a]] == named[self.sample[b]], h, 0)
        gap[late] = known + self._compare(i + known, j + known, np.full(len(late), depth + 1))[0]
        gap[:1] = 0
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        self.least = [gap.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= m:
            last, width = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-width], last[width:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree, ``most`` at the utmost, and the rows in which all of these do."""
        w, same, all_same = self.w, np.zeros(len(i), np.int64), []
        live = np.arange(len(i))
        for t in range(int(most.max(initial=0)) + 1):
            full = most[live] == t
            all_same.append(live[full])
            live = live[~full]
            live = live[w[i[live] + t] == w[j[live] + t]]
            if not len(live):
                break
            same[live] += 1
        return same, np.concatenate(all_same) if all_same else live

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at ``i`` and at ``j``, which differ."""
        ahead = (_FIRST[(j - i) % MOD] - i) % MOD
        out, rows = self._compare(i, j, ahead)
        a, b = (self.rank[self.sample[x[rows] + ahead[rows]]] for x in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        least = np.empty(len(rows), np.int64)
        for k in np.unique(level):
            r = level == k
            least[r] = np.minimum(self.least[k][low[r]], self.least[k][high[r] - (1 << k) + 1])
        out[rows] += least
        return out


def runs_of(w: np.ndarray, longest: int, least: int = MIN_WORDS, repeats: int = REPEATS):
    """(first, length, period) of all runs in ``w``, by first and length.

    ``w``: texts of at most ``longest`` words, before, between and after them words that
    occur once.
    """
    n = len(w)
    points, periods = [], []
    for q in range(1, longest // repeats + 1):
        step = max(least, repeats * q) - q
        same = w[: n - q : step] == w[q::step]
        found = np.flatnonzero(same) * step
        points.append(found)
        periods.append(np.full(len(found), q))
    none = np.zeros(0, np.int64)
    g, q = np.concatenate([none, *points]), np.concatenate([none, *periods])
    if not len(g):
        return none, none, none
    last = g + q + Extensions(w).common(g, g + q)
    back = Extensions(w[::-1])
    inner = g > 0
    first = g.copy()
    first[inner] -= back.common(n - g[inner] - q[inner], n - g[inner])
    real = last - first >= np.maximum(least, repeats * q)
    first, last, q = first[real], last[real], q[real]
    order = np.lexsort((q, last, first))
    first, last, q = first[order], last[order], q[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])][: len(first)]
    return first[new], (last - first)[new], q[new]


def search(texts: list[bytes], least: int, repeats: int) -> list[tuple[int, np.ndarray, bytes]]:
    """(words, runs as rows of start, length, period, collapsed text) of each text."""
    split = [t.split() for t in texts]
    flat = [w for words in split for w in words]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat), len(texts) + 2)}
    ids = np.fromiter(map(numbers.__getitem__, flat), np.int32, len(flat))
    sizes = np.array([len(words) for words in split], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]] + np.arange(len(texts)) + 1
    w = np.empty(len(ids) + len(texts) + 1, np.int32)
    w[0], w[starts + sizes] = 1, np.arange(2, len(texts) + 2)
    w[np.arange(len(ids)) + 1 + np.repeat(np.arange(len(texts)), sizes)] = ids
    first, length, period = runs_of(w, int(sizes.max(initial=0)), least, repeats)
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, first + period, 1)
    np.add.at(edge, first + length, -1)
    dropped = np.cumsum(edge) > 0
    cut = np.searchsorted(first, np.r_[starts, len(w)])
    out = []
    for k, words in enumerate(split):
        runs = np.stack([x[cut[k] : cut[k + 1]] for x in (first - starts[k], length, period)], 1)
        if len(runs):
            gone = dropped[starts[k] : starts[k] + sizes[k]].tolist()
            words = [w for w, g in zip(words, gone) if not g]
        out.append((int(sizes[k]), runs, b" ".join(words)))
    return out


def find_runs(docs: DataFrame, least: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: array of (start, length, period), by start, then period: every stretch of at
    least ``least`` words and ``repeats`` periods. ``collapsed``: the words that no run
    repeats (each run keeps its first period), with one blank between.

    Words are separated by ASCII white space. Null and empty texts: no words, no runs. Null
    ids and repeated rows: a row each. Empty table: no rows. Columns of those names are
    replaced. A text is searched whole, in memory of some 100 bytes a word.
    """
    made = ("n_words", "runs", "collapsed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]).alias("row")
    source = docs.select(row, text_bytes())
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batch):
        texts = batch.column(1).to_pylist()
        out: list = [None] * len(texts)

        def settle(rows):
            for r, found in zip(rows, search([texts[r] for r in rows], least, repeats)):
                out[r] = found

        # texts of like length together: the longest of a group sets its periods
        held, size = [], 0
        for r in sorted(range(len(texts)), key=lambda r: len(texts[r])):
            held.append(r)
            size += len(texts[r]) // 5 + 1
            if size >= GROUP_WORDS:
                settle(held)
                held, size = [], 0
        if held:
            settle(held)
        n = np.array([len(runs) for _, runs, _ in out])
        flat = np.concatenate([runs for _, runs, _ in out]).astype(np.int64)
        records = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(arrow.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), records)
        text = pa.array([c for _, _, c in out], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _, _ in out], pa.int64()), lists, text], ["row", *made])

    kind = "array<struct<start:long,length:long,period:long>>"
    return map_rows(source, with_columns(source, f"n_words long, runs {kind}, collapsed string"), work).select("row.*", *made)


def with_echoes(docs: DataFrame) -> DataFrame:
    """``docs`` in which one text in ten, by the checksum of its id, ends in a repeated stretch.

    Text without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(F.col("text").cast("string"))

    def echoed(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        each = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(each, " "))

    # the words are made once, for the rows that need them
    changed = F.get(F.transform(F.array(words), echoed), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_echoes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs)
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    # runs come by start, then period: the first of equals stays
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}

ORACLES = {
    "op11_periodic_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i:
        [ascii((doc_id::VARCHAR)[i])::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999]))),
      lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END)) AS h
  FROM documents
), p AS (
  SELECT rid, doc_id, ws, len(ws) AS n, h, h // 10 AS g,
    CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d
), e AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1]
      ELSE ws[(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1)::BIGINT] END) ELSE ws END AS ws
  FROM p
), w AS (
  SELECT rid, n, unnest(range(0, n)) AS i, unnest(ws) AS x FROM e
), same AS (
  SELECT a.rid, a.i, b.i - a.i AS q FROM w a JOIN w b ON a.rid = b.rid AND a.x = b.x
    AND b.i > a.i AND 3 * (b.i - a.i) <= a.n
), stretch AS (
  SELECT rid, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same)
  GROUP BY rid, q, island HAVING max(i) + 1 + q - min(i) >= greatest(24, 3 * q)
), runs AS (
  SELECT rid, s, e, min(q) AS q FROM stretch GROUP BY rid, s, e
), best AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    -- e - s < 10^9: a quotient in units of 10^-24 tells all such fractions apart
    first({'s': s, 'l': e - s, 'q': q} ORDER BY (e - s)::HUGEINT * 1000000000000000000000000::HUGEINT // q DESC, s, q) AS b
  FROM runs GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(s + q, e)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period,
  (1000 * b.l // b.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(t, '')) AS collapsed_sha256
FROM e LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
}
