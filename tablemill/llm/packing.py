"""Best-fit packing by patterns: non-negative least squares over a length histogram.

Only the histogram of piece lengths (as many numbers as a sequence has tokens) reaches the
driver. There, patterns of one to four lengths that nearly fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded
down to what is there, and the residual counts are packed by best fit, longest first. The
plan is a bounded table of intervals (length, first rank, last rank) -> (sequence, offset);
pieces are ranked inside their length by salted partial counts, and look their place up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemill.llm.bpe import default_path, encoder
from tablemill.llm.common import map_rows, table, text_bytes
from tablemill.session import materialize

CAPACITY = 4096
END_ID = 1
SHARES = (1.0, 0.5, 0.25, 0.125, 0.0625)
"""Shares of the fitted repeats that a plan may have."""
SALTS = 64
"""Parts that the pieces of one length are ranked in."""


# -- the plan, from counts alone ------------------------------------------------------
def enumerate_patterns(counts: np.ndarray, capacity: int, partners: int = 6) -> list[tuple[int, ...]]:
    """Sets of at most four lengths that leave under 1 / 256 of a sequence empty."""
    there = np.flatnonzero(counts)
    there = there[there > 0]
    most = capacity // 256
    found: set[tuple[int, ...]] = set()

    def below(limit: int, how_many: int) -> np.ndarray:
        end = np.searchsorted(there, limit, side="right")
        return there[max(0, end - how_many) : end]

    for first in there.tolist():
        room = capacity - first
        if room <= most:
            found.add((first,))
        seconds = set(below(room, partners).tolist()) | {
            int(x) for f in (0.5, 0.35, 0.65) for x in below(int(room * f), 3)
        }
        for second in seconds:
            rest = room - second
            if rest <= most:
                found.add(tuple(sorted((first, second), reverse=True)))
            for third in set(below(rest, 3).tolist()) | {int(x) for x in below(rest // 2, 2)}:
                left = rest - third
                if left <= most:
                    found.add(tuple(sorted((first, second, third), reverse=True)))
                for fourth in below(left, 1).tolist():
                    if left - fourth <= most:
                        found.add(tuple(sorted((first, second, third, fourth), reverse=True)))
    return sorted(found, key=lambda p: (capacity - sum(p), len(p), p))


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with least |A x - counts|, A holding how often a pattern has a length.

    Accelerated projected gradient; the step is the largest safe one, found from the
    largest sums of rows and columns of A.
    """
    width = max(map(len, patterns))
    lengths = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        lengths[i, : len(p)] = p  # length 0 is no length: its target and weight are zero
    real = lengths > 0
    target = counts.astype(float)
    # weights make rare lengths count as much as common ones
    weight = 1.0 / np.maximum(1.0, np.sqrt(target))
    scaled = np.where(real, weight[lengths], 0.0)
    rows = np.bincount(lengths.ravel(), scaled.ravel(), minlength=len(counts))
    step = 1.0 / max(1e-12, float((scaled * rows[lengths]).sum(1).max()))
    x = y = np.zeros(len(patterns))
    goal, t = target * weight, 1.0
    for _ in range(rounds):
        reached = np.bincount(lengths.ravel(), (scaled * y[:, None]).ravel(), minlength=len(counts))
        slope = (scaled * (reached - goal)[lengths]).sum(1)
        nxt = np.maximum(0.0, y - step * slope)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def round_repeats(fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole repeats, order): repeats rounded down, and the patterns by what that cut off, largest first."""
    whole = np.floor(fitted)
    return whole.astype(np.int64), np.argsort(whole - fitted, kind="stable")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank.

    ``counts[n]`` pieces of ``n`` tokens; each is placed once and no sequence is overfull.
    The fitted repeats are rounded by largest remainder, so that patterns carry the histogram
    however small their repeats are; best fit takes the residuals. Where these pack badly, a
    share of the repeats can need fewer sequences: of ``SHARES`` the largest that reaches the
    least possible number is taken, else the one with the fewest sequences.
    """
    counts = counts.astype(np.int64)
    patterns = enumerate_patterns(counts, capacity)
    fitted = fit_repeats(patterns, counts) if patterns else np.zeros(0)
    least = -(-int(counts @ np.arange(len(counts))) // capacity)
    best: tuple[int, list] | None = None
    for share in SHARES:
        left, used, rows = counts.copy(), np.zeros(len(counts), np.int64), []
        sequences = _place(left, used, rows, patterns, share * fitted)
        sequences = _best_fit(left, used, rows, sequences, capacity)
        if best is None or sequences < best[0]:
            best = sequences, rows
        if sequences == least:
            break
    return np.array(sorted(best[1]), np.int64).reshape(-1, 5)


def _take(left: np.ndarray, used: np.ndarray, rows: list, length: int, how_many: int, sequence: int, offset: int) -> None:
    rows.append((length, int(used[length]), int(used[length]) + how_many, sequence, offset))
    used[length] += how_many
    left[length] -= how_many


def _place(left: np.ndarray, used: np.ndarray, rows: list, patterns: list, fitted: np.ndarray) -> int:
    """Places the repeats of every pattern where the counts allow; how many sequences that makes."""
    sequences = 0
    whole, by_remainder = round_repeats(fitted)
    extra = round(float(fitted.sum())) - int(whole.sum())

    def repeat(pattern: tuple[int, ...], wanted: int) -> int:
        lengths, times = np.unique(pattern, return_counts=True)
        repeats = min(wanted, int((left[lengths] // times).min()))
        offset = 0
        for length in pattern if repeats else ():
            _take(left, used, rows, length, repeats, sequences, offset)
            offset += length
        return repeats

    for i in np.argsort(-whole, kind="stable").tolist():
        if not whole[i]:
            break
        sequences += repeat(patterns[i], int(whole[i]))
    for i in by_remainder.tolist():
        if extra <= 0 or fitted[i] <= whole[i]:
            break
        placed = repeat(patterns[i], 1)
        sequences += placed
        extra -= placed
    return sequences


def _best_fit(left: np.ndarray, used: np.ndarray, rows: list, sequences: int, capacity: int) -> int:
    """Places all that is left into new sequences from number ``sequences`` on; how many there are then."""
    # longest first, by counts; groups of open sequences by their gap
    gaps: dict[int, list[list[int]]] = {}
    open_gaps = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while left[length]:
            # best fit puts pieces of one length into one gap until it has no room for more
            fits = np.flatnonzero(open_gaps[length:])
            gap = int(fits[0]) + length if len(fits) else capacity
            each = min(gap // length, int(left[length]))
            k = int(left[length]) // each
            if len(fits):
                first, n = gaps[gap][-1]
                k = min(n, k)
                open_gaps[gap] -= k
                if k == n:
                    gaps[gap].pop()
                else:
                    gaps[gap][-1] = [first + k, n - k]
            else:
                first = sequences
                sequences += k
            for i in range(each):
                _take(left, used, rows, length, k, first, capacity - gap + i * length)
            gaps.setdefault(gap - each * length, []).append([first, k])
            open_gaps[gap - each * length] += k
    return sequences


# -- the jobs ---------------------------------------------------------------------------
def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): tokens and end, cut when too long."""
    where = path or default_path()
    closing = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def work(batch):
        enc, rows = encoder(where), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = enc.ids(text) + closing
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_bytes()), schema, work)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a written table is expected.

    ``pieces`` needs doc_id, piece, length, ids_crc32 and may have more columns.
    """
    counts = np.zeros(capacity + 1, np.int64)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    by_salt = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(by_salt), F.lit(0)).alias("_from"))
    # at most capacity * salts rows, so broadcasting it is bounded
    for length, n in cells.groupBy("length").agg(F.sum("_n")).collect():
        counts[length] = n
    rows = plan(counts, capacity)
    keys = rows[:, 0] * (1 << 40) + rows[:, 1]
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(
        F.broadcast(starts), ["length", "_salt"]
    )
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranked.select(*columns, (F.col("_from") + F.col("_row") - 1).alias("_rank"))
    schema = StructType([*ranked.drop("_rank").schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def place(batch):
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
        sequence, offset = rows[at, 3] + rank - rows[at, 1], rows[at, 4]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
            [*columns, "sequence_id", "offset"],
        )

    return map_rows(ranked, schema, place)


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document in sequences of at most 4096 tokens: one row per piece.

    Null or empty text: one piece, the end token alone. Null and repeated ids: pieces of
    every input row. Empty table: no rows. Other columns are not read. ``with_ids`` adds the
    tokens themselves as little-endian unsigned 32-bit numbers.
    """
    pieces = materialize(token_pieces(docs, path, with_ids=with_ids), "pieces")
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack_pieces(pieces).select(*wanted, *["ids"] * with_ids)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pattern_packing": op8_pattern_packing}
