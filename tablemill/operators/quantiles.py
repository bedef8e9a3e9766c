"""Exact medians of many columns at any size."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Column name in backticks: feature names hold spaces, dashes and accents."""
    return "`" + name.replace("`", "``") + "`"


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v): one row per cell. Aggregating these keeps plans small however wide the table."""
    cells = [
        F.struct(F.lit(i).alias("i"), F.col(quoted(c)).cast("double").alias("v")) for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*cells)))


def column_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Rows, non-null count, least, greatest, mean and population deviation per column."""
    rows = (
        _cells(df, columns)
        .groupBy("i")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
        )
        .collect()
    )
    empty = {"rows": 0, "n": 0, "lo": None, "hi": None, "mean": None, "std": None}
    found = {r["i"]: {k: r[k] for k in empty} for r in rows}
    return {c: found.get(i, empty) for i, c in enumerate(columns)}


def facts_by_fold(df: DataFrame, columns: list[str], fold: str) -> dict[int, dict[str, dict]]:
    """:func:`column_facts` of every fold, in one pass."""
    cells = [F.struct(F.lit(i).alias("i"), F.col(quoted(c)).cast("double").alias("v")) for i, c in enumerate(columns)]
    rows = (
        df.select(F.col(quoted(fold)).alias("fold"), F.inline(F.array(*cells)))
        .groupBy("fold", "i")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
        )
        .collect()
    )
    out: dict[int, dict[str, dict]] = {}
    for r in rows:
        out.setdefault(r["fold"], {})[columns[r["i"]]] = {k: r[k] for k in ("rows", "n", "lo", "hi", "mean", "std")}
    return out


def merged_facts(parts: list[dict]) -> dict:
    """Facts of the union of several sets of rows from the facts of each."""
    rows, n = sum(p["rows"] for p in parts), sum(p["n"] for p in parts)
    parts = [p for p in parts if p["n"]]
    if not parts:
        return {"rows": rows, "n": 0, "lo": None, "hi": None, "mean": None, "std": None}
    mean = sum(p["mean"] * (p["n"] / n) for p in parts)
    spread = sum((p["std"] ** 2 + (p["mean"] - mean) ** 2) * (p["n"] / n) for p in parts)
    lo, hi = min(p["lo"] for p in parts), max(p["hi"] for p in parts)
    return {"rows": rows, "n": n, "lo": lo, "hi": hi, "mean": mean, "std": spread**0.5}


_SIGN = np.uint64(1) << np.uint64(63)
DIGIT = 16
"""Bits that a look at the data settles; four looks settle a double."""


def sortable_keys(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the doubles; -0.0 as 0.0, NaN above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of_key(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)[0])


def _digit_counts(df: DataFrame, columns: list[str], fold: str | None, looked: dict[int, list[int]], turn: int) -> DataFrame:
    """(i, fold, prefix, digit, n): how often each digit follows the wanted leading bits."""
    wanted = {i: np.array(sorted(p), np.uint64) for i, p in looked.items()}

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*held))
        found, of = np.unique(codes, return_inverse=True)
        return found, np.bincount(of, n).astype(np.int64)

    def count(batches):
        held: dict[int, list] = {i: [] for i in wanted}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, prefixes in wanted.items():
                x = batch.column(i + 1)
                of = folds[np.asarray(x.is_valid())]
                key = sortable_keys(x.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                if not len(key):
                    continue
                if turn:
                    lead = key >> np.uint64(64 - DIGIT * turn)
                    which = np.minimum(np.searchsorted(prefixes, lead), len(prefixes) - 1)
                    fits = prefixes[which] == lead
                    key, which, of = key[fits], which[fits], of[fits]
                else:
                    which = 0
                digit = (key >> np.uint64(64 - DIGIT * (turn + 1))) & np.uint64((1 << DIGIT) - 1)
                found, n = np.unique(((of * len(prefixes) + which) << DIGIT) | digit.astype(np.int64), return_counts=True)
                held[i].append((found, n))
                if len(held[i]) > 64:
                    held[i] = [added(held[i])]
        for i, parts in held.items():
            if not parts:
                continue
            codes, n = added(parts)
            of, which = np.divmod(codes >> DIGIT, len(wanted[i]))
            lead = wanted[i].view(np.int64)[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), i, np.int32)), pa.array(of), pa.array(lead), pa.array(codes & ((1 << DIGIT) - 1)), pa.array(n)],
                ["i", "fold", "prefix", "digit", "n"],
            )

    part = F.lit(0) if fold is None else F.col(quoted(fold))
    cells = df.select(part.cast("long").alias("fold"), *[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = cells.mapInArrow(count, "i int, fold long, prefix long, digit long, n long")
    return counts.groupBy("i", "fold", "prefix", "digit").agg(F.sum("n").alias("n"))


def left_out(split: int | frozenset[int] | None) -> list[int]:
    """Folds that a split doesn't hold: none, one or several."""
    return [] if split is None else sorted(split) if isinstance(split, frozenset) else [split]


def _placing(splits: list, turn: int, targets: dict[tuple, list]):
    """The digit that each wanted rank falls on, for the counts behind one column's prefix."""

    def settle(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        # at most 65536 digits of each fold follow a prefix
        i, prefix = int(key[0]), int(np.int64(key[1]).view(np.uint64))
        digits, at = np.unique(part["digit"].to_numpy(), return_inverse=True)
        folds, n = part["fold"].to_numpy(), part["n"].to_numpy()
        rows = []
        for x, s in enumerate(splits):
            upto = np.cumsum(np.bincount(at, n * ~np.isin(folds, left_out(s)))).astype(np.int64)
            size = int(upto[-1])
            ranks = [(w, r) for y, w, r in targets[i, prefix] if y == x] if turn else [(w, (size - 1 + w) // 2) for w in (0, 1)]
            for w, rank in ranks if size else []:
                d = int(np.searchsorted(upto, rank, side="right"))
                rows.append((x, i, w, int(key[1]), int(digits[d]), rank - (int(upto[d - 1]) if d else 0)))
        return pd.DataFrame(rows, columns=["split", "i", "which", "prefix", "digit", "rank"])

    return settle


def split_medians(
    df: DataFrame, columns: list[str], fold: str | None = None, splits: list[int | frozenset[int] | None] = [None]
) -> dict:
    """Exact medians per split and column by radix selection: ``{split: {column: median}}``.

    Split None holds all rows, split f the rows of every fold but f (numbers in column
    ``fold``), a set those of every fold but its members. Doubles become 64-bit keys of the same order; each of four looks at the data
    counts the next 16 bits of the cells whose leading bits are still in question, so no
    cell is shuffled or written. All splits share the looks: a split's counts are all counts
    less those of its folds. The mean of two middle values; a column without values gives 0.0.
    Infinities are values like others. ``df`` should be a stored table.
    """
    if not columns:
        return {s: {} for s in splits}
    # (split, column, which middle) -> leading bits so far and rank among the cells that have them
    place: dict[tuple, tuple[int, int]] = {}
    for turn in range(64 // DIGIT):
        targets: dict[tuple, list] = {}
        for (x, i, w), (prefix, rank) in place.items():
            targets.setdefault((i, prefix), []).append((x, w, rank))
        looked: dict[int, list[int]] = {}
        for i, prefix in targets:
            looked.setdefault(i, []).append(prefix)

        counts = _digit_counts(df, columns, fold, looked or {i: [0] for i in range(len(columns))}, turn)
        found = counts.groupBy("i", "prefix").applyInPandas(_placing(splits, turn, targets), "split int, i int, which int, prefix long, digit long, rank long")
        place = {
            (r["split"], r["i"], r["which"]): (int(np.int64(r["prefix"]).view(np.uint64)) << DIGIT | r["digit"], r["rank"])
            for r in found.collect()
        }
        if not place:
            break
    out: dict = {}
    for x, s in enumerate(splits):
        ends = {i: [value_of_key(place[x, i, w][0]) for w in (0, 1)] if (x, i, 0) in place else [0.0, 0.0] for i in range(len(columns))}
        out[s] = {c: float(ends[i][0] if ends[i][0] == ends[i][1] else ends[i][0] / 2.0 + ends[i][1] / 2.0) for i, c in enumerate(columns)}
    return out


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column (mean of the two middle values); an all-NULL column gives 0.0."""
    return split_medians(df, columns)[None]
