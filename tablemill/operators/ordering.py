"""Exact ranks and running totals without a single-task window.

A window with a handful of partitions (one per class, or none at all) puts a third of the
rows, or all of them, into one task. Both helpers here split such a group into many
ordered pieces, add up each piece once, and shift the local result by what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import materialize


def free_name(df: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the offsets of its piece; a NULL group is a group like any other."""
    named = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [rows[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def hash_rank(
    df: DataFrame,
    hash_text: Column,
    tie: list[str],
    group: list[str] | None = None,
    prefix: int = 3,
    out: str = "rank",
) -> DataFrame:
    """1-based rank by a hexadecimal hash text inside each group.

    The leading ``prefix`` characters cut a group into 16**prefix equally likely pieces
    that are already in order, so no piece is hot however few groups there are. The piece
    counts are at most groups x 16**prefix rows.
    """
    group = group or []
    hashed, piece, within, offset = (free_name(df, c) for c in ("_hash", "_piece", "_local", "_offset"))
    keyed = df.withColumn(hashed, hash_text).withColumn(piece, F.substring(hashed, 1, prefix))
    counts = keyed.groupBy(*group, piece).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(offset))
    local = Window.partitionBy(*group, piece).orderBy(hashed, *tie)
    return (
        _with_offsets(keyed.withColumn(within, F.row_number().over(local)), offsets, [*group, piece])
        .withColumn(out, F.col(within) + F.col(offset))
        .drop(hashed, piece, within, offset)
    )


def running_totals(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, str],
    group: list[str] | None = None,
    grand: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of columns along an order; ``totals`` maps output to input.

    Rows should be unique on (group, order): aggregate first. They are range-partitioned
    and written once, so every later branch sees the same pieces; only one row per piece
    and group is added up centrally. ``grand`` adds whole-group sums the same way. The
    write happens while the query is built.
    """
    group = group or []
    grand = grand or {}
    spark = df.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = free_name(df, "_piece")
    ranged = df.repartitionByRange(pieces, *group, *order).withColumn(piece, F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    needed = sorted(set(totals.values()) | set(grand.values()))
    sums = ranged.groupBy(*group, piece).agg(*[F.sum(c).alias(f"_s_{c}") for c in needed])
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        piece,
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in needed],
        *[F.sum(f"_s_{c}").over(by_group).alias(out) for out, c in grand.items()],
    )
    local = (
        Window.partitionBy(*group, piece)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = ranged.select("*", *[F.sum(c).over(local).alias(f"_l_{c}") for c in needed])
    joined = _with_offsets(summed, offsets, [*group, piece])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{c}") + F.col(f"_b_{c}")).alias(out) for out, c in totals.items()],
        *grand.keys(),
    )
