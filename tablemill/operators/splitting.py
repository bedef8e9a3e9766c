"""Stratified folds as a column on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordering import free_name, hash_rank, running_totals


def stratified_kfold(
    df: DataFrame,
    row_id: str,
    label: str,
    k: int = 5,
    seed: int = 42,
    out: str = "fold",
    prefix: int = 3,
    rank: str | None = None,
) -> DataFrame:
    """Folds 1..k: rows of a class are dealt out in the order of md5(id-seed).

    Class counts of two folds differ by at most one. The rank inside a class is computed in
    hash pieces, so a class holding a third of all rows is no single task. The rank stays
    under the name ``rank`` if there is one.
    """
    key = F.md5(F.concat_ws("-", F.col(row_id).cast("string"), F.lit(str(seed))))
    place = rank or free_name(df, "_rank")
    ranked = hash_rank(df, key, [row_id], [label], prefix=prefix, out=place)
    dealt = ranked.withColumn(out, (F.pmod(F.col(place) - 1, F.lit(k)) + 1).cast("int"))
    return dealt if rank else dealt.drop(place)


def inner_fold(rank: Column, outer_splits: int, outer: int, k: int) -> Column:
    """Fold 1..k that :func:`stratified_kfold` deals to a row of the other outer folds, from its rank
    in the outer deal: its rank without fold ``outer`` is less by the rows of that fold up to it."""
    left_out = F.floor((rank - outer + outer_splits) / outer_splits)
    return (F.pmod(rank - left_out - 1, F.lit(k)) + 1).cast("int")


def cells_left_out(outer_splits: int, outer: int, k: int, fold: int | None) -> frozenset[int]:
    """Of the cells (rank - 1) mod (``outer_splits`` x ``k``), those that training without outer fold
    ``outer`` and inner fold ``fold`` doesn't hold. A row's cell alone says all folds it is in."""
    cells = range(outer_splits * k)
    inner = [(c - (c + 1 - outer + outer_splits) // outer_splits) % k + 1 for c in cells]
    return frozenset(c for c in cells if c % outer_splits + 1 == outer or inner[c] == fold)


def split_train_test(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(column) != fold), df.filter(F.col(column) == fold)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def inner_split_count(counts: DataFrame, k: int) -> DataFrame:
    """k, or max(2, smallest class) when a class is smaller than k."""
    least = F.min("n")
    return counts.agg(
        least.alias("min_class_count"),
        F.when(least < k, F.greatest(F.lit(2).cast("long"), least))
        .otherwise(F.lit(k).cast("long"))
        .alias("inner_splits"),
    )


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels, sorted, with codes 0..k-1. One row per class."""
    names = df.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    return names.withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)


def encode_labels(df: DataFrame, label: str, codes: DataFrame, out: str = "y") -> DataFrame:
    table = codes.select(F.col("label").alias(label), F.col("code").alias(out))
    return df.join(table, label, "left")


def row_names(df: DataFrame, key: list[str], name: str = "composition") -> DataFrame:
    """``row_<i>`` by key order where the name column is absent or NULL.

    Numbering follows the key, since a distributed table has no row order of its own.
    """
    one, i = free_name(df, "_one"), free_name(df, "_i")
    ones = df.withColumn(one, F.lit(1).cast("long"))
    numbered = running_totals(ones, [F.col(c) for c in key], {i: one})
    generated = F.concat(F.lit("row_"), F.col(i).cast("string"))
    value = F.coalesce(F.col(name), generated) if name in df.columns else generated
    return numbered.withColumn(name, value).drop(one, i)
