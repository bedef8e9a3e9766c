"""Pareto tables and rankings of small score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordering import running_totals

# Fixed value: the line drawn on the Pareto chart, in percent.
PARETO_LINE = 80.0


def pareto(counts: DataFrame, name: str) -> DataFrame:
    """Running total and running percent of counts, largest first, ties by name."""
    summed = running_totals(
        counts, [F.desc("n"), F.asc(name)], {"cumulative": "n"}, grand={"total": "n"}
    )
    return summed.select(
        name, "n", "cumulative", (F.lit(100.0) * F.col("cumulative") / F.col("total")).alias("cumulative_pct")
    )


def pareto_cut(table: DataFrame, line: float = PARETO_LINE) -> DataFrame:
    return table.filter(F.col("cumulative_pct") <= line)


def rank_desc(scores: DataFrame, value: str, name: str) -> DataFrame:
    """Rank features by value; the table holds one row per feature."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), F.asc(name))))


def topk_features(scores: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """First k of the ranking; k <= 0 keeps all."""
    ranked = rank_desc(scores, value, name)
    return ranked if k <= 0 else ranked.filter(F.col("rank") <= k)


def sort_counts(counts: DataFrame, name: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc(name))
