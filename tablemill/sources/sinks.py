"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import argmax_index, label_at, top_entries


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table as one CSV file; these tables have a row per model, fold or class."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_folds(df: DataFrame, path: str) -> None:
    """Artefacts by fold and model. A rerun replaces just the folds it holds."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fold", "model")
        .parquet(path)
    )


def write_shap(phi: DataFrame, path: str) -> None:
    phi.write.mode("overwrite").partitionBy("class").parquet(path)


def json_summary(df: DataFrame, key: str, value: Column) -> DataFrame:
    """A small table as one nested row: key -> value."""
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value)))).alias("summary"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def top2_columns(proba: Column, classes: list[str]) -> list[Column]:
    """Best and second-best class with their probabilities."""
    top = top_entries(proba, 2)
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return [
        label_at(first["index"], classes).alias("phase_top1"),
        (-first["neg"]).alias("proba_top1"),
        label_at(second["index"], classes).alias("phase_top2"),
        (-second["neg"]).alias("proba_top2"),
    ]


def proba_columns(proba: Column, classes: list[str], prefix: str = "proba_") -> list[Column]:
    return [F.get(proba, F.lit(i)).alias(f"{prefix}{c}") for i, c in enumerate(classes)]


def predictions_table(
    scored: DataFrame, key: list[str], classes: list[str], proba: str = "proba", write_full_proba: bool = False
) -> DataFrame:
    """Output form of a scoring run: id, top two classes, all probabilities on request."""
    p = F.col(proba)
    full = proba_columns(p, classes) if write_full_proba else []
    return scored.select(*key, *top2_columns(p, classes), *full)


def model_columns(name: str, proba: Column, classes: list[str], full: bool = False) -> list[Column]:
    """Wide output per model: label, index, largest probability, all on request."""
    index = argmax_index(proba)
    columns = [
        label_at(index, classes).alias(f"pred_{name}"),
        index.alias(f"pred_{name}_idx"),
        F.array_max(proba).alias(f"pred_{name}_pmax"),
    ]
    return columns + (proba_columns(proba, classes, f"proba_{name}_") if full else [])
