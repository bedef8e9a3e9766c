"""Reading inputs by file ending, and matrices or bundles with their stated schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemill.functions.labels import translate_label
from tablemill.functions.numeric import text_to_double
from tablemill.operators.prep import Preprocessing

READERS = (".csv", ".parquet", ".json", ".jsonl", ".orc")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read by suffix. Give a schema for CSV and JSON at scale: it saves a pass over the data."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise ValueError(f"Unsupported input file extension: {suffix!r} (use one of {READERS})")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == ".csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".orc":
        return reader.orc(path)
    return reader.json(path)


BUNDLE_SCHEMA = (
    "medians map<string,double>, dropped_by_constant_filter array<string>, "
    "kept_after_constant_filter array<string>, final_features array<string>, "
    "dropped_by_pearson array<string>, scaler_mean array<double>, scaler_scale array<double>"
)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A preprocessing bundle as a one-row table."""
    return spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).json(path)


def bundle_of(table: DataFrame) -> Preprocessing:
    row = table.first()
    if row is None:
        raise ValueError("empty bundle")
    return Preprocessing(**{k: (v if v is not None else []) for k, v in row.asDict().items()})


def read_fold_predictions(spark: SparkSession, path: str, truth: DataFrame | None = None) -> DataFrame:
    """Predictions stored by fold and model.

    With ``truth`` (fold, row_id), a (fold, model) with another number of rows fails.
    """
    preds = spark.read.parquet(path)
    if truth is None:
        return preds
    wrong = length_mismatches(preds, truth).limit(20).collect()
    if wrong:
        raise ValueError(f"prediction and truth lengths differ: {[tuple(r) for r in wrong]}")
    return preds


def length_mismatches(preds: DataFrame, truth: DataFrame) -> DataFrame:
    n_pred = preds.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n_pred"))
    n_test = truth.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    joined = n_pred.join(n_test, "fold", "left")
    return joined.filter(~F.col("n_pred").eqNullSafe(F.col("n_test")))


def read_confusion_csv(spark: SparkSession, path: str, table: dict[str, str] | None = None) -> DataFrame:
    """A written matrix back to long (class_name, predicted, value), labels translated.

    The first column holds the true class, whatever its header is.
    """
    wide = spark.read.option("header", True).csv(path)
    first, *rest = wide.columns
    return confusion_long(wide, first, rest, table)


def confusion_long(
    wide: DataFrame, index: str, columns: list[str], table: dict[str, str] | None = None
) -> DataFrame:
    long = wide.unpivot([f"`{index}`"], [f"`{c}`" for c in columns], "predicted", "text")
    return long.select(
        translate_label(F.col(f"`{index}`"), table).alias("class_name"),
        translate_label(F.col("predicted"), table).alias("predicted"),
        text_to_double(F.col("text")).alias("value"),
    )


def read_shap(spark: SparkSession, path: str) -> DataFrame:
    """Attributions stored by class; the class number is a column, so order is explicit."""
    return spark.read.parquet(path)
