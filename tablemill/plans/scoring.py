"""Scoring new rows: one chain of narrow steps from raw columns to class probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.models import ENSEMBLE, MODEL_NAMES, Classifier, ensemble_of
from tablemill.operators.prep import (
    Preprocessing,
    apply_preprocessing,
    coerce_numeric,
    drop_matching,
    rename_aliases,
)
from tablemill.functions.vectors import mean_of_arrays
from tablemill.sources.sinks import model_columns, predictions_table


@dataclass
class Bundle:
    """What a finished training run hands to scoring."""

    pre: Preprocessing
    classes: list[str]
    models: dict[str, Classifier]

    @property
    def k(self) -> int:
        return len(self.classes)


def prepare(df: DataFrame, pre: Preprocessing, key: list[str]) -> DataFrame:
    """Rename, drop, coerce, align, impute, select and scale; keeps only the key columns."""
    renamed, _ = rename_aliases(df, list(pre.medians))
    wanted = [c for c in drop_matching(renamed).columns if c in key or c in pre.medians]
    numeric = coerce_numeric(renamed.select(*[f"`{c}`" for c in wanted]), keep=key)
    return apply_preprocessing(numeric, pre, key)


def score_batch(df: DataFrame, bundle: Bundle, key: list[str]) -> DataFrame:
    """All four models and their ensemble: key columns and one array per model."""
    scored = prepare(df, bundle.pre, key)
    for name in MODEL_NAMES:
        scored = bundle.models[name].score(scored, f"proba_{name}")
    members = [F.col(f"proba_{n}") for n in MODEL_NAMES]
    return scored.withColumn(f"proba_{ENSEMBLE}", mean_of_arrays(members)).drop(
        "features", "features_scaled"
    )


def scorer(bundle: Bundle, name: str = ENSEMBLE) -> Callable[[DataFrame], DataFrame]:
    """One model of a bundle, or its ensemble, as a function from feature columns to ``proba``.

    The columns are the bundle's final features, unscaled; whatever else the table has stays.
    """
    pre = bundle.pre

    def score(df: DataFrame) -> DataFrame:
        plain = [F.col(f"`{c}`").cast("double") for c in pre.final_features]
        scaled = [(v - F.lit(m)) / F.lit(s) for v, m, s in zip(plain, pre.scaler_mean, pre.scaler_scale)]
        arrays = df.withColumns({"features": F.array(*plain), "features_scaled": F.array(*scaled)})
        model = ensemble_of(bundle.models, bundle.k) if name == ENSEMBLE else bundle.models[name]
        return model.score(arrays, "proba").drop("features", "features_scaled")

    return score


def score_table(
    df: DataFrame, bundle: Bundle, key: list[str], every_model: bool = False, write_full_proba: bool = False
) -> DataFrame:
    """Output table of a scoring run: top two of the ensemble, or columns per model."""
    scored = score_batch(df, bundle, key)
    if not every_model:
        return predictions_table(scored, key, bundle.classes, f"proba_{ENSEMBLE}", write_full_proba)
    columns = [
        c
        for name in (*MODEL_NAMES, ENSEMBLE)
        for c in model_columns(name, F.col(f"proba_{name}"), bundle.classes, write_full_proba)
    ]
    return scored.select(*key, *columns)
