"""After the folds: final parameters, final models on all rows, and the report tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators import metrics, tuning
from tablemill.operators.models import MODEL_NAMES
from tablemill.operators.prep import apply_preprocessing, fit_preprocessing, fit_scaler, impute
from tablemill.operators.selection import stable_features
from tablemill.plans.nested_cv import FoldResult, Settings, fit_tuned
from tablemill.plans.scoring import Bundle
from tablemill.session import materialize


def params_table(results: list[FoldResult], prefix: str = "model__") -> DataFrame:
    """(fold, model, param, value as JSON text) of every fold's best parameters."""
    rows = [
        (r.fold, model, prefix + p, json.dumps(v, sort_keys=True))
        for r in results
        for model, params in r.best_params.items()
        for p, v in params.items()
    ]
    spark = results[0].predictions.sparkSession
    return spark.createDataFrame(rows, "fold int, model string, param string, value string")


def selection_table(results: list[FoldResult]) -> DataFrame:
    rows = [(r.fold, m, fs) for r in results for m, fs in r.features.items()]
    spark = results[0].predictions.sparkSession
    return spark.createDataFrame(rows, "fold int, model string, features array<string>")


def chosen_params(params: DataFrame, predictions: DataFrame) -> dict[str, dict]:
    outer = metrics.accuracy(predictions, ["fold", "model"]).select("fold", "model", "accuracy")
    rows = tuning.final_params(params, outer).collect()
    chosen: dict[str, dict] = {}
    for r in rows:
        chosen.setdefault(r["model"], {})[r["param"]] = json.loads(r["value"])
    return chosen


def fit_final(
    df: DataFrame,
    features: list[str],
    classes: list[str],
    params: dict[str, dict],
    s: Settings,
    policy: str = "all_data",
    selected: DataFrame | None = None,
) -> Bundle:
    """Preprocessing and all four models on all rows.

    ``policy`` is ``all_data`` (correlation filter on all rows) or ``stable_50pct``
    (features in at least half of the folds' selections: ``fold, feature``).
    """
    pre = fit_preprocessing(df, features, s.threshold)
    if policy == "stable_50pct" and selected is not None:
        n_lists = selected.select("fold").distinct().count()
        stable = {r["feature"] for r in stable_features(selected, n_lists).collect()}
        if stable:
            pre.final_features = [f for f in pre.kept_after_constant_filter if f in stable]
            filled = impute(df.select(*[f"`{c}`" for c in features]), pre.medians)
            pre.scaler_mean, pre.scaler_scale = fit_scaler(filled, pre.final_features)
    elif policy not in ("all_data", "stable_50pct"):
        raise ValueError(f"unknown feature policy {policy!r}")
    train = materialize(apply_preprocessing(df, pre, [s.row_id, s.label]), "final")
    models = {n: fit_tuned(n, train, params.get(n, {}), s) for n in MODEL_NAMES}
    return Bundle(pre, classes, models)


def report(predictions: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """Every table of the final report from the stored predictions."""
    k = len(classes)
    per_fold = metrics.fold_metrics(predictions, k)
    per_class = metrics.fold_classwise(predictions, k)
    cells = metrics.confusion_counts(predictions, k, ["model"])
    with_curves = predictions.filter(F.col("model") != "ELM")
    return {
        "oof_summary": metrics.oof_metrics(predictions, k),
        "oof_classwise": metrics.prf_classwise(predictions, k, ["model"]),
        "fold_metrics": per_fold,
        "fold_classwise": per_class,
        "fold_mean_std": metrics.fold_mean_std(per_fold),
        "classwise_mean_std": metrics.classwise_mean_std(per_class),
        "confusion_counts": cells,
        "confusion_norm": metrics.confusion_norm(cells, ["model"]),
        "roc_auc": metrics.auc_ovr(with_curves, k, ["model"]),
        "accuracy_summary": metrics.accuracy_summary(
            per_fold.select("fold", "model", F.col("accuracy").cast("string").alias("accuracy"))
        ),
    }

