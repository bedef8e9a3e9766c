"""Parameter grids, trial tables and the choice of final parameters."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The full search grids. Order matters: the first of equal trials wins.
GRID_FOREST = {
    "n_estimators": [50, 100, 200, 500],
    "max_depth": [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    "max_features": ["sqrt", "log2"],
    "max_leaf_nodes": [7, 9, 12, 14],
    "criterion": ["gini", "entropy", "log_loss"],
}
GRID_BOOSTING = {
    "loss": ["log_loss"],
    "criterion": ["friedman_mse", "squared_error"],
    "max_features": ["sqrt", "log2"],
    "max_leaf_nodes": [7, 9, 12, 14],
    "n_estimators": [50, 100, 200, 500],
    "max_depth": [3, 5, 7],
}
GRID_MLP = {
    "hidden_layer_sizes": [(30,), (36,), (40,), (30, 30), (36, 36), (40, 40)],
    "activation": ["identity", "logistic", "tanh", "relu"],
    "solver": ["lbfgs", "sgd", "adam"],
    "alpha": [0.0001, 1e-16],
    "max_iter": [20000],
    "learning_rate_init": [0.001, 0.000001],
    "learning_rate": ["constant", "invscaling", "adaptive"],
}
ELM_UNITS = [3, 6, 9, 12, 15, 18, 20, 22, 25, 32, 36, 40, 50, 75, 100, 150, 200, 400]
ELM_ACTIVATIONS = ["sigmoid", "relu", "sin", "tanh", "leaky_relu"]
GRID_ELM = [
    {
        "hidden_units": ELM_UNITS,
        "activation_function": ELM_ACTIVATIONS,
        "C": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 17, 25],
        "random_type": ["normal", "uniform"],
        "solver": ["no_re"],
    },
    {
        "hidden_units": ELM_UNITS,
        "activation_function": ELM_ACTIVATIONS,
        "C": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 17, 25],
        "random_type": ["normal", "uniform"],
        "solver": ["solution1", "solution2"],
    },
]

# Reduced defaults that the built-in estimators can express and a session can finish.
SMALL_GRID_FOREST = {"n_estimators": [20, 50], "max_depth": [5, 8], "criterion": ["gini", "entropy"]}
SMALL_GRID_BOOSTING = {"n_estimators": [5, 10], "max_depth": [3]}
SMALL_GRID_MLP = {"hidden_layer_sizes": [(16,), (16, 16)], "max_iter": [100]}
SMALL_GRID_ELM = [
    {
        "hidden_units": [9, 25, 50],
        "activation_function": ELM_ACTIVATIONS,
        "C": [1, 10],
        "random_type": ["normal"],
        "solver": ["no_re"],
    },
    {
        "hidden_units": [9, 25, 50],
        "activation_function": ELM_ACTIVATIONS,
        "C": [1, 10],
        "random_type": ["normal"],
        "solver": ["solution1", "solution2"],
    },
]


def combinations(grids: dict | list[dict]) -> list[dict]:
    """Combinations of one grid or several, last key fastest, grids one after another."""
    out = []
    for grid in grids if isinstance(grids, list) else [grids]:
        out += [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return out


def param_grid(spark: SparkSession, grids: dict | list[dict]) -> DataFrame:
    """The grid as a table: ``trial`` from 1 and ``params`` as a map of JSON values."""
    rows = [
        (i, {k: json.dumps(v) for k, v in combo.items()})
        for i, combo in enumerate(combinations(grids), start=1)
    ]
    return spark.createDataFrame(rows, "trial int, params map<string,string>")


def grid_of_tables(tables: list[DataFrame]) -> DataFrame:
    """Grid from value tables (``value``, ``ord`` each), numbered in grid order.

    Each table is one parameter's short value list; the product is explode after explode of
    collected lists, first table slowest.
    """
    tagged = [t.select(F.lit(i).alias("tag"), "ord", F.col("value").cast("string")) for i, t in enumerate(tables)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    entry = F.struct("ord", "value")
    grid = rows.agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("tag") == i, entry))).alias(f"l{i}")
            for i in range(len(tables))
        ]
    )
    for i in range(len(tables)):
        grid = grid.withColumn(f"p{i}", F.explode(f"l{i}"))
    order = [F.col(f"p{i}.ord") for i in range(len(tables))]
    return grid.select(
        F.row_number().over(Window.orderBy(*order)).alias("trial"),
        *[F.col(f"p{i}.value").alias(f"value_{i}") for i in range(len(tables))],
    )


def trial_log(results: DataFrame, trial: str = "trial") -> DataFrame:
    """Mean accuracy and number of good and failed folds per trial; failed folds are NULL."""
    return results.groupBy(trial).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.count("accuracy").alias("n_ok"),
        F.count_if(F.col("accuracy").isNull()).alias("n_failed"),
    )


def best_trial(log: DataFrame, trial: str = "trial") -> DataFrame:
    """The first trial with the highest mean accuracy, as one row; an empty log stays empty.

    One aggregate, not a sort: the pair (mean, -trial) is compared as a whole.
    """
    usable = log.filter(F.col("n_ok") > 0)
    best = F.max_by(F.struct(*log.columns), F.struct("mean_accuracy", -F.col(trial))).alias("best")
    return usable.agg(best).filter("best IS NOT NULL").select("best.*")


def pending_folds(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done.select("fold").distinct(), "fold", "left_anti")


def mode_tiebreak(params: DataFrame, outer_accuracy: DataFrame) -> DataFrame:
    """Most frequent value per (model, param) over folds.

    ``params``: fold, model, param, value (JSON text). Equal counts go to the value of the
    fold with the best outer accuracy among the folds holding the parameter, when it is one
    of the tied; else to the one seen in the earliest fold.
    """
    scored = params.join(outer_accuracy, ["fold", "model"], "left")
    accuracy = F.coalesce("accuracy", F.lit(-1e9))
    best_fold = scored.groupBy("model", "param").agg(
        F.min_by("value", F.struct((-accuracy).alias("a"), F.col("fold"))).alias("best_value")
    )
    counts = scored.groupBy("model", "param", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("fold").alias("first_fold")
    )
    order = F.struct(
        (-F.col("n")).alias("n"),
        (F.col("value") != F.col("best_value")).alias("not_best"),
        F.col("first_fold"),
        F.col("value"),
    )
    return (
        counts.join(best_fold, ["model", "param"])
        .groupBy("model", "param")
        .agg(F.min_by(F.struct("value", "n"), order).alias("w"))
        .select("model", "param", "w.value", F.col("w.n").alias("n_folds"))
    )


def final_params(params: DataFrame, outer_accuracy: DataFrame, prefix: str = "model__") -> DataFrame:
    """The chosen values with the pipeline prefix taken off the parameter names."""
    chosen = mode_tiebreak(params, outer_accuracy)
    return chosen.withColumn("param", F.regexp_replace("param", "^" + prefix, ""))
