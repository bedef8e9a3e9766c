"""Training, calibration, tuning and scoring."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from tablemill.catalog.base import FEATURES, parted_table, parted_vectors, query, r, table
from tablemill.functions.vectors import argmax_index
from tablemill.operators import elm, models, splitting
from tablemill.operators.calibration import calibrate
from tablemill.plans import bundles, finalize, nested_cv, scoring
from tablemill.plans.ledger import Ledger
from tablemill.session import materialize, new_path

_LABELS = 10
_DIMS = 64


def _vectors(spark, sf_dir):
    """Embeddings with their label; plain and scaled features are the same here."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("y"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )
    return rows.withColumn("features_scaled", F.col("features"))


def _predicted(model, rows):
    """Label, predicted label, whether the largest probability is above a half, and their sum."""
    scored = model.score(rows)
    return scored.select(
        "row_id",
        "y",
        argmax_index(F.col("proba")).alias("y_pred"),
        r(F.array_max("proba"), 0).alias("pmax"),
        r(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


_LEARNED = "SELECT vec_id AS row_id, label AS y, label AS y_pred, 1.0::DOUBLE AS pmax, 1.0::DOUBLE AS total FROM embeddings"


def _train(spark, sf_dir, name, params):
    rows = materialize(parted_vectors(spark, sf_dir), "vectors")
    return _predicted(models.fit_model(name, rows, "y", _LABELS, params), rows)


@query("train_rf", _LEARNED)
def train_rf(spark, sf_dir):
    return _train(spark, sf_dir, "RandomForest", {"n_estimators": 20, "max_depth": 8, "criterion": "log_loss"})


@query("train_gb", _LEARNED)
def train_gb(spark, sf_dir):
    return _train(spark, sf_dir, "GradientBoosting", {"n_estimators": 3, "max_depth": 3, "learning_rate": 1.0})


@query("train_mlp", _LEARNED)
def train_mlp(spark, sf_dir):
    return _train(spark, sf_dir, "MLP", {"hidden_layer_sizes": (16,), "max_iter": 100})


@query("train_mlp_relu", _LEARNED)
def train_mlp_relu(spark, sf_dir):
    """Units and a penalty that the built-in network doesn't have."""
    params = {"hidden_layer_sizes": (16,), "activation": "relu", "alpha": 0.0001, "max_iter": 30}
    return _train(spark, sf_dir, "MLP", params)


@query("train_elm", _LEARNED)
def train_elm(spark, sf_dir):
    params = {"hidden_units": 100, "activation_function": "tanh", "C": 10.0, "solver": "solution1"}
    return _train(spark, sf_dir, "ELM", params)


_UNITS = 3
_W = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(_DIMS)] for i in range(_UNITS)]
_B = [0.25 * i - 0.25 for i in range(_UNITS)]
_BETA = [[((5 * i + 2 * c) % 7 - 3) / 2 for c in range(4)] for i in range(_UNITS)]

_HIDDEN_SQL = "hid AS (SELECT vec_id, label, " + ", ".join(
    f"tanh(list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[]) + {b}::DOUBLE) AS h{i}"
    for i, (w, b) in enumerate(zip(_W, _B))
) + " FROM embeddings)"


def _fixed_layer():
    """A layer with stated weights, so that its outputs can be checked."""
    return elm.Layer(_UNITS, "tanh", np.array(_W), np.array(_B))


@query("elm_predict",
       f"WITH {_HIDDEN_SQL}, z AS (SELECT vec_id, "
       + ", ".join(f"round({' + '.join(f'h{i} * {_BETA[i][c]}::DOUBLE' for i in range(_UNITS))}, 6) + 0.0 AS z{c}" for c in range(4))
       + " FROM hid) SELECT *, list_position([z0, z1, z2, z3], greatest(z0, z1, z2, z3)) - 1 AS y_pred FROM z")
def elm_predict(spark, sf_dir):
    model = elm.ElmModel(_fixed_layer(), np.array(_BETA))
    scored = _vectors(spark, sf_dir).select("row_id", model.scores(F.col("features")).alias("z"))
    flat = scored.select(F.col("row_id").alias("vec_id"), F.transform("z", lambda x: F.round(x, 6) + F.lit(0.0)).alias("z"))
    return flat.select(
        "vec_id", *[F.get("z", F.lit(c)).alias(f"z{c}") for c in range(4)], argmax_index(F.col("z")).alias("y_pred")
    )


@query("elm_regression",
       f"WITH {_HIDDEN_SQL} SELECT vec_id, round({' + '.join(f'h{i} * {_BETA[i][0]}::DOUBLE' for i in range(_UNITS))}, 5) + 0.0 AS value FROM hid")
def elm_regression(spark, sf_dir):
    """Values that some output weights give exactly: training finds these weights."""
    rows = _vectors(spark, sf_dir)
    target = elm.ElmModel(_fixed_layer(), np.array(_BETA)).values(F.col("features"))
    rows = materialize(rows.select("row_id", "features", target.alias("target")), "values")
    model = elm.fit_layer(rows, "features", "target", None, _fixed_layer())
    return rows.select(F.col("row_id").alias("vec_id"), (r(model.values(F.col("features")), 5) + F.lit(0.0)).alias("value"))


@query("elm_gram",
       f"WITH {_HIDDEN_SQL} " + " UNION ALL ".join(
           [f"SELECT {i} AS unit, {j} AS position, round(sum(h{i} * h{j}), 5) AS value FROM hid" for i in range(_UNITS) for j in range(_UNITS)]
           + [f"SELECT {i}, {_UNITS + c}, round(sum(h{i} * (label = {c})::INT), 5) FROM hid" for i in range(_UNITS) for c in range(_LABELS)]))
def elm_gram(spark, sf_dir):
    """The sums that training solves: hidden x hidden and hidden x label."""
    rows = elm.gram_rows(_vectors(spark, sf_dir), [_fixed_layer()], "features", "y", _LABELS)
    return rows.select("unit", F.posexplode("values").alias("position", "value")).withColumn("value", r("value", 5))


@query("score_model",
       "SELECT vec_id AS row_id, 10 AS n_classes, 0.0::DOUBLE AS absent_class, "
       "CASE WHEN label > 0 THEN label END AS y_pred, CASE WHEN label > 0 THEN 1.0::DOUBLE END AS pmax FROM embeddings")
def score_model(spark, sf_dir):
    """Fitted without the first class: its probability is there and 0.

    Rows of that class have no right answer: NULL."""
    rows = materialize(parted_vectors(spark, sf_dir), "vectors")
    params = {"n_estimators": 10, "max_depth": 8, "criterion": "entropy"}
    model = models.fit_model("RandomForest", rows.filter("y > 0"), "y", _LABELS, params)
    scored = model.score(rows)
    known = F.col("y") > 0
    return scored.select(
        "row_id", F.size("proba").alias("n_classes"), F.get("proba", F.lit(0)).alias("absent_class"),
        F.when(known, argmax_index(F.col("proba"))).alias("y_pred"),
        F.when(known, r(F.array_max("proba"), 0)).alias("pmax"),
    )


@query("calibrate", _LEARNED)
def calibrate_(spark, sf_dir):
    """Sigmoid calibration of a forest over three stratified folds."""
    rows = splitting.stratified_kfold(parted_vectors(spark, sf_dir), "row_id", "y", 3, 42, out="cal_fold")
    rows = materialize(rows, "cal")

    def fit(part):
        return models.fit_model("RandomForest", part, "y", _LABELS, {"n_estimators": 10, "max_depth": 8, "criterion": "entropy"})

    return _predicted(calibrate(rows, fit, "y", _LABELS, "cal_fold", 3), rows)


# Trials that every right model gets right, and as the last a penalty no solution exists for.
_TRIALS = {
    "RandomForest": {"n_estimators": [5, 10], "max_depth": [8], "criterion": ["entropy"]},
    "GradientBoosting": {"n_estimators": [2], "max_depth": [3], "learning_rate": [1.0]},
    "MLP": {"hidden_layer_sizes": [[16], [24]], "max_iter": [100]},
    "ELM": {"hidden_units": [100], "activation_function": ["tanh"], "C": [10, 0], "random_type": ["normal"], "solver": ["no_re", "solution1"]},
}


def _trial_rows():
    for name, grid in _TRIALS.items():
        for i, p in enumerate(nested_cv.tuning.combinations(grid), start=1):
            failed = p.get("C") == 0 and p["solver"] == "solution1"
            yield f"('{name}-{i}', {'NULL' if failed else '1.0'}::DOUBLE, {0 if failed else 3}::BIGINT, {3 if failed else 0}::BIGINT)"


@query("grid_search", f"SELECT * FROM (VALUES {', '.join(_trial_rows())}) t(trial, mean_accuracy, n_ok, n_failed)")
def grid_search(spark, sf_dir):
    """Trial log of all four models over stratified inner folds."""
    s = nested_cv.Settings(k=_LABELS, inner_splits=3)
    dealt = materialize(splitting.stratified_kfold(parted_vectors(spark, sf_dir), "row_id", "y", 3, 42), "grid")
    splits = [(*splitting.split_train_test(dealt, f), None) for f in range(1, 4)]
    trials = None
    for name, grid in _TRIALS.items():
        found = nested_cv.grid_search(name, splits, s, grid).withColumn("trial", F.concat(F.lit(f"{name}-"), "trial"))
        trials = found if trials is None else trials.unionByName(found)
    return nested_cv.tuning.trial_log(trials)


_SMALL = {
    "RandomForest": {"n_estimators": 10, "max_depth": 5, "max_features": "all"},
    "GradientBoosting": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.5},
    "MLP": {"hidden_layer_sizes": [8], "max_iter": 60},
    "ELM": {"hidden_units": 60, "activation_function": "sigmoid", "C": 100.0, "solver": "solution2"},
}


def _bundle(spark, sf_dir):
    """All features, fitted, stored and read again."""
    wide = materialize(parted_table(spark, sf_dir), "wide")
    s = nested_cv.Settings(k=2, threshold=1.0)
    path = new_path(spark, "bundles")
    bundles.save_bundle(spark, finalize.fit_final(wide, FEATURES, ["even", "odd"], _SMALL, s), path)
    return wide, bundles.load_bundle(spark, path)


_FOLD_GRIDS = {
    "RandomForest": {"n_estimators": [5], "max_depth": [3, 5], "max_features": ["all"]},
    "GradientBoosting": {"n_estimators": [3], "max_depth": [2], "learning_rate": [0.5]},
    "MLP": {"hidden_layer_sizes": [[8]], "max_iter": [60]},
    "ELM": {"hidden_units": [60], "activation_function": ["sigmoid"], "C": [1, 100], "random_type": ["normal"], "solver": ["no_re", "solution2"]},
}


@query("nested_cv_fold",
       "WITH folds AS (SELECT o_orderkey AS row_id, (o_orderkey % 2)::INTEGER AS y, ((row_number() OVER (PARTITION BY o_orderkey % 2 "
       "ORDER BY md5(o_orderkey || '-42'), o_orderkey) - 1) % 5 + 1)::INTEGER AS fold FROM orders) "
       "SELECT fold, m AS model, row_id, y AS y_true, y AS y_pred, 1.0::DOUBLE AS pmax FROM folds, "
       "(VALUES ('RandomForest'), ('GradientBoosting'), ('MLP'), ('ELM'), ('Ensemble')) v(m)")
def nested_cv_fold(spark, sf_dir):
    """Every one of five outer folds: inner searches of all models, fits and predictions,
    read from the ledger the run leaves."""
    wide = materialize(parted_table(spark, sf_dir), "wide")
    s = nested_cv.Settings(k=2, outer_splits=5, inner_splits=2, threshold=1.0, grids=_FOLD_GRIDS)
    ledger = Ledger(spark, new_path(spark, "ledger"))
    folds = nested_cv.run_nested_cv(wide, FEATURES, s, ledger=ledger)
    found = reduce(lambda a, b: a.unionByName(b), [f.predictions for f in folds])
    return found.select("fold", "model", "row_id", "y_true", "y_pred", r(F.array_max("proba"), 0).alias("pmax"))


@query("fit_final",
       "SELECT m AS model, 1.0::DOUBLE AS accuracy, (SELECT count(*) FROM orders) AS n "
       "FROM (VALUES ('RandomForest'), ('GradientBoosting'), ('MLP'), ('ELM'), ('Ensemble')) v(m)")
def fit_final(spark, sf_dir):
    """All four models on all rows; share of rows each of them and the ensemble gets right."""
    wide, bundle = _bundle(spark, sf_dir)
    scored = scoring.score_batch(wide, bundle, ["row_id", "y"])
    names = (*models.MODEL_NAMES, models.ENSEMBLE)
    hits = [
        F.struct(
            F.lit(n).alias("model"),
            r(F.avg((argmax_index(F.col(f"proba_{n}")) == F.col("y")).cast("double")), 6).alias("accuracy"),
            F.count(F.lit(1)).alias("n"),
        )
        for n in names
    ]
    return scored.agg(F.array(*hits).alias("h")).select(F.inline("h"))


@query("score_batch",
       "SELECT o_orderkey AS composition, CASE o_orderkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS phase_top1, "
       "1.0::DOUBLE AS proba_top1, CASE o_orderkey % 2 WHEN 0 THEN 'odd' ELSE 'even' END AS phase_top2, 0.0::DOUBLE AS proba_top2, "
       "(1 - o_orderkey % 2)::DOUBLE AS proba_even, (o_orderkey % 2)::DOUBLE AS proba_odd FROM orders")
def score_batch(spark, sf_dir):
    """New rows through a stored bundle: other column spellings, text cells, one column
    missing and one not needed."""
    wide, bundle = _bundle(spark, sf_dir)
    short = {"minimo": "min", "maximo": "max", "soma": "sum", "media": "mean", "desvio": "std"}
    renamed = [F.col(c).alias(f"{v}_{short[e]}") for c in FEATURES[2:] for v, e in [c.rsplit("_", 1)]]
    incoming = wide.select(
        F.col("row_id").alias("composition"), F.col(FEATURES[1]).cast("string").alias(FEATURES[1]), *renamed,
        F.lit(1.0).alias("Keq_x"),
    )
    found = scoring.score_table(incoming, bundle, ["composition"], write_full_proba=True)
    return found.select(
        "composition",
        "phase_top1",
        "phase_top2",
        *[r(c, 0).alias(c) for c in found.columns if c.startswith("proba_")],
    )
