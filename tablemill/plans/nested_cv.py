"""Nested cross-validation: tune on inner folds, predict the outer fold, ensemble."""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import argmax_index, mean_of_arrays
from tablemill.operators import tuning
from tablemill.operators.calibration import calibrate, can_calibrate
from tablemill.operators.elm import grid_accuracy
from tablemill.operators.models import ENSEMBLE, MODEL_NAMES, Classifier, fit_model
from tablemill.operators.ordering import free_name
from tablemill.operators.prep import Preprocessing, apply_preprocessing, fit_preprocessing_splits
from tablemill.operators.selection import perm_importance, pfi_aggregate, pick_topk
from tablemill.operators.splitting import (
    cells_left_out,
    class_counts,
    inner_fold,
    inner_split_count,
    split_train_test,
    stratified_kfold,
)
from tablemill.plans.ledger import Ledger
from tablemill.session import discard, materialize, new_path


@dataclass
class Settings:
    """Choices of a run. The correlation limit is 0.59, or 0.80 with importance selection."""

    row_id: str = "row_id"
    label: str = "y"
    k: int = 2
    outer_splits: int = 5
    inner_splits: int = 5
    seed: int = 42
    threshold: float = 0.59
    grids: dict = field(
        default_factory=lambda: {
            "RandomForest": tuning.SMALL_GRID_FOREST,
            "GradientBoosting": tuning.SMALL_GRID_BOOSTING,
            "MLP": tuning.SMALL_GRID_MLP,
            "ELM": tuning.SMALL_GRID_ELM,
        }
    )
    parallelism: int = 4
    outer_parallelism: int = 2
    calibration: str | None = None
    calibration_folds: int = 3
    top_features: int | None = None
    repeats: int = 10


@dataclass
class FoldResult:
    fold: int
    predictions: DataFrame
    best_params: dict[str, dict]
    best_inner: dict[str, float]
    features: dict[str, list[str]]


def prepared_splits(
    dealt: DataFrame, features: list[str], folds: list[int], s: Settings, fold_column: str = "inner_fold"
) -> dict[int | None, tuple[DataFrame, DataFrame, Preprocessing]]:
    """(train, validation, preprocessing) of every fold, and under None of the whole table.

    All fits share their looks at the stored table ``dealt``. A split is an expression over
    that table, one filter and one select, and is never written.
    """
    return _applied(dealt, fit_preprocessing_splits(dealt, features, fold_column, [None, *folds], s.threshold), s, fold_column)


def _applied(
    dealt: DataFrame, fitted: dict[int | None, Preprocessing], s: Settings, fold_column: str = "inner_fold"
) -> dict[int | None, tuple[DataFrame, DataFrame, Preprocessing]]:
    keep = [s.row_id, s.label]
    out = {}
    for fold, pre in fitted.items():
        train, valid = (dealt, dealt.limit(0)) if fold is None else split_train_test(dealt, fold, fold_column)
        out[fold] = (apply_preprocessing(train, pre, keep), apply_preprocessing(valid, pre, keep), pre)
    return out


def inner_fold_count(train: DataFrame, s: Settings) -> int:
    return int(inner_split_count(class_counts(train, s.label), s.inner_splits).first()["inner_splits"])


def grid_search(
    name: str, splits: list[tuple[DataFrame, DataFrame, Preprocessing]], s: Settings, grid=None
) -> DataFrame:
    """Trials x inner folds: ``trial, fold, accuracy, params``; a failed fit has NULL accuracy.

    Preprocessing is fitted once per inner split and shared by all trials. The random-layer
    model covers its whole grid in two passes per split; the others run a few fits at a time,
    whichever split they belong to.
    """
    combos = tuning.combinations(grid if grid is not None else s.grids[name])
    spark = splits[0][0].sparkSession

    def whole_grid(job):
        fold, (train, valid, _) = job
        found = grid_accuracy(train, valid, combos, "features_scaled", s.label, s.k, s.seed)
        return [(i, fold, found[i], json.dumps(p)) for i, p in enumerate(combos, start=1)]

    def one_trial(job):
        (fold, (train, valid, _)), (i, params) = job
        try:
            model = fit_model(name, train, s.label, s.k, params, s.seed)
            hit = (F.col("y_pred") == F.col(s.label)).cast("double")
            accuracy = model.predict(valid).agg(F.avg(hit)).first()[0]
        except IllegalArgumentException:  # the estimator refuses these settings: logged, not fatal
            accuracy = None
        return [(i, fold, accuracy, json.dumps(params))]

    numbered = list(enumerate(splits, start=1))
    run, jobs = (whole_grid, numbered) if name == "ELM" else (one_trial, itertools.product(numbered, enumerate(combos, start=1)))
    with ThreadPoolExecutor(s.parallelism) as pool:
        rows = [r for part in pool.map(inheritable_thread_target(spark)(run), jobs) for r in part]
    return spark.createDataFrame(rows, "trial int, fold int, accuracy double, params string")


def best_params(trials: DataFrame) -> tuple[dict, float]:
    """Parameters and mean accuracy of the winning trial; fails when no trial worked."""
    params = trials.groupBy("trial").agg(F.first("params").alias("params"))
    row = tuning.best_trial(tuning.trial_log(trials)).join(params, "trial").first()
    if row is None:
        raise RuntimeError("no parameter combination could be fitted")
    return json.loads(row["params"]), float(row["mean_accuracy"])


def inner_importance(
    name: str, params: dict, splits: list[tuple[DataFrame, DataFrame, Preprocessing]], s: Settings
) -> DataFrame:
    """Permutation importance of each feature, averaged over the inner validation folds."""
    parts = None
    for train, valid, pre in splits:
        model = fit_model(name, train, s.label, s.k, params, s.seed)
        source = model.features
        names = pre.final_features
        # read once for every feature and repeat
        wide = materialize(
            valid.select(s.row_id, s.label, *[F.get(F.col(source), F.lit(i)).alias(f) for i, f in enumerate(names)]), "valid"
        )

        def predict(df: DataFrame, model=model, source=source, names=names) -> DataFrame:
            return model.predict(df.withColumn(source, F.array(*[F.col(f"`{f}`") for f in names])))

        found = perm_importance(wide, s.row_id, s.label, names, predict, s.repeats, s.seed)
        parts = found if parts is None else parts.unionByName(found)
    return pfi_aggregate(parts, len(splits))


def tuned_choice(
    name: str, splits: list[tuple[DataFrame, DataFrame, Preprocessing]], final: list[str], s: Settings, fold: int, ledger: Ledger
) -> tuple[dict, float, list[str]]:
    """Parameters, inner accuracy and features of one model, from the ledger or by search."""
    if (fold, name) in ledger.done("choices"):
        return ledger.choice(fold, name)
    if (fold, name) not in ledger.done("trials"):
        ledger.put("trials", grid_search(name, splits, s).withColumnRenamed("fold", "inner_fold"), fold, name)
    params, accuracy = best_params(ledger.get("trials", fold, name).withColumnRenamed("inner_fold", "fold"))
    used = final
    if s.top_features:
        scores = inner_importance(name, params, splits, s)
        available = scores.sparkSession.createDataFrame(list(enumerate(final)), "position int, feature string")
        used = [r["feature"] for r in pick_topk(scores, available, s.top_features).orderBy("rank").collect()]
    ledger.put_choice(fold, name, params, accuracy, used)
    return params, accuracy, used


def run_outer_fold(
    df: DataFrame,
    features: list[str],
    fold: int,
    s: Settings,
    fold_column: str = "fold",
    ledger: Ledger | None = None,
    inner: InnerFolds | None = None,
) -> FoldResult:
    """Tune, fit and predict one outer fold of a table that carries its fold numbers.

    What the ledger holds is not done again: a fold with predictions is read, a model with
    a choice is not tuned. Without a ledger the run keeps its own. Without ``inner`` the inner
    folds are dealt and fitted for this fold alone.
    """
    ledger = ledger or Ledger(df.sparkSession, new_path(df.sparkSession, "ledger"))
    if (fold, ENSEMBLE) not in ledger.done("predictions"):
        _finish_fold(df, features, fold, s, fold_column, ledger, inner)
    chosen, inner_scores, used = {}, {}, {}
    for name in MODEL_NAMES:
        chosen[name], inner_scores[name], used[name] = ledger.choice(fold, name)
    return FoldResult(fold, ledger.predictions(fold), chosen, inner_scores, used)


@dataclass
class InnerFolds:
    """Inner folds of one outer fold: the column that deals them and what is fitted to each split."""

    column: Column
    fitted: dict[int | None, Preprocessing]


def shared_inner_folds(
    dealt: DataFrame, features: list[str], folds: list[int], s: Settings, rank: str, fold_column: str = "fold"
) -> dict[int, InnerFolds]:
    """Inner folds and preprocessing of all outer folds with the looks at the data of one.

    Both deals are in the order of the same hash, so ``rank`` in the outer one says a row's fold in
    every inner one, and ranks alike modulo outer x inner folds are in the same folds throughout.
    Empty where outer folds differ in their number of inner folds, as tiny classes make them.
    """
    counts = {inner_fold_count(split_train_test(dealt, f, fold_column)[0], s) for f in folds}
    if len(counts) != 1:
        return {}
    (k,) = counts
    cell = free_name(dealt, "_cell")
    celled = dealt.withColumn(cell, F.pmod(F.col(rank) - 1, F.lit(s.outer_splits * k)).cast("int"))
    left_out = {(f, i): cells_left_out(s.outer_splits, f, k, i) for f in folds for i in (None, *range(1, k + 1))}
    fitted = fit_preprocessing_splits(celled, features, cell, list(dict.fromkeys(left_out.values())), s.threshold)
    return {
        f: InnerFolds(
            inner_fold(F.col(rank), s.outer_splits, f, k), {i: fitted[left_out[f, i]] for i in (None, *range(1, k + 1))}
        )
        for f in folds
    }


def _finish_fold(
    df: DataFrame, features: list[str], fold: int, s: Settings, fold_column: str, ledger: Ledger, inner: InnerFolds | None = None
) -> None:
    train, test = split_train_test(df, fold, fold_column)
    train = train.drop(fold_column)
    if inner:
        prepared = _applied(train.withColumn("inner_fold", inner.column), inner.fitted, s)
    else:
        k_inner = inner_fold_count(train, s)
        dealt = materialize(stratified_kfold(train, s.row_id, s.label, k_inner, s.seed, out="inner_fold"), "inner")
        prepared = prepared_splits(dealt, features, list(range(1, k_inner + 1)), s)
    full_train, _, pre = prepared.pop(None)
    splits = list(prepared.values())
    scored = apply_preprocessing(test, pre, [s.row_id, s.label]).withColumnsRenamed({c: f"_all_{c}" for c in ARRAYS})
    for name in MODEL_NAMES:
        params, _, used = tuned_choice(name, splits, pre.final_features, s, fold, ledger)
        positions = [pre.final_features.index(f) for f in used]
        model = fit_tuned(name, _narrowed(full_train, {c: c for c in ARRAYS}, positions), params, s)
        # one chain over the rows: no model's scores are joined to another's
        scored = model.score(_narrowed(scored, {f"_all_{c}": c for c in ARRAYS}, positions), f"proba_{name}")
    scored = scored.withColumn(f"proba_{ENSEMBLE}", mean_of_arrays([F.col(f"proba_{n}") for n in MODEL_NAMES]))
    packed = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(f"proba_{n}").alias("proba")) for n in (*MODEL_NAMES, ENSEMBLE)]
    )
    rows = scored.select(F.lit(fold).alias("fold"), s.row_id, F.col(s.label).alias("y_true"), F.inline(packed))
    ledger.put_predictions(rows.withColumn("y_pred", argmax_index(F.col("proba"))))


ARRAYS = ("features", "features_scaled")


def _narrowed(df: DataFrame, arrays: dict[str, str], positions: list[int]) -> DataFrame:
    """The entries at ``positions`` of array columns, under the names given."""
    return df.withColumns(
        {new: F.array(*[F.get(F.col(c), F.lit(i)) for i in positions]) for c, new in arrays.items()}
    )


def fit_tuned(name: str, train: DataFrame, params: dict, s: Settings) -> Classifier:
    def fit(rows: DataFrame) -> Classifier:
        return fit_model(name, rows, s.label, s.k, params, s.seed)

    if not s.calibration or name == "ELM":
        return fit(train)
    smallest = class_counts(train, s.label).agg(F.min("n")).first()[0]
    if not can_calibrate(smallest, s.calibration_folds):
        return fit(train)
    dealt = materialize(
        stratified_kfold(train, s.row_id, s.label, s.calibration_folds, s.seed, out="cal_fold"), "dealt"
    )
    return calibrate(dealt, fit, s.label, s.k, "cal_fold", s.calibration_folds, s.calibration)


def run_nested_cv(
    df: DataFrame, features: list[str], s: Settings, done: DataFrame | None = None, ledger: Ledger | None = None
) -> list[FoldResult]:
    """All outer folds that are not in ``done``. Folds come from the stratified rule.

    With a ledger, folds it holds are read from it and a run that was stopped goes on where
    it stood: the folds depend on ids and seed alone, so a restart deals the same ones.
    Rows are shuffled and the preprocessing fitted once for all folds; a few folds run at a time.
    """
    spark = df.sparkSession
    planned = spark.createDataFrame([(f,) for f in range(1, s.outer_splits + 1)], "fold int")
    todo = planned if done is None else tuning.pending_folds(planned, done)
    folds = [r["fold"] for r in todo.orderBy("fold").collect()]
    finished = ledger.done("predictions") if ledger else set()
    open_ = [f for f in folds if (f, ENSEMBLE) not in finished]
    dealt, inner = df, {}
    if open_:
        rank = free_name(df, "_rank")
        dealt = materialize(stratified_kfold(df, s.row_id, s.label, s.outer_splits, s.seed, rank=rank), "outer")
        inner = shared_inner_folds(dealt, features, open_, s, rank)

    def run(fold: int) -> FoldResult:
        return run_outer_fold(dealt, features, fold, s, ledger=ledger, inner=inner.get(fold))

    with ThreadPoolExecutor(s.outer_parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(run), folds))
    if open_:
        discard(dealt)
    return found
