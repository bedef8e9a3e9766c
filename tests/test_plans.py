import os

import pytest
from pyspark.sql import functions as F

from tablemill.catalog import models as model_queries
from tablemill.catalog.base import feature_table
from tablemill.operators.models import MODEL_NAMES
from tablemill.plans import finalize, nested_cv, scoring
from tablemill.plans.ledger import Ledger
from tablemill.session import materialize, new_path, shared_dir
from tablemill.sources import sinks, tables
from tablemill.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"
FEATURES = ["qty_soma", "price_media", "disc_media", "tax_desvio", "qty_desvio", "price_soma"]
GRIDS = {
    "RandomForest": {"n_estimators": [4], "max_depth": [3, 4]},
    "GradientBoosting": {"n_estimators": [2], "max_depth": [2]},
    "MLP": {"hidden_layer_sizes": [[4]], "max_iter": [10]},
    "ELM": {"hidden_units": [4, 6], "activation_function": ["tanh"], "C": [1], "random_type": ["normal"], "solver": ["solution1"]},
}


@pytest.fixture(scope="module")
def wide(spark):
    return materialize(feature_table(spark, SF, ["qty", "price", "disc", "tax"]), "wide")


@pytest.fixture(scope="module")
def results(spark, wide):
    s = nested_cv.Settings(k=3, outer_splits=2, inner_splits=2, grids=GRIDS, top_features=3, repeats=2, threshold=0.8)
    return s, nested_cv.run_nested_cv(wide, FEATURES, s)


def test_nested_folds(spark, wide, results):
    s, found = results
    assert [r.fold for r in found] == [1, 2]
    preds = materialize(found[0].predictions.unionByName(found[1].predictions), "preds")
    assert preds.count() == 5 * wide.count()
    assert preds.select("row_id", "model").distinct().count() == preds.count()
    sums = preds.select(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert tuple(sums) == (pytest.approx(1.0), pytest.approx(1.0))
    assert all(len(fs) <= 3 for r in found for fs in r.features.values())
    report = finalize.report(preds, ["F", "O", "P"])
    assert report["oof_summary"].count() == 5
    assert report["fold_metrics"].count() == 10
    assert report["roc_auc"].count() == 12
    assert report["confusion_counts"].agg(F.sum("n")).first()[0] == preds.count()
    params = finalize.chosen_params(finalize.params_table(found), preds)
    assert params["ELM"]["solver"] == "solution1" and params["RandomForest"]["n_estimators"] == 4
    assert finalize.selection_table(found).count() == 8


def test_done_folds_are_skipped(spark, wide, results):
    s, _ = results
    done = spark.createDataFrame([(1,), (2,)], "fold int")
    assert nested_cv.run_nested_cv(wide, FEATURES, s, done) == []


def test_a_run_goes_on_where_it_stopped(spark, wide, monkeypatch):
    """Folds in the ledger are read; models with a choice are fitted once and not tuned."""
    s = nested_cv.Settings(k=3, outer_splits=2, inner_splits=2, grids=GRIDS, threshold=0.8)
    fits, searches = [], []
    fit, search = nested_cv.fit_model, nested_cv.grid_search
    monkeypatch.setattr(nested_cv, "fit_model", lambda name, *a, **k: fits.append(name) or fit(name, *a, **k))
    monkeypatch.setattr(nested_cv, "grid_search", lambda name, *a, **k: searches.append(name) or search(name, *a, **k))
    whole = Ledger(spark, new_path(spark, "ledger"))
    later = spark.createDataFrame([(2,)], "fold int")
    (first,) = nested_cv.run_nested_cv(wide, FEATURES, s, later, whole)
    assert len(searches) == 4 and whole.done("predictions") == {(1, m) for m in (*MODEL_NAMES, "Ensemble")}
    fits.clear(), searches.clear()
    (again,) = nested_cv.run_nested_cv(wide, FEATURES, s, later, whole)
    assert fits == [] and searches == []
    assert again.best_params == first.best_params and again.features == first.features
    assert again.predictions.exceptAll(first.predictions).count() == 0

    # stopped after two models were tuned
    half = Ledger(spark, new_path(spark, "ledger"))
    for kind in ("trials", "choices"):
        for name in ("RandomForest", "ELM"):
            half.put(kind, whole.get(kind, 1, name), 1, name)
    (rest,) = nested_cv.run_nested_cv(wide, FEATURES, s, later, half)
    assert sorted(searches) == ["GradientBoosting", "MLP"]
    assert rest.best_params == first.best_params
    key = lambda df: sorted((r.model, r.row_id, r.y_pred) for r in df.collect())
    assert key(rest.predictions.filter("model = 'RandomForest'")) == key(first.predictions.filter("model = 'RandomForest'"))


def test_splits_are_not_copied(spark, wide):
    """Preparing five splits writes nothing."""
    dealt = materialize(nested_cv.stratified_kfold(wide, "row_id", "y", 5, 1, out="inner_fold"), "inner")
    before = set(os.listdir(shared_dir(spark)))
    prepared = nested_cv.prepared_splits(dealt, FEATURES, [1, 2, 3, 4, 5], nested_cv.Settings(k=3))
    assert set(os.listdir(shared_dir(spark))) == before
    assert sum(prepared[f][1].count() for f in range(1, 6)) == prepared[None][0].count() == wide.count()


def test_final_bundle_scores_batch_and_stream(spark, wide):
    s = nested_cv.Settings(k=3)
    params = {n: {k: v[0] for k, v in g.items()} for n, g in GRIDS.items()}
    bundle = finalize.fit_final(wide, FEATURES, ["F", "O", "P"], params, s)
    one = scoring.score_table(wide, bundle, ["row_id"], write_full_proba=True).collect()
    two = scoring.score_table(wide.repartition(5), bundle, ["row_id"], write_full_proba=True).collect()
    assert {r["row_id"]: r for r in one}.keys() == {r["row_id"]: r for r in two}.keys()
    other = {r["row_id"]: r for r in two}
    assert all(r["proba_top1"] == pytest.approx(other[r["row_id"]]["proba_top1"]) for r in one)
    every = scoring.score_table(wide, bundle, ["row_id"], every_model=True)
    assert "pred_Ensemble" in every.columns and "pred_ELM_pmax" in every.columns
    source, out, mark = (new_path(spark, n) for n in ("in", "out", "mark"))
    wide.write.parquet(source)
    stream = spark.readStream.schema(wide.schema).parquet(source)
    score_stream(stream, bundle, ["row_id"], out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == wide.count()


def test_stable_policy(spark, wide):
    s = nested_cv.Settings(k=3, threshold=0.99)
    params = {n: {k: v[0] for k, v in g.items()} for n, g in GRIDS.items()}
    rows = [(1, "qty_soma"), (2, "qty_soma"), (2, "disc_media"), (3, "price_media")]
    selected = spark.createDataFrame(rows, "fold int, feature string")
    bundle = finalize.fit_final(wide, FEATURES, ["F", "O", "P"], params, s, "stable_50pct", selected)
    assert bundle.pre.final_features == ["qty_soma"]
    with pytest.raises(ValueError):
        finalize.fit_final(wide, FEATURES, ["F", "O", "P"], params, s, "other")


def test_calibrated_fold(spark, wide):
    s = nested_cv.Settings(k=3, calibration="sigmoid")
    train = materialize(scoring.prepare(wide, finalize.fit_preprocessing(wide, FEATURES), ["row_id", "y"]), "t")
    model = nested_cv.fit_tuned("RandomForest", train, {"n_estimators": 3, "max_depth": 3}, s)
    assert type(model).__name__ == "SigmoidCalibrated"


def test_unknown_file_ending(spark):
    with pytest.raises(ValueError, match="Unsupported input file extension"):
        tables.read_table(spark, "/tmp/x.xlsx")


def test_length_check(spark):
    preds = spark.createDataFrame([(1, "m", 1), (1, "m", 2)], "fold int, model string, row_id int")
    path = new_path(spark, "p")
    sinks.write_folds(preds, path)
    with pytest.raises(ValueError, match="lengths differ"):
        tables.read_fold_predictions(spark, path, spark.createDataFrame([(1, 1)], "fold int, row_id int"))


def test_bundle_round_trip(spark, wide):
    pre = finalize.fit_preprocessing(wide, FEATURES)
    path = new_path(spark, "b")
    spark.createDataFrame([(pre.to_json(),)], "value string").coalesce(1).write.text(path)
    assert tables.bundle_of(tables.read_bundle(spark, path)) == pre


def test_nested_query_runs_every_outer_fold(spark, tmp_path, monkeypatch):
    """All five folds are worked off, and every order is predicted once by every model."""
    ids = range(1, 41)
    tables_ = {
        "orders": ([(i, "F") for i in ids], "o_orderkey long, o_orderstatus string"),
        "lineitem": ([(i, i % 3, 1.0 * i, 2.0 * i, 0.1, 0.2) for i in ids], "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "part": ([(i, i, 1.0) for i in range(3)], "p_partkey long, p_size int, p_retailprice double"),
    }
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    worked = []

    def finish(df, features, fold, s, fold_column, ledger, *more):
        worked.append(fold)
        names = (*MODEL_NAMES, "Ensemble")
        rows = df.filter(F.col(fold_column) == fold).select(
            F.lit(fold).alias("fold"), "row_id", F.col("y").alias("y_true"),
            F.explode(F.array(*map(F.lit, names))).alias("model"), F.array(F.lit(1.0)).alias("proba"), F.col("y").alias("y_pred"),
        )
        for n in MODEL_NAMES:
            ledger.put_choice(fold, n, {}, 1.0, [])
        ledger.put_predictions(rows)

    monkeypatch.setattr(nested_cv, "_finish_fold", finish)
    found = model_queries.nested_cv_fold(spark, str(tmp_path)).collect()
    assert sorted(worked) == [1, 2, 3, 4, 5] and {r.fold for r in found} == {1, 2, 3, 4, 5}
    assert sorted((r.row_id, r.model) for r in found) == sorted((i, m) for i in ids for m in (*MODEL_NAMES, "Ensemble"))


def test_outer_folds_share_dealing_and_preprocessing(spark, wide, monkeypatch):
    """One deal and one fit of the preprocessing serve all outer folds, and both are those of each fold alone."""
    s = nested_cv.Settings(k=3, outer_splits=3, inner_splits=2, grids=GRIDS, threshold=0.8)
    calls, given = [], {}

    def counted(name):
        real = getattr(nested_cv, name)
        monkeypatch.setattr(nested_cv, name, lambda *a, **k: calls.append(name) or real(*a, **k))

    counted("stratified_kfold"), counted("fit_preprocessing_splits")
    monkeypatch.setattr(nested_cv, "run_outer_fold", lambda df, features, fold, s, ledger, inner: given.update({fold: (df.collect(), df.columns, inner)}))
    nested_cv.run_nested_cv(wide, FEATURES, s)
    assert sorted(calls) == ["fit_preprocessing_splits", "stratified_kfold"] and sorted(given) == [1, 2, 3]
    monkeypatch.undo()

    for fold, (rows, columns, inner) in given.items():
        dealt = spark.createDataFrame([tuple(r) for r in rows], _schema(wide, columns))
        train = materialize(dealt.filter(F.col("fold") != fold).withColumn("inner_fold", inner.column), "train")
        alone = materialize(nested_cv.stratified_kfold(train.drop("inner_fold"), "row_id", "y", 2, 42, out="inner_fold"), "alone")
        key = lambda df: sorted((r.row_id, r.inner_fold) for r in df.select("row_id", "inner_fold").collect())
        assert key(train) == key(alone)
        one = nested_cv.fit_preprocessing_splits(alone, FEATURES, "inner_fold", [None, 1, 2], 0.8)
        assert one.keys() == inner.fitted.keys()
        for split, pre in one.items():
            other = inner.fitted[split]
            assert (pre.medians, pre.final_features) == (other.medians, other.final_features)
            assert pre.scaler_mean == pytest.approx(other.scaler_mean) and pre.scaler_scale == pytest.approx(other.scaler_scale)


def _schema(wide, columns):
    known = {**dict(wide.dtypes), "_rank": "long", "fold": "int"}
    return ", ".join(f"{c} {known[c]}" for c in columns)
