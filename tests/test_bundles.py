"""Stored bundles: what is read again scores as what was written, and half a bundle is none."""

import pytest
from pyspark.sql import SparkSession

from tablemill.catalog.base import parted_vectors
from tablemill.operators.calibration import IsotonicCalibrated, SigmoidCalibrated, calibrate
from tablemill.operators.models import EnsembleClassifier, ensemble_of, fit_model
from tablemill.operators.prep import Preprocessing
from tablemill.operators.splitting import stratified_kfold
from tablemill.plans import bundles, scoring
from tablemill.session import materialize, new_path

SF = "/root/testdata/sf0.001"
PARAMS = {
    "RandomForest": {"n_estimators": 3, "max_depth": 4},
    "GradientBoosting": {"n_estimators": 1, "max_depth": 2},
    "MLP": {"hidden_layer_sizes": [4], "max_iter": 5},
    "ELM": {"hidden_units": 6, "activation_function": "sin", "C": 1.0, "solver": "solution2"},
}


@pytest.fixture(scope="module")
def rows(spark):
    few = parted_vectors(spark, SF).filter("y < 3")
    return materialize(stratified_kfold(few, "row_id", "y", 2, 1, out="cal_fold"), "rows")


@pytest.fixture(scope="module")
def fitted(rows):
    return {n: fit_model(n, rows, "y", 3, p) for n, p in PARAMS.items()}


def probabilities(model, df):
    return {(r.row_id, c): p for r in model.score(df).select("row_id", "proba").collect() for c, p in enumerate(r.proba)}


def empty_pre():
    return Preprocessing({"a b": 1.5, "é": -0.1}, ["c"], ["a b", "é"], ["é"], [], [0.25], [1.0])


def test_every_kind_of_model_in_another_session(spark, rows, fitted):
    def fit(part):
        return fit_model("RandomForest", part, "y", 3, PARAMS["RandomForest"])

    models = dict(fitted)
    models["sigmoid"] = calibrate(rows, fit, "y", 3, "cal_fold", 2)
    models["isotonic"] = calibrate(rows, fit, "y", 3, "cal_fold", 2, "isotonic")
    models["network"] = fit_model("MLP", rows, "y", 3, {"hidden_layer_sizes": [3, 2], "activation": "tanh", "max_iter": 2})
    models["all"] = ensemble_of(fitted, 3)
    path = new_path(spark, "store")
    assert bundles.save_bundle(spark, scoring.Bundle(empty_pre(), ["x", "y é", "z"], models), path) == 1
    other: SparkSession = spark.newSession()
    back = bundles.load_bundle(other, path)
    assert back.pre == empty_pre() and back.classes == ["x", "y é", "z"] and set(back.models) == set(models)
    assert isinstance(back.models["sigmoid"], SigmoidCalibrated) and isinstance(back.models["isotonic"], IsotonicCalibrated)
    assert isinstance(back.models["all"], EnsembleClassifier)
    stored = new_path(spark, "rows")
    rows.write.parquet(stored)
    for name, model in models.items():
        assert probabilities(back.models[name], other.read.parquet(stored)) == pytest.approx(probabilities(model, rows)), name


def test_versions_stand_side_by_side(spark, fitted):
    path = new_path(spark, "store")
    one = scoring.Bundle(empty_pre(), ["x", "y", "z"], {"ELM": fitted["ELM"]})
    two = scoring.Bundle(empty_pre(), ["u", "v", "w"], {"ELM": fitted["ELM"]})
    assert [bundles.save_bundle(spark, b, path) for b in (one, two)] == [1, 2]
    assert bundles.load_bundle(spark, path).classes == ["u", "v", "w"]
    assert bundles.load_bundle(spark, path, 1).classes == ["x", "y", "z"]
    with pytest.raises(FileNotFoundError, match="version 3"):
        bundles.load_bundle(spark, path, 3)


def test_a_run_that_ends_half_way_leaves_nothing_to_read(spark, fitted):
    path = new_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, path)
    whole = scoring.Bundle(empty_pre(), ["x", "y", "z"], {"ELM": fitted["ELM"]})
    bundles.save_bundle(spark, whole, path)
    broken = scoring.Bundle(empty_pre(), ["a", "b", "c"], {"ELM": fitted["ELM"], "odd": object()})
    with pytest.raises(TypeError):
        bundles.save_bundle(spark, broken, path)
    assert bundles.load_bundle(spark, path).classes == ["x", "y", "z"]
    assert bundles.versions(spark, path).count() == 1
