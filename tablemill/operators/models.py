"""Classifiers behind one interface: ``score`` adds ``proba`` (array of k doubles)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import argmax_index, mean_of_arrays, one_hot, padded
from tablemill.operators.boosting import Boosted, fit_boosted
from tablemill.operators.elm import ElmModel, fit_elm
from tablemill.operators.network import Network, fit_network

MODEL_NAMES = ("RandomForest", "GradientBoosting", "MLP", "ELM")
ENSEMBLE = "Ensemble"
# Models that read scaled features.
SCALED = ("MLP", "ELM")
VECTOR = "_vector"


@dataclass
class Classifier:
    """A fitted model; subclasses say how rows get probabilities."""

    k: int
    features: str
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        scored = self.score(df, "_proba")
        return scored.withColumn(out, argmax_index(F.col("_proba"))).drop("_proba")


@dataclass
class VectorClassifier(Classifier):
    """A built-in model with a probability vector."""

    model: Any = None

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        model = self.model.copy()
        model.setFeaturesCol(VECTOR).setProbabilityCol("_vector_p").setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(df.withColumn(VECTOR, array_to_vector(F.col(self.features))))
        return scored.withColumn(out, padded(vector_to_array("_vector_p"), self.k)).drop("_vector_p", VECTOR)


@dataclass
class BoostingClassifier(Classifier):
    """Boosted trees under one softmax over all classes."""

    model: Boosted | None = None

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        return df.withColumn(out, self.model.probabilities(F.col(self.features), self.k))


@dataclass
class ElmClassifier(Classifier):
    """Labels only: the chosen class gets probability 1."""

    model: ElmModel | None = None

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        scored = df.withColumn("_z", self.model.scores(F.col(self.features)))
        return scored.withColumn(out, one_hot(argmax_index(F.col("_z")), self.k)).drop("_z")


@dataclass
class NetworkClassifier(Classifier):
    """A network trained here: activations and a penalty that the built-in one doesn't have."""

    model: Network | None = None

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        return df.withColumn(out, self.model.probabilities(F.col(self.features)))


@dataclass
class EnsembleClassifier(Classifier):
    """Mean of the member probabilities."""

    members: list[Classifier] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        scored = df
        names = [f"_m{i}" for i in range(len(self.members))]
        for name, member in zip(names, self.members):
            scored = member.score(scored, name)
        return scored.withColumn(out, mean_of_arrays([F.col(n) for n in names])).drop(*names)


def _only(params: dict, allowed: dict[str, str], model: str) -> dict:
    unknown = [p for p in params if p not in allowed]
    if unknown:
        raise ValueError(f"{model} cannot express {unknown}; supported: {sorted(allowed)}")
    return {allowed[p]: v for p, v in params.items()}


def _training(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(
        array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label")
    )


def fit_forest(df: DataFrame, features: str, label: str, k: int, params: dict | None = None, seed: int = 42) -> Classifier:
    params = dict(params or {})
    options = _only(
        params,
        {
            "n_estimators": "numTrees",
            "max_depth": "maxDepth",
            "criterion": "impurity",
            "max_features": "featureSubsetStrategy",
        },
        "RandomForest",
    )
    if options.get("impurity") == "log_loss":
        options["impurity"] = "entropy"
    model = RandomForestClassifier(seed=seed, **options).fit(_training(df, features, label))
    return VectorClassifier(k, features, params, model)


def fit_boosting(df: DataFrame, features: str, label: str, k: int, params: dict | None = None, seed: int = 42) -> Classifier:
    params = dict(params or {})
    options = _only(
        params,
        {
            "n_estimators": "n_estimators",
            "max_depth": "maxDepth",
            "max_features": "featureSubsetStrategy",
            "learning_rate": "learning_rate",
            "subsample": "subsamplingRate",
            "min_samples_leaf": "minInstancesPerNode",
            "loss": "loss",
            "criterion": "criterion",
        },
        "GradientBoosting",
    )
    if options.pop("loss", "log_loss") != "log_loss":
        raise ValueError("GradientBoosting supports loss='log_loss' only")
    if options.pop("criterion", "squared_error") != "squared_error":
        raise ValueError("GradientBoosting supports criterion='squared_error' only")
    options = {"maxDepth": 3, "featureSubsetStrategy": "all", **options}
    return BoostingClassifier(k, features, params, fit_boosted(df, features, label, seed=seed, **options))


def fit_mlp(df: DataFrame, features: str, label: str, k: int, params: dict | None = None, seed: int = 42) -> Classifier:
    """The built-in network for logistic units without a penalty, else :func:`fit_network`."""
    params = dict(params or {})
    if params.get("activation", "logistic") != "logistic" or "alpha" in params:
        known = ("hidden_layer_sizes", "activation", "alpha", "max_iter", "tol")
        if params.get("solver", "lbfgs") != "lbfgs":
            raise ValueError("MLP supports solver 'lbfgs' only with a penalty or other activations")
        chosen = _only({p: v for p, v in params.items() if p != "solver"}, {p: p for p in known}, "MLP")
        net = fit_network(df, features, label, k, seed=seed, **{"activation": "logistic", "alpha": 0.0, **chosen})
        return NetworkClassifier(k, features, params, net)
    options = _only(
        params,
        {
            "hidden_layer_sizes": "layers",
            "max_iter": "maxIter",
            "solver": "solver",
            "activation": "activation",
            "learning_rate_init": "stepSize",
        },
        "MLP",
    )
    options.pop("activation", None)
    solvers = {"lbfgs": "l-bfgs", "sgd": "gd"}
    if options.get("solver", "lbfgs") not in solvers:
        raise ValueError("MLP supports solver 'lbfgs' or 'sgd' only")
    options["solver"] = solvers[options.get("solver", "lbfgs")]
    rows = _training(df, features, label)
    width = len(df.select(features).first()[0])
    options["layers"] = [width, *options.get("layers", (36,)), k]
    model = MultilayerPerceptronClassifier(seed=seed, **options).fit(rows)
    return VectorClassifier(k, features, params, model)


def fit_elm_classifier(
    df: DataFrame, features: str, label: str, k: int, params: dict | None = None, seed: int = 42
) -> Classifier:
    params = dict(params or {})
    return ElmClassifier(k, features, params, fit_elm(df, features, label, k, seed=seed, **params))


FITTERS = {
    "RandomForest": fit_forest,
    "GradientBoosting": fit_boosting,
    "MLP": fit_mlp,
    "ELM": fit_elm_classifier,
}


def fit_model(
    name: str,
    df: DataFrame,
    label: str,
    k: int,
    params: dict | None = None,
    seed: int = 42,
    raw: str = "features",
    scaled: str = "features_scaled",
) -> Classifier:
    """Fit one of the four models on the feature array it is meant to read."""
    features = scaled if name in SCALED else raw
    return FITTERS[name](df, features, label, k, params, seed)


def ensemble_of(models: dict[str, Classifier], k: int) -> EnsembleClassifier:
    return EnsembleClassifier(k, "", {}, [models[n] for n in MODEL_NAMES])


def ensemble_proba(forest: Column, boosting: Column, mlp: Column, elm_label: Column, k: int) -> Column:
    """Mean of three probability arrays and the one-hot label of the fourth model."""
    return mean_of_arrays([forest, boosting, mlp, one_hot(elm_label, k)])
