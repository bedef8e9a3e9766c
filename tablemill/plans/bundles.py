"""Finished training runs as files: preprocessing, class names and all models.

A store holds numbered versions side by side. Each version is a folder of its own: MLlib
models through their writers, isotonic curves with a row per point, random layers as a parquet table with a
row per hidden unit, networks with a row per unit, boosted trees with a row per node. The manifest, a row that says how the parts fit together, is appended
last and alone makes a version visible, so a run that ends half way leaves nothing that
could be read. All paths go through Spark, hence to any store its readers know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict
from itertools import islice
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.boosting import Boosted, Tree
from tablemill.operators.calibration import Curve, IsotonicCalibrated, SigmoidCalibrated
from tablemill.operators.elm import ElmModel, Layer
from tablemill.operators.models import (
    BoostingClassifier,
    Classifier,
    ElmClassifier,
    EnsembleClassifier,
    NetworkClassifier,
    VectorClassifier,
)
from tablemill.operators.network import Network
from tablemill.operators.prep import Preprocessing
from tablemill.plans.scoring import Bundle

TREES = "round int, score int, node int, feature int, threshold double, left int, right int, value double"
MANIFEST = "version long, folder string, manifest string"

_BUILT_IN = {
    c.__name__: c
    for c in (
        RandomForestClassificationModel,
        MultilayerPerceptronClassificationModel,
            DecisionTreeRegressionModel,
    )
}


def _save_built_in(model: Any, path: str) -> dict:
    model.write().save(path)
    return {"class": type(model).__name__, "path": path.rsplit("/", 1)[-1]}


def _load_built_in(entry: dict, folder: str) -> Any:
    return _BUILT_IN[entry["class"]].load(f"{folder}/{entry['path']}")


class _Parts:
    """Names the parts of one version and writes them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.n = spark, folder, 0

    def path(self, stem: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{stem}"

    def built_in(self, model: Any) -> dict:
        return _save_built_in(model, self.path(type(model).__name__))

    def layer(self, model: ElmModel) -> dict:
        path = self.path("layer")
        rows = [
            (i, w.tolist(), float(b), beta.tolist())
            for i, (w, b, beta) in enumerate(zip(model.layer.weights, model.layer.bias, model.beta))
        ]
        schema = "unit int, weights array<double>, bias double, beta array<double>"
        self.spark.createDataFrame(rows, schema).write.parquet(path)
        return {"activation": model.layer.activation, "units": model.layer.units, "path": path.rsplit("/", 1)[-1]}

    def network(self, model: Network) -> dict:
        path = self.path("network")
        rows = [
            (layer, unit, w[:, unit].tolist(), float(b[unit]))
            for layer, (w, b) in enumerate(zip(model.weights, model.biases))
            for unit in range(len(b))
        ]
        self.spark.createDataFrame(rows, "layer int, unit int, weights array<double>, bias double").write.parquet(path)
        return {"activation": model.activation, "sizes": [len(b) for b in model.biases], "path": path.rsplit("/", 1)[-1]}

    def curve(self, curve: Curve) -> dict:
        path = self.path("curve")
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(curve.scores, curve.values))]
        self.spark.createDataFrame(rows, "point int, score double, value double").write.parquet(path)
        return {"points": len(rows), "path": path.rsplit("/", 1)[-1]}

    def trees(self, model: Boosted) -> dict:
        path = self.path("trees")
        rows = [
            (i, j, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]))
            for i, trees in enumerate(model.rounds)
            for j, t in enumerate(trees)
            for n in range(len(t.feature))
        ]
        self.spark.createDataFrame(rows, TREES).write.parquet(path)
        sizes = [[len(t.feature) for t in trees] for trees in model.rounds]
        return {"classes": model.classes, "start": model.start, "losses": model.losses, "sizes": sizes, "path": path.rsplit("/", 1)[-1]}

    def model(self, model: Classifier) -> dict:
        """Description of a model; what doesn't fit into text is written beside it."""
        if not isinstance(model, Classifier):
            raise TypeError(f"no stored form for {type(model).__name__}")
        about = {"kind": type(model).__name__, "k": model.k, "features": model.features, "params": model.params}
        if isinstance(model, VectorClassifier):
            about["model"] = self.built_in(model.model)
        elif isinstance(model, BoostingClassifier):
            about["model"] = self.trees(model.model)
        elif isinstance(model, ElmClassifier):
            about["model"] = self.layer(model.model)
        elif isinstance(model, NetworkClassifier):
            about["model"] = self.network(model.model)
        elif isinstance(model, SigmoidCalibrated):
            about["folds"] = [[self.model(m), [[c, *ab] for c, ab in sorted(curves.items())]] for m, curves in model.folds]
        elif isinstance(model, IsotonicCalibrated):
            about["folds"] = [[self.model(m), [[c, self.curve(v)] for c, v in sorted(curves.items())]] for m, curves in model.folds]
        elif isinstance(model, EnsembleClassifier):
            about["members"] = [self.model(m) for m in model.members]
        else:
            raise TypeError(f"no stored form for {type(model).__name__}")
        return about


def _layer_of(spark: SparkSession, about: dict, folder: str) -> ElmModel:
    rows = spark.read.parquet(f"{folder}/{about['path']}").orderBy("unit").collect()
    if len(rows) != about["units"]:
        raise ValueError(f"{len(rows)} hidden units for {about['units']} in {about['path']}")
    layer = Layer(
        about["units"], about["activation"], np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows])
    )
    return ElmModel(layer, np.array([r["beta"] for r in rows]))


def _network_of(spark: SparkSession, about: dict, folder: str) -> Network:
    rows = spark.read.parquet(f"{folder}/{about['path']}").orderBy("layer", "unit").collect()
    if len(rows) != sum(about["sizes"]):
        raise ValueError(f"{len(rows)} units for {sum(about['sizes'])} in {about['path']}")
    layers = [[r for r in rows if r["layer"] == i] for i in range(len(about["sizes"]))]
    return Network(
        about["activation"],
        [np.array([r["weights"] for r in layer]).T for layer in layers],
        [np.array([r["bias"] for r in layer]) for layer in layers],
    )


def _curve_of(spark: SparkSession, about: dict, folder: str) -> Curve:
    rows = spark.read.parquet(f"{folder}/{about['path']}").orderBy("point").collect()
    if len(rows) != about["points"]:
        raise ValueError(f"{len(rows)} points for {about['points']} in {about['path']}")
    return Curve(np.array([r["score"] for r in rows]), np.array([r["value"] for r in rows]))


def _trees_of(spark: SparkSession, about: dict, folder: str) -> Boosted:
    rows = spark.read.schema(TREES).parquet(f"{folder}/{about['path']}").orderBy("round", "score", "node").collect()
    if len(rows) != sum(map(sum, about["sizes"])):
        raise ValueError(f"{len(rows)} nodes for {sum(map(sum, about['sizes']))} in {about['path']}")
    left = iter(rows)

    def tree(size: int) -> Tree:
        nodes = list(islice(left, size))
        return Tree(*[np.array([n[c] for n in nodes]) for c in ("feature", "threshold", "left", "right", "value")])

    return Boosted(about["classes"], about["start"], [[tree(n) for n in sizes] for sizes in about["sizes"]], about["losses"])


def _model_of(spark: SparkSession, about: dict, folder: str) -> Classifier:
    base = (about["k"], about["features"], about["params"])
    again: Callable[[dict], Classifier] = lambda a: _model_of(spark, a, folder)
    kind = about["kind"]
    if kind == "VectorClassifier":
        return VectorClassifier(*base, _load_built_in(about["model"], folder))
    if kind == "BoostingClassifier":
        return BoostingClassifier(*base, _trees_of(spark, about["model"], folder))
    if kind == "ElmClassifier":
        return ElmClassifier(*base, _layer_of(spark, about["model"], folder))
    if kind == "NetworkClassifier":
        return NetworkClassifier(*base, _network_of(spark, about["model"], folder))
    if kind == "SigmoidCalibrated":
        return SigmoidCalibrated(*base, [(again(m), {c: (a, b) for c, a, b in curves}) for m, curves in about["folds"]])
    if kind == "IsotonicCalibrated":
        folds = [(again(m), {c: _curve_of(spark, v, folder) for c, v in curves}) for m, curves in about["folds"]]
        return IsotonicCalibrated(*base, folds)
    if kind == "EnsembleClassifier":
        return EnsembleClassifier(*base, [again(m) for m in about["members"]])
    raise ValueError(f"unknown kind of model {kind!r}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The finished versions of a store: version, folder, manifest; none where there is no store."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> int:
    """Add the bundle to the store at ``path``; returns its version, 1 for the first.

    Of two runs that save at once both stay, and the one named last by folder is current.
    """
    root = path.rstrip("/")
    version = (versions(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"version-{version:05d}-{uuid.uuid4().hex[:12]}"
    parts = _Parts(spark, f"{root}/{folder}")
    manifest = {
        "preprocessing": asdict(bundle.pre),
        "classes": bundle.classes,
        "models": {name: parts.model(m) for name, m in bundle.models.items()},
    }
    row = [(version, folder, json.dumps(manifest, ensure_ascii=False))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")
    return version


def load_bundle(spark: SparkSession, path: str, version: int | None = None) -> Bundle:
    """The newest finished version of a store, or the one asked for."""
    root = path.rstrip("/")
    found = versions(spark, root)
    if version is not None:
        found = found.filter(F.col("version") == version)
    row = found.orderBy(F.desc("version"), F.desc("folder")).first()
    if row is None:
        raise FileNotFoundError(f"no finished bundle{'' if version is None else f' of version {version}'} in {path}")
    manifest = json.loads(row["manifest"])
    folder = f"{root}/{row['folder']}"
    models = {name: _model_of(spark, about, folder) for name, about in manifest["models"].items()}
    return Bundle(Preprocessing(**manifest["preprocessing"]), manifest["classes"], models)
