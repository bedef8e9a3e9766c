"""Random-hidden-layer model of labels or values: fixed random layer, output weights by least squares.

Training needs only H'H and H'Y, which are sums over rows. Each partition builds its
matrices block by block, the sums are added up in two levels, and the small systems are
solved per hidden layer. One pass serves any number of layers, solvers and penalties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import lists_of_matrix, matrix_of_lists

# Partial sums are added in groups of this many first.
FAN_IN = 64


@dataclass(frozen=True)
class Layer:
    """A hidden layer: random weights, bias and activation."""

    units: int
    activation: str
    weights: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class ElmModel:
    layer: Layer
    beta: np.ndarray

    def scores(self, features: Column) -> Column:
        """Output of the network as an array column, one entry per class."""
        layer, beta = self.layer, self.beta

        @F.arrow_udf("array<double>")
        def run(values: pa.Array) -> pa.Array:
            if len(values) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return lists_of_matrix(hidden(matrix_of_lists(values), layer) @ beta)

        return run(features)

    def values(self, features: Column) -> Column:
        """Output of a model of values (``fit_elm`` without classes), one number per row."""
        return F.get(self.scores(features), F.lit(0))


def elm_score(df: DataFrame, truth: str, predicted: str, by: list[str], kinds: tuple[str, ...] = ("clf", "reg")) -> DataFrame:
    """Per group: ``accuracy`` for labels ("clf"), ``rmse`` for values ("reg").

    Rows without a truth are left out. A row without a prediction is wrong for labels and
    left out for values. A group without rows to judge has NULL.
    """
    gap = (F.col(predicted) - F.col(truth)).cast("double")
    hit = F.when(F.col(truth).isNotNull(), F.col(predicted).eqNullSafe(F.col(truth)).cast("double"))
    made = {"clf": F.avg(hit).alias("accuracy"), "reg": F.sqrt(F.avg(gap * gap)).alias("rmse")}
    return df.groupBy(*by).agg(*[made[kind] for kind in kinds])


def draw_layer(units: int, activation: str, random_type: str, n_features: int, seed: int = 42) -> Layer:
    """Weights first, then bias, from one seeded generator."""
    rng = np.random.RandomState(seed)
    if random_type == "normal":
        weights = rng.normal(0.0, 0.5, size=(units, n_features))
        bias = rng.normal(0.0, 0.5, size=(units, 1))
    elif random_type == "uniform":
        weights = rng.uniform(0.0, 1.0, size=(units, n_features))
        bias = rng.uniform(0.0, 1.0, size=(units, 1))
    else:
        raise ValueError(f"unknown random_type {random_type!r}")
    return Layer(units, activation, weights, bias[:, 0])


def hidden(x: np.ndarray, layer: Layer) -> np.ndarray:
    """Hidden outputs, one row per input row."""
    z = x @ layer.weights.T + layer.bias
    if layer.activation == "sigmoid":
        return 0.5 * (1.0 + np.tanh(0.5 * z))
    if layer.activation == "relu":
        return np.maximum(z, 0.0)
    if layer.activation == "sin":
        return np.sin(z)
    if layer.activation == "tanh":
        return np.tanh(z)
    if layer.activation == "leaky_relu":
        return np.where(z > 0, z, 0.1 * z)
    raise ValueError(f"unknown activation {layer.activation!r}")


def solve(gram: np.ndarray, target: np.ndarray, solver: str, c: float) -> np.ndarray:
    """Output weights from H'H and H'Y.

    ``no_re`` is the minimum-norm least-squares solution and ignores C; ``solution1`` and
    ``solution2`` are the same ridge system with penalty 1/C.
    """
    if solver == "no_re":
        values, vectors = np.linalg.eigh(gram)
        cut = values.max(initial=0.0) * len(values) * np.finfo(float).eps
        inverse = np.where(values > cut, 1.0 / np.where(values > cut, values, 1.0), 0.0)
        return vectors @ (inverse[:, None] * (vectors.T @ target))
    if solver in ("solution1", "solution2"):
        if c == 0:
            raise ValueError("C must be above 0 for a penalised solution")
        return np.linalg.solve(np.eye(len(gram)) / c + gram, target)
    raise ValueError(f"unknown solver {solver!r}")


def gram_rows(df: DataFrame, layers: list[Layer], features: str, label: str, k: int | None) -> DataFrame:
    """(layer, unit, values): row ``unit`` of [H'H | H'Y] per layer, summed over ``df``.

    Y has a column per class, or without ``k`` the label itself as a number.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(layers)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix_of_lists(batch["x"]), batch["y"].to_numpy(zero_copy_only=False)
            y = y.astype(float)[:, None] if k is None else np.eye(k)[y.astype(int)]
            for i, layer in enumerate(layers):
                h = hidden(x, layer)
                part = h.T @ np.hstack([h, y])
                totals[i] = part if totals[i] is None else totals[i] + part
        for i, total in enumerate(totals):
            if total is not None:
                place = [pa.array(np.full(len(total), i, np.int32)), pa.array(np.arange(len(total), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*place, lists_of_matrix(total)], ["layer", "unit", "values"])

    def add(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(part["values"].to_numpy()), axis=0)
        return pd.DataFrame({"layer": [key[0]], "unit": [key[1]], "values": [total]})

    schema = "layer int, unit int, values array<double>"
    rows = df.select(F.col(features).alias("x"), F.col(label).alias("y")).mapInArrow(partial, schema)
    piece = F.pmod(F.spark_partition_id(), F.lit(4096))
    spread = rows.withColumn("piece", F.floor(piece / FAN_IN).cast("int"))
    first = spread.groupBy("layer", "unit", "piece").applyInPandas(add, schema)
    return first.groupBy("layer", "unit").applyInPandas(add, schema)


def solved(rows: DataFrame, layers: list[Layer], trials: list[tuple[int, str, float]]) -> DataFrame:
    """(layer, solver, c, beta): output weights of every wanted (layer, solver, c)."""
    wanted: dict[int, list[tuple[str, float]]] = {}
    for layer, solver, c in trials:
        wanted.setdefault(layer, []).append((solver, c))

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(part.sort_values("unit")["values"].to_numpy())
        units = layers[key[0]].units
        gram, target = matrix[:, :units], matrix[:, units:]
        jobs = wanted.get(key[0], [])
        betas = []
        for s, c in jobs:
            try:
                betas.append(solve(gram, target, s, c).ravel().tolist())
            except (ValueError, np.linalg.LinAlgError):
                betas.append(None)  # a failed trial, counted as such in the log
        return pd.DataFrame(
            {"layer": key[0], "solver": [s for s, _ in jobs], "c": [float(c) for _, c in jobs], "beta": betas}
        )

    return rows.groupBy("layer").applyInPandas(run, "layer int, solver string, c double, beta array<double>")


def fit_elm(
    df: DataFrame,
    features: str,
    label: str,
    k: int | None,
    hidden_units: int = 50,
    activation_function: str = "relu",
    C: float = 1.0,
    random_type: str = "normal",
    solver: str = "no_re",
    seed: int = 42,
) -> ElmModel:
    """A layer drawn by the seed, then :func:`fit_layer`."""
    n_features = len(df.select(features).first()[0])
    layer = draw_layer(hidden_units, activation_function, random_type, n_features, seed)
    return fit_layer(df, features, label, k, layer, C, solver)


def fit_layer(
    df: DataFrame, features: str, label: str, k: int | None, layer: Layer, C: float = 1.0, solver: str = "no_re"
) -> ElmModel:
    """Output weights for labels 0 to ``k`` - 1, or for a label that is a number when ``k`` is None.

    Values that are NULL are left out.
    """
    if k is None:
        df = df.select(features, F.col(label).cast("double").alias(label)).dropna(subset=[label])
    row = solved(gram_rows(df, [layer], features, label, k), [layer], [(0, solver, float(C))]).first()
    if row["beta"] is None:
        raise ValueError(f"no solution for solver={solver}, C={C}")
    return ElmModel(layer, np.array(row["beta"]).reshape(layer.units, k or 1))


def grid_accuracy(
    train: DataFrame,
    valid: DataFrame,
    combos: list[dict],
    features: str,
    label: str,
    k: int,
    seed: int = 42,
) -> dict[int, float | None]:
    """Validation accuracy of every combination (numbered from 1) with two data passes.

    Combinations that name the same model are fitted once: ``no_re`` ignores C and the two
    penalised solutions agree. All layers share one pass over ``train``, and all solved
    models one pass over ``valid``.
    """
    n_features = len(train.select(features).first()[0])
    layer_of: dict[tuple, int] = {}
    model_of: dict[tuple, list[int]] = {}
    for number, p in enumerate(combos, start=1):
        shape = (int(p["hidden_units"]), p["activation_function"], p["random_type"])
        i = layer_of.setdefault(shape, len(layer_of))
        plain = p["solver"] == "no_re"
        key = (i, "no_re" if plain else "solution1", 0.0 if plain else float(p["C"]))
        model_of.setdefault(key, []).append(number)
    layers = [draw_layer(u, a, t, n_features, seed) for u, a, t in layer_of]
    rows = solved(gram_rows(train, layers, features, label, k), layers, list(model_of)).collect()
    betas = {
        (r["layer"], r["solver"], r["c"]): np.array(r["beta"]).reshape(layers[r["layer"]].units, k)
        for r in rows
        if r["beta"] is not None
    }
    keys = list(betas)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(len(keys), dtype=np.int64)
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of_lists(batch["x"])
            y = batch["y"].to_numpy(zero_copy_only=False).astype(int)
            n += len(y)
            outputs: dict[int, np.ndarray] = {}
            for j, key in enumerate(keys):
                if key[0] not in outputs:
                    outputs[key[0]] = hidden(x, layers[key[0]])
                hits[j] += int((np.argmax(outputs[key[0]] @ betas[key], axis=1) == y).sum())
        if n:
            numbers = [np.arange(len(keys), dtype=np.int32), hits, np.full(len(keys), n, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in numbers], ["model", "hits", "n"])

    partial = valid.select(F.col(features).alias("x"), F.col(label).alias("y")).mapInArrow(
        score, "model int, hits long, n long"
    )
    totals = partial.groupBy("model").agg((F.sum("hits") / F.sum("n")).alias("accuracy")).collect()
    by_key = {keys[r["model"]]: float(r["accuracy"]) for r in totals}
    return {number: by_key.get(key) for key, numbers in model_of.items() for number in numbers}
