"""Feed-forward classifier with a choice of activation and an L2 penalty.

The loss and its slope are sums over rows: every partition adds up its own, the sums meet in
a bounded number of pieces and the driver takes one L-BFGS step from them. The driver holds
the weights, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import materialize

PIECES = 64
"""Sums that reach the driver at most."""
MEMORY = 10
"""Steps that the curvature is estimated from."""

# value from the weighted input, slope from the value
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "identity": (lambda z: z, np.ones_like),
    "logistic": (lambda z: 0.5 * (1.0 + np.tanh(0.5 * z)), lambda h: h * (1.0 - h)),
    "tanh": (np.tanh, lambda h: 1.0 - h * h),
    "relu": (lambda z: np.maximum(z, 0.0), lambda h: (h > 0).astype(float)),
}


@dataclass(frozen=True)
class Network:
    """Weights (inputs x outputs) and biases of each layer; the last one feeds a softmax."""

    activation: str
    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def probabilities(self, features: Column) -> Column:
        """Array column with one probability per class; NULL features give NULL."""
        net = self

        @F.pandas_udf("array<double>")
        def run(values: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(values), index=values.index, dtype=object)
            there = values.notna().to_numpy()
            if there.any():
                x = np.stack(values[there].to_numpy()).astype(float)
                out[there] = pd.Series(list(forward(x, net)[-1]), index=values.index[there])
            return out

        return run(features)


def forward(x: np.ndarray, net: Network) -> list[np.ndarray]:
    """Outputs of every layer, the input first and the class probabilities last."""
    act, _ = ACTIVATIONS[net.activation]
    outs = [x]
    for w, b in zip(net.weights[:-1], net.biases[:-1]):
        outs.append(act(outs[-1] @ w + b))
    z = outs[-1] @ net.weights[-1] + net.biases[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return [*outs, e / e.sum(axis=1, keepdims=True)]


def loss_and_slope(x: np.ndarray, y: np.ndarray, net: Network) -> tuple[float, np.ndarray]:
    """Cross-entropy summed over the rows and its derivatives by all weights, in :func:`flat` order."""
    _, slope = ACTIVATIONS[net.activation]
    outs = forward(x, net)
    loss = -float(np.log(np.maximum(outs[-1][np.arange(len(y)), y], 1e-300)).sum())
    back = outs[-1].copy()
    back[np.arange(len(y)), y] -= 1.0
    ws, bs = [], []
    for i in range(len(net.weights) - 1, -1, -1):
        ws.append(outs[i].T @ back)
        bs.append(back.sum(axis=0))
        if i:
            back = (back @ net.weights[i].T) * slope(outs[i])
    return loss, flat(Network(net.activation, ws[::-1], bs[::-1]))


def flat(net: Network) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in zip(net.weights, net.biases) for a in pair])


def shaped(theta: np.ndarray, sizes: list[int], activation: str) -> Network:
    weights, biases, at = [], [], 0
    for a, b in zip(sizes, sizes[1:]):
        weights.append(theta[at : at + a * b].reshape(a, b))
        biases.append(theta[at + a * b : at + a * b + b])
        at += a * b + b
    return Network(activation, weights, biases)


def first_guess(sizes: list[int], activation: str, seed: int) -> Network:
    """Uniform weights whose width follows the number of inputs and outputs."""
    rng = np.random.RandomState(seed)
    weights, biases = [], []
    for a, b in zip(sizes, sizes[1:]):
        reach = np.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
        weights.append(rng.uniform(-reach, reach, (a, b)))
        biases.append(rng.uniform(-reach, reach, b))
    return Network(activation, weights, biases)


def summed(rows: DataFrame, net: Network) -> tuple[int, float, np.ndarray]:
    """(rows, loss, slope) over ``rows`` of (x, y)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(float)
                loss, slope = loss_and_slope(x, batch["y"].to_numpy(dtype=int), net)
                part = np.concatenate([[len(batch), loss], slope])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"values": [total]})

    def add(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"values": [np.sum(np.stack(part["values"].to_numpy()), axis=0)]})

    sums = rows.mapInPandas(partial, "values array<double>")
    piece = F.pmod(F.spark_partition_id(), F.lit(PIECES)).alias("piece")
    found = sums.select(piece, "values").groupBy("piece").applyInPandas(add, "values array<double>").collect()
    if not found:
        raise ValueError("no rows with a label and features to learn from")
    total = np.sum([r["values"] for r in found], axis=0)
    return round(total[0]), float(total[1]), total[2:]


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, bent by the curvature seen in the ``past`` (step, change of slope)."""
    q, shares = slope.copy(), []
    for s, y in reversed(past):
        share = (s @ q) / (s @ y)
        q -= share * y
        shares.append(share)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), share in zip(past, reversed(shares)):
        q += (share - (y @ q) / (s @ y)) * s
    return -q


def fit_network(
    df: DataFrame,
    features: str,
    label: str,
    k: int,
    hidden_layer_sizes: tuple[int, ...] = (36,),
    activation: str = "relu",
    alpha: float = 0.0001,
    max_iter: int = 200,
    tol: float = 1e-4,
    seed: int = 42,
) -> Network:
    """Least mean cross-entropy plus ``alpha`` / 2n times the squared weights, biases left out.

    Rows without a label or features are left out. Ends after ``max_iter`` steps, when no
    derivative is above ``tol``, or when no shorter step lowers the loss. No rows: an error.
    """
    if activation not in ACTIVATIONS:
        raise ValueError(f"MLP has no activation {activation!r}; there are {sorted(ACTIVATIONS)}")
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y")).dropna()
    rows = materialize(rows, "network")
    first = rows.first()
    if first is None:
        raise ValueError("no rows with a label and features to learn from")
    sizes = [len(first["x"]), *hidden_layer_sizes, k]
    theta = flat(first_guess(sizes, activation, seed))
    penalised = flat(Network(activation, [np.ones((a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]]))

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, slope = summed(rows, shaped(point, sizes, activation))
        own = penalised * point
        return (loss + 0.5 * alpha * float(own @ own)) / n, (slope + alpha * own) / n

    loss, slope = at(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(slope).max() <= tol:
            break
        way = _direction(slope, past)
        length = 1.0 if past else min(1.0, 1.0 / float(np.linalg.norm(slope)))
        fall = float(slope @ way)
        for _ in range(20):
            new_loss, new_slope = at(theta + length * way)
            if new_loss <= loss + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        step, change = length * way, new_slope - slope
        theta, loss, slope = theta + step, new_loss, new_slope
        if step @ change > 1e-12 * float(change @ change):
            past = [*past[-(MEMORY - 1) :], (step, change)]
    return shaped(theta, sizes, activation)
