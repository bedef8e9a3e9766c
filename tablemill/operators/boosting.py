"""Boosted trees under one loss for all classes.

A round takes, for every class, what the softmax of the scores leaves of the class's indicator
and fits the built-in regression tree to it; one pass over the rows then sums what each leaf of
all these trees needs for its Newton step. With two classes one score, and one tree a round, is
enough. Rows travel with their scores and are written once a round, the table before is removed.
Trees are small (``max_depth`` bounds them), so they stay on the driver as node arrays and go to
the tasks as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import lists_of_matrix, matrix_of_lists
from tablemill.session import discard, materialize

# Trees of one round that are fitted at the same time.
PARALLEL = 4
ROWS = "x array<double>, y int, s array<double>, r array<double>"
_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


@dataclass
class Tree:
    """Nodes from the root on; a leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row of ``x`` ends in."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            lower = x[rows, self.feature[at]] <= self.threshold[at]
            below = np.where(lower, self.left[at], self.right[at])
            if np.array_equal(below, at):
                return at
            at = below


def tree_of(text: str) -> Tree:
    """A tree without values from the text form of a built-in one."""
    lines = iter(text.strip().splitlines()[1:])
    nodes: list[list[float]] = []

    def add() -> int:
        i = len(nodes)
        nodes.append([0, np.inf, i, i])
        split = _SPLIT.search(next(lines))
        if split:
            left = add()
            next(lines)  # the line of the other side
            nodes[i] = [int(split[1]), float(split[2]), left, add()]
        return i

    add()
    feature, threshold, left, right = zip(*nodes)
    whole = lambda v: np.array(v, np.int64)
    return Tree(whole(feature), np.array(threshold, float), whole(left), whole(right), np.zeros(len(nodes)))


def shares(scores: np.ndarray) -> np.ndarray:
    """Probability per class of rows of scores; one score is that of the second of two classes."""
    if scores.shape[1] == 1:
        scores = np.hstack([np.zeros_like(scores), scores])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _left_over(y: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indicator less probability and the probability, per score."""
    p = shares(scores)
    hit = np.eye(p.shape[1])[y]
    if scores.shape[1] == 1:
        p, hit = p[:, 1:], hit[:, 1:]
    return hit - p, p


@dataclass
class Boosted:
    """``classes`` that were there in training, their first scores and a list of trees a round."""

    classes: list[int]
    start: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)
    # mean log loss of the training rows before each round
    losses: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start, float), (len(x), 1))
        for trees in self.rounds:
            for j, tree in enumerate(trees):
                out[:, j] += tree.value[tree.leaves(x)]
        return out

    def probabilities(self, features: Column, k: int) -> Column:
        """Array of ``k``; a class that training didn't have gets 0. NULL features: NULL."""
        model = self

        def run(values: pa.Array) -> pa.Array:
            there = np.asarray(values.is_valid())
            if not there.any():
                return pa.nulls(len(values), pa.list_(pa.float64()))
            wide = np.zeros((int(there.sum()), k))
            if len(model.classes) == 1:
                wide[:, model.classes] = 1.0
            else:
                wide[:, model.classes] = shares(model.scores(matrix_of_lists(values.drop_null())))
            found = lists_of_matrix(wide)
            return found if there.all() else found.take(pa.array(np.cumsum(there) - 1, mask=~there))

        return F.arrow_udf(run, "array<double>")(features)


def _first_scores(counts: np.ndarray) -> list[float]:
    logs = np.log(counts / counts.sum())
    if len(counts) == 1:
        return []
    return [float(logs[1] - logs[0])] if len(counts) == 2 else logs.tolist()


def _stepped(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """Rows with the scores after these trees and what is left over then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            s = matrix_of_lists(part["s"])
            if trees:
                x = matrix_of_lists(part["x"])
                s = s + np.column_stack([t.value[t.leaves(x)] for t in trees])
            rest, _ = _left_over(part["y"].to_numpy(), s)
            yield pa.RecordBatch.from_arrays([part["x"], part["y"], lists_of_matrix(s), lists_of_matrix(rest)], ["x", "y", "s", "r"])

    return rows.mapInArrow(run, ROWS)


def leaf_sums(rows: DataFrame, trees: list[Tree]) -> tuple[dict[tuple[int, int], tuple[float, float]], float]:
    """(tree, leaf) -> (sum of what is left over, sum of p (1 - p)), and the mean log loss.

    A partition sends one row per leaf that it reaches, the driver gets one per leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = [np.zeros(len(t.feature)) for t in trees]
        down = [np.zeros(len(t.feature)) for t in trees]
        n, loss = 0, 0.0
        for part in batches:
            if not part.num_rows:
                continue
            x, s, y = matrix_of_lists(part["x"]), matrix_of_lists(part["s"]), part["y"].to_numpy()
            rest, p = _left_over(y, s)
            loss -= float(np.log(np.maximum(shares(s)[np.arange(len(y)), y], 1e-300)).sum())
            n += len(y)
            for j, t in enumerate(trees):
                at = t.leaves(x)
                up[j] += np.bincount(at, rest[:, j], len(up[j]))
                down[j] += np.bincount(at, p[:, j] * (1 - p[:, j]), len(up[j]))
        if n:
            found = [(j, int(i), up[j][i], down[j][i]) for j in range(len(trees)) for i in np.flatnonzero(down[j])]
            names = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("up", pa.float64()), ("down", pa.float64())])
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in [(-1, 0, loss, float(n)), *found]], names)

    sums = rows.mapInArrow(run, "tree int, leaf int, up double, down double")
    found = sums.groupBy("tree", "leaf").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).collect()
    by_leaf = {(r["tree"], r["leaf"]): (r["up"], r["down"]) for r in found}
    loss, n = by_leaf.pop((-1, 0))
    return by_leaf, loss / n


def fit_boosted(
    df: DataFrame,
    features: str,
    label: str,
    n_estimators: int = 20,
    learning_rate: float = 0.1,
    seed: int = 42,
    **tree_options: Any,
) -> Boosted:
    """``n_estimators`` rounds from the log shares of the classes.

    ``tree_options`` go to the built-in regression tree. Rows without a label or features are
    left out; a single class needs no round; no rows: an error.
    """
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y")).dropna()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no rows with a label and features to learn from")
    classes = sorted(counts)
    model = Boosted(classes, _first_scores(np.array([counts[c] for c in classes], float)))
    if len(classes) == 1:
        return model
    named = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int") - 1
    first = F.array(*map(F.lit, model.start))
    rows = materialize(_stepped(rows.select("x", named.alias("y"), first.alias("s")), []), "boosting")
    step = learning_rate * (1.0 if len(classes) == 2 else (len(classes) - 1) / len(classes))
    width = len(model.start)
    for i in range(n_estimators):
        now = rows

        def fit(j: int) -> Tree:
            target = now.select(array_to_vector("x").alias("features"), F.get("r", F.lit(j)).alias("label"))
            one = RandomForestRegressor(numTrees=1, bootstrap=False, seed=seed + i * width + j, **tree_options)
            return tree_of(one.fit(target).trees[0].toDebugString)

        with ThreadPool(min(PARALLEL, width)) as pool:
            trees = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(width))
        sums, loss = leaf_sums(now, trees)
        for (j, leaf), (up, down) in sums.items():
            trees[j].value[leaf] = step * up / down if down > 1e-150 else 0.0
        model.rounds.append(trees)
        model.losses.append(loss)
        if i + 1 < n_estimators:
            rows = materialize(_stepped(now, trees), "boosting")
            discard(now)
    discard(rows)
    return model
