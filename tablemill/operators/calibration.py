"""Probability calibration, one-vs-rest, averaged over held-out folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import mean_of_arrays, normalised
from tablemill.operators.models import Classifier
from tablemill.session import materialize


def platt_parameters(scores: DataFrame, max_iter: int = 100, tol: float = 1e-8) -> dict[tuple[int, int], tuple[float, float]]:
    """Slope and offset of P = 1 / (1 + exp(a s + b)) per (fold, class).

    ``scores``: fold, class, score, pos, n (rows counted per distinct score). All pairs take
    one Newton step per pass, so the number of passes does not grow with folds or classes.
    """
    groups = {
        (r["fold"], r["class"]): (r["pos"], r["n"] - r["pos"])
        for r in scores.groupBy("fold", "class").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
    }
    params = {g: (0.0, float(np.log((neg + 1.0) / (pos + 1.0)))) for g, (pos, neg) in groups.items()}
    loss = {g: float("inf") for g in groups}
    step = {g: (0.0, 0.0) for g in groups}
    active = set(groups)
    for _ in range(max_iter):
        if not active:
            break
        totals = _newton_sums(scores, params, groups, active)
        for g in list(active):
            t = totals[g]
            if t["loss"] > loss[g] + 1e-10 * abs(loss[g]):
                # the last step went too far: halve it and look again
                half = (step[g][0] / 2, step[g][1] / 2)
                if max(abs(half[0]), abs(half[1])) < tol:
                    active.discard(g)
                    continue
                params[g] = (params[g][0] - half[0], params[g][1] - half[1])
                step[g] = half
                continue
            loss[g] = t["loss"]
            h = np.array([[t["haa"] + 1e-12, t["hab"]], [t["hab"], t["hbb"] + 1e-12]])
            grad = np.array([t["ga"], t["gb"]])
            move = -np.linalg.solve(h, grad)
            if np.abs(grad).max() < 1e-9 * max(1.0, sum(groups[g])) or np.abs(move).max() < tol:
                active.discard(g)
                continue
            step[g] = (float(move[0]), float(move[1]))
            params[g] = (params[g][0] + step[g][0], params[g][1] + step[g][1])
    return params


def _newton_sums(scores: DataFrame, params: dict, groups: dict, active: set) -> dict:
    rows = [
        (f, c, *params[f, c], (groups[f, c][0] + 1.0) / (groups[f, c][0] + 2.0), 1.0 / (groups[f, c][1] + 2.0))
        for f, c in active
    ]
    # a table rather than literals: the plan, and its compiled code, stay the same per pass
    table = scores.sparkSession.createDataFrame(rows, "fold int, class int, a double, b double, hi double, lo double")
    keyed = scores.join(table, ["fold", "class"])
    z = F.col("a") * F.col("score") + F.col("b")
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    target = pos * F.col("hi") + (n - pos) * F.col("lo")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    # -log p = softplus(z); -log(1 - p) = softplus(-z)
    softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    loss = target * softplus + (n - target) * (softplus - z)
    slope = target - n * p
    bend = n * p * (F.lit(1.0) - p)
    rows = (
        keyed.groupBy("fold", "class")
        .agg(
            F.sum(loss).alias("loss"),
            F.sum(slope * F.col("score")).alias("ga"),
            F.sum(slope).alias("gb"),
            F.sum(bend * F.col("score") * F.col("score")).alias("haa"),
            F.sum(bend * F.col("score")).alias("hab"),
            F.sum(bend).alias("hbb"),
        )
        .collect()
    )
    return {(r["fold"], r["class"]): r for r in rows}


def sigmoid_of(score: Column, a: float, b: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * score + F.lit(b)))


@dataclass
class SigmoidCalibrated(Classifier):
    """Mean over folds of (model of that fold, sigmoid per class), normalised."""

    folds: list[tuple[Classifier, dict[int, tuple[float, float]]]] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        scored = df
        for i, (model, curves) in enumerate(self.folds):
            scored = model.score(scored, f"_u{i}")
            p = F.col(f"_u{i}")
            parts = [
                sigmoid_of(F.get(p, F.lit(c)), *curves[c]) if c in curves else F.lit(0.0)
                for c in range(self.k)
            ]
            scored = scored.withColumn(f"_c{i}", normalised(F.array(*parts)))
        n = len(self.folds)
        return scored.withColumn(out, mean_of_arrays([F.col(f"_c{i}") for i in range(n)])).drop(
            *[f"_{s}{i}" for s in "uc" for i in range(n)]
        )


@dataclass
class Curve:
    """A rising line through (score, value) points, level beyond its ends."""

    scores: np.ndarray
    values: np.ndarray

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.scores, self.values)


class _Pool:
    """Neighbouring blocks [lowest score, highest score, positives, rows] with rising shares."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []

    def add(self, low: float, high: float, pos: float, n: float) -> None:
        blocks = self.blocks
        while blocks and blocks[-1][2] * n >= pos * blocks[-1][3]:
            low, _, more, rows = blocks.pop()
            pos, n = pos + more, n + rows
        blocks.append([low, high, pos, n])


_BLOCKS = "fold int, class int, low double, high double, pos double, n double"


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each (fold, class) of a sorted partition."""
    group, pool = None, _Pool()

    def found() -> pd.DataFrame:
        return pd.DataFrame([(*group, *b) for b in pool.blocks], columns=["fold", "class", "low", "high", "pos", "n"])

    for part in batches:
        for fold, label, *block in part[["fold", "class", "low", "high", "pos", "n"]].itertuples(index=False):
            if group != (fold, label):
                if group is not None:
                    yield found()
                group, pool = (fold, label), _Pool()
            pool.add(*block)
    if group is not None:
        yield found()


def isotonic_curves(scores: DataFrame) -> dict[tuple[int, int], Curve]:
    """The rising curve of least squares per (fold, class); ``scores`` as for the sigmoids.

    All folds and classes together: ranges of (fold, class, score) pool on their own, then the
    blocks that are left of a group pool once more. Shares in strictly rising order leave at most
    some rows ** (2 / 3) blocks, mostly far fewer; only these leave the first step, and only the
    curves' ends reach the driver. Rows without a score are left out.
    """
    order = ["fold", "class", "low"]
    rows = scores.where(F.col("score").isNotNull()).select(
        F.col("fold").cast("int"), F.col("class").cast("int"), F.col("score").alias("low"), F.col("score").alias("high"),
        F.col("pos").cast("double"), F.col("n").cast("double"),
    )
    pieces = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInPandas(_pooled, _BLOCKS)
    whole = first.repartition(pieces, "fold", "class").sortWithinPartitions(*order).mapInPandas(_pooled, _BLOCKS)
    points: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for r in whole.orderBy(*order).collect():
        own = points.setdefault((r["fold"], r["class"]), [])
        own += [(end, r["pos"] / r["n"]) for end in dict.fromkeys((r["low"], r["high"]))]
    return {g: Curve(*map(np.array, zip(*p))) for g, p in points.items()}


@dataclass
class IsotonicCalibrated(Classifier):
    """As the sigmoid form, with a rising curve per class."""

    folds: list[tuple[Classifier, dict[int, Curve]]] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        scored = df
        for i, (model, curves) in enumerate(self.folds):
            scored = model.score(scored, f"_u{i}")
            scored = scored.withColumn(f"_c{i}", _on_curves(F.col(f"_u{i}"), curves, self.k))
            scored = scored.withColumn(f"_c{i}", normalised(F.col(f"_c{i}")))
        n = len(self.folds)
        return scored.withColumn(out, mean_of_arrays([F.col(f"_c{i}") for i in range(n)])).drop(
            *[f"_{s}{i}" for s in "uc" for i in range(n)]
        )


def _on_curves(proba: Column, curves: dict[int, Curve], k: int) -> Column:
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), dtype=object)
        there = values.notna().to_numpy()
        if there.any():
            p = np.stack(values[there].to_numpy()).astype(float)
            moved = np.column_stack([curves[c].at(p[:, c]) if c in curves else np.zeros(len(p)) for c in range(k)])
            out[there] = pd.Series(list(moved), index=out.index[there])
        return out

    return F.pandas_udf(run, "array<double>")(proba)


def calibrate(
    df: DataFrame,
    fit: Callable[[DataFrame], Classifier],
    label: str,
    k: int,
    fold: str,
    n_folds: int,
    method: str = "sigmoid",
) -> Classifier:
    """Refit on each fold's complement, fit curves on the held-out rows, average the folds.

    ``fold`` holds stratified fold numbers 1..n_folds.
    """
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method {method!r}")
    models = []
    counted = None
    for f in range(1, n_folds + 1):
        model = fit(df.filter(F.col(fold) != f))
        models.append(model)
        part = _score_counts(model, df.filter(F.col(fold) == f), label, k, f)
        counted = part if counted is None else counted.unionByName(part)
    counted = materialize(counted, "calibration")
    if method == "sigmoid":
        curves = platt_parameters(counted)
        folds = [
            (m, {c: ab for (g, c), ab in curves.items() if g == f}) for f, m in enumerate(models, start=1)
        ]
        return SigmoidCalibrated(k, "", {}, folds)
    rising = isotonic_curves(counted)
    folds = [(m, {c: v for (g, c), v in rising.items() if g == f}) for f, m in enumerate(models, start=1)]
    return IsotonicCalibrated(k, "", {}, folds)


def _score_counts(model: Classifier, rows: DataFrame, label: str, k: int, fold: int) -> DataFrame:
    per_class = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda c: F.struct(
            c.alias("class"),
            F.get(F.col("_p"), c).alias("score"),
            (F.col(label) == c).cast("long").alias("pos"),
        ),
    )
    return (
        model.score(rows, "_p")
        .select(F.inline(per_class))
        .groupBy("class", "score")
        .agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("fold", F.lit(fold))
    )


def can_calibrate(min_class_count: int, n_folds: int) -> bool:
    return min_class_count >= n_folds
