"""Model-agnostic Shapley values by weighted least squares over coalitions."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.ranking import rank_desc
from tablemill.session import materialize

# Beyond this many features the number of coalitions has to be stated.
MOST_FEATURES = 20


def coalitions(m: int, n_samples: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows and kernel weights of the coalitions to evaluate (never empty or full).

    All of them, which gives exact values, unless ``n_samples`` states a number: then whole
    coalition sizes are taken from the outside in while they fit, and the sizes left over
    share their weight among seeded paired draws.
    """
    sizes = {s: (m - 1) / (comb(m, s) * s * (m - s)) for s in range(1, m)}
    if n_samples is None:
        if m > MOST_FEATURES:
            raise ValueError(f"{m} features: state n_samples, all coalitions are too many")
        rows, weights = [], []
        for s, w in sizes.items():
            for members in itertools.combinations(range(m), s):
                rows.append(np.isin(np.arange(m), members))
                weights.append(w)
        return np.array(rows, dtype=bool).reshape(-1, m), np.array(weights)
    budget = n_samples
    rows, weights, rest = [], [], []
    for s in sorted(sizes, key=lambda s: (min(s, m - s), s)):
        if not rest and len(rows) + comb(m, s) <= budget:
            for members in itertools.combinations(range(m), s):
                rows.append(np.isin(np.arange(m), members))
                weights.append(sizes[s])
        else:
            rest.append(s)
    if rest:
        rng = np.random.RandomState(seed)
        mass = np.array([comb(m, s) * sizes[s] for s in rest])
        counts: dict[bytes, float] = {}
        draws = max(2, budget - len(rows))
        for s in rng.choice(rest, size=draws // 2, p=mass / mass.sum()):
            picked = np.isin(np.arange(m), rng.permutation(m)[:s])
            for row in (picked, ~picked):
                counts[row.tobytes()] = counts.get(row.tobytes(), 0.0) + 1.0
        total = sum(counts.values())
        for key, n in counts.items():
            rows.append(np.frombuffer(key, dtype=bool))
            weights.append(mass.sum() * n / total)
    return np.array(rows, dtype=bool).reshape(-1, m), np.array(weights)


def projector(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix taking [v(S1).. v(Sn), v(all) - v(none)] to the m Shapley values.

    ``v(S)`` is measured from ``v(none)``. The last feature is eliminated so that values sum
    to ``v(all) - v(none)`` exactly.
    """
    n, m = masks.shape
    if m == 1:
        return np.hstack([np.zeros((1, n)), np.ones((1, 1))])
    z = masks.astype(float)
    design = z[:, :-1] - z[:, -1:]
    normal = design.T @ (weights[:, None] * design)
    left = np.linalg.pinv(normal) @ (design.T * weights)
    body = np.hstack([left, -(left @ z[:, -1:])])
    last = -body.sum(axis=0, keepdims=True)
    last[0, -1] += 1.0
    return np.vstack([body, last])


def background_points(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature rows with their count: the whole table as a weighted background."""
    return df.groupBy(*[f"`{f}`" for f in features]).agg(F.count(F.lit(1)).alias("weight"))


def kernel_shap(
    df: DataFrame,
    row_id: str,
    features: list[str],
    background: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    n_classes: int,
    n_samples: int | None = None,
    seed: int = 42,
    points_per_piece: int = 2000,
    rows_per_piece: int = 4096,
) -> DataFrame:
    """Shapley value of every (row, class, feature): columns ``row_id, class, feature, phi``.

    ``predict`` maps a matrix of feature rows to class scores and runs inside the tasks.
    ``background`` holds the features and ``weight`` and stays distributed: values are
    weighted means over its points, so every piece of rows meets every piece of points in its
    own bounded task and the parts are summed.
    """
    m = len(features)
    masks, weights = coalitions(m, n_samples, seed)
    project = projector(masks, weights)
    facts = background.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("double").alias("total")).first()
    n_points, total = facts["n"], facts["total"]
    names = [f"f{i}" for i in range(m)]
    numbers = [F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names)]
    rows = df.select(F.col(row_id).alias("id"), *numbers)
    points = background.select(*numbers, (F.col("weight") / F.lit(total)).alias("share"))
    key_type = df.schema[row_id].dataType.simpleString()
    schema = f"id {key_type}, class int, feature int, phi double"

    def explain(batch: pd.DataFrame, at: np.ndarray, shares: np.ndarray) -> pd.DataFrame:
        base = shares @ predict(at)
        x = batch[names].to_numpy(dtype=float)
        phi = np.stack([_row_values(row, at, shares, base, masks, project, predict) for row in x])
        r, f, c = np.meshgrid(range(len(x)), range(m), range(n_classes), indexing="ij")
        return pd.DataFrame(
            {
                "id": batch["id"].to_numpy()[r.ravel()],
                "class": c.ravel(),
                "feature": f.ravel(),
                "phi": phi.ravel(),
            }
        )

    n_pieces = max(1, -(-n_points // points_per_piece))
    n_blocks = max(1, -(-df.count() // rows_per_piece))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).withColumn(
        "piece", F.explode(_longs(n_pieces))
    )
    right = points.withColumn("piece", F.pmod(F.xxhash64(*names), F.lit(n_pieces))).withColumn(
        "block", F.explode(_longs(n_blocks))
    )

    def pair(batch: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if len(batch) == 0 or len(at) == 0:
            return pd.DataFrame({"id": [], "class": [], "feature": [], "phi": []})
        return explain(batch, at[names].to_numpy(dtype=float), at["share"].to_numpy(dtype=float))

    parts = left.groupBy("block", "piece").cogroup(right.groupBy("block", "piece"))
    values = parts.applyInPandas(pair, schema).groupBy("id", "class", "feature").agg(F.sum("phi").alias("phi"))
    labels = F.array(*[F.lit(f) for f in features])
    return values.select(
        F.col("id").alias(row_id), "class", F.get(labels, F.col("feature")).alias("feature"), "phi"
    )


def explain_scorer(
    df: DataFrame,
    row_id: str,
    features: list[str],
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    n_classes: int,
    n_samples: int | None = None,
    seed: int = 42,
    points_per_slice: int = 200,
    rows_per_block: int = 4096,
) -> DataFrame:
    """Shapley values of anything that scores a DataFrame: ``row_id, class, feature, phi``.

    ``score`` gets the feature columns beside others and adds ``proba`` (an array of scores),
    keeping the others, so models, pipelines and their ensemble are explained alike.
    ``background`` comes from :func:`background_points`.

    A coalition's value depends on what the row has inside it and the points have outside it.
    So each coalition scores its distinct insides with its distinct, weighted outsides, and
    rows look their values up: features of few values cost few mixed rows, and only where
    everything is distinct is every row mixed with every point. Insides come in blocks of
    about ``rows_per_block`` and outsides in slices of about ``points_per_slice``; a block and
    a slice are mixed, scored and summed in one task before anything is shuffled. Rows need
    distinct ids; pass stored tables.
    """
    m = len(features)
    masks, weights = coalitions(m, n_samples, seed)
    project = projector(masks, weights)
    quoted = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    total = background.agg(F.sum("weight").cast("double").alias("total")).first()["total"]
    points = background.select(*quoted, (F.col("weight") / F.lit(total)).alias("_share"))
    means = score(points).agg(*[F.sum(F.col("_share") * F.get("proba", F.lit(c))).alias(f"b{c}") for c in range(n_classes)]).first()
    base = np.array([means[f"b{c}"] for c in range(n_classes)])
    rows = df.select(F.col(f"`{row_id}`").alias("_id"), *quoted)
    key_type = df.schema[row_id].dataType.simpleString()
    own = score(rows).select("_id", F.col("proba").alias("_own"))
    if not len(masks):
        per_row = own.withColumn("_values", F.array().cast("array<array<double>>"))
    else:
        inside = _parts_of(rows, features, masks, key_type).withColumnRenamed("_part", "_inside")
        outside = _parts_of(points.withColumnRenamed("_share", "_id"), features, ~masks, "double")
        outside = outside.groupBy("_coalition", F.col("_part").alias("_outside")).agg(F.sum("_id").alias("_share"))
        mixed = _meeting(inside.select("_coalition", "_inside").distinct(), outside, rows_per_block, points_per_slice).select(
            "_coalition", "_inside", "_share",
            *[F.coalesce(F.get("_inside", F.lit(i)), F.get("_outside", F.lit(i))).alias(f) for i, f in enumerate(features)],
        )
        value = [F.sum(F.col("_share") * F.get("proba", F.lit(c))).alias(f"v{c}") for c in range(n_classes)]
        values = score(mixed).groupBy("_coalition", "_inside").agg(*value)
        # by row at once: what follows needs no other shuffle
        found = inside.join(values, ["_coalition", "_inside"], "left").repartition("_id")
        summed = found.groupBy("_id", "_coalition").agg(F.array(*[F.sum(f"v{c}") for c in range(n_classes)]).alias("v"))
        ordered = F.array_sort(F.collect_list(F.struct("_coalition", "v")))
        per_row = summed.groupBy("_id").agg(ordered.alias("_pairs")).join(own, "_id").select(
            "_id", "_own", F.transform("_pairs", lambda p: p["v"]).alias("_values")
        )

    def solve(batches):
        for batch in batches:
            out = []
            for i, whole, values in zip(batch["_id"], batch["_own"], batch["_values"]):
                seen = np.array([list(v) for v in values], dtype=float).reshape(len(masks), n_classes)
                phi = project @ (np.vstack([seen, np.array(whole, dtype=float)[None, :n_classes]]) - base)
                out += [(i, c, f, float(phi[k, c])) for c in range(n_classes) for k, f in enumerate(features)]
            yield pd.DataFrame(out, columns=["id", "class", "feature", "phi"])

    found = per_row.mapInPandas(solve, f"id {key_type}, class int, feature string, phi double")
    return found.withColumnRenamed("id", row_id)


def _mixed(features: list[str], masks: np.ndarray, points: np.ndarray, shares: np.ndarray, most: int = 1 << 16):
    """Each row in every coalition with every point, in batches of at most about ``most`` rows."""
    step = max(1, most // len(points))
    rows_at_once = max(1, step // max(1, len(masks)))

    def run(batches):
        for batch in batches:
            values = batch[features].to_numpy(dtype=float)
            for x in range(0, len(values), rows_at_once):
                own = values[x : x + rows_at_once]
                for a in range(0, len(masks), step):
                    some = masks[a : a + step]
                    each = len(some) * len(points)
                    mixed = np.where(some[:, None, :], own[:, None, None, :], points).reshape(-1, len(features))
                    out = pd.DataFrame(mixed, columns=features)
                    out.insert(0, "_share", np.tile(shares, len(own) * len(some)))
                    out.insert(0, "_coalition", np.tile(np.repeat(np.arange(a, a + len(some), dtype=np.int32), len(points)), len(own)))
                    out.insert(0, "_id", batch["_id"].iloc[x : x + rows_at_once].repeat(each).array)
                    yield out

    return run


def _parts_of(df: DataFrame, features: list[str], masks: np.ndarray, key_type: str) -> DataFrame:
    """(_id, _coalition, _part): each row's features inside every coalition, NULL outside it."""
    nowhere, one = np.full((1, len(features)), np.nan), np.ones(1)
    schema = f"_id {key_type}, _coalition int, _share double, " + ", ".join(f"`{f}` double" for f in features)
    held = df.mapInPandas(_mixed(features, masks, nowhere, one), schema)
    return held.select("_id", "_coalition", F.array(*[F.col(f"`{f}`") for f in features]).alias("_part"))


def _meeting(inside: DataFrame, outside: DataFrame, rows_per_block: int, points_per_slice: int) -> DataFrame:
    """Every inside beside every outside of its coalition; a task joins a block of the one with a slice of the other."""
    spark = inside.sparkSession
    inside, outside = materialize(inside, "inside"), materialize(outside, "outside")
    pieces = lambda most: F.ceil(F.count(F.lit(1)) / most)
    sizes = inside.groupBy("_coalition").agg(pieces(rows_per_block).alias("_blocks")).join(
        outside.groupBy("_coalition").agg(pieces(points_per_slice).alias("_slices")), "_coalition"
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    spread = lambda part, n: F.pmod(F.xxhash64(part), F.col(n))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - one))
    left = inside.join(sizes, "_coalition").withColumn("_block", spread("_inside", "_blocks")).withColumn("_slice", every("_slices"))
    right = outside.join(sizes, "_coalition").withColumn("_slice", spread("_outside", "_slices")).withColumn("_block", every("_blocks"))
    # a stated number of partitions: the few records that meet would be put into few tasks
    on, n = ["_coalition", "_block", "_slice"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.select(*on, "_inside").repartition(n, *on), right.select(*on, "_outside", "_share").repartition(n, *on)
    return left.join(right, on).drop("_block", "_slice")


def _longs(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _row_values(row, points, shares, base, masks, project, predict) -> np.ndarray:
    """(features x classes) contribution of these background points to one row's values."""
    n, m = masks.shape
    mixed = np.where(masks[:, None, :], row, points[None, :, :]).reshape(-1, m)
    means = np.einsum("p,npc->nc", shares, predict(mixed).reshape(n, len(points), -1))
    whole = shares.sum() * predict(row[None, :])[0]
    values = np.vstack([means - base, (whole - base)[None, :]])
    return project @ values


def expected_value(scored: DataFrame, k: int, proba: str = "proba") -> DataFrame:
    """Mean score per class: the base value the Shapley values start from."""
    row = scored.agg(
        F.array(*[F.avg(F.get(F.col(proba), F.lit(c))) for c in range(k)]).alias("means")
    )
    return row.select(F.posexplode("means").alias("class", "expected"))


def mean_abs(phi: DataFrame) -> DataFrame:
    return phi.groupBy("class", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def macro_rank(per_class: DataFrame) -> DataFrame:
    """Mean over classes of the mean absolute value, ranked."""
    macro = per_class.groupBy("feature").agg(F.avg("mean_abs").alias("macro_mean_abs"))
    return rank_desc(macro, "macro_mean_abs", "feature")
