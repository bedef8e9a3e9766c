"""Choosing features: correlation filter, permutation importance, counts over folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordering import free_name, hash_rank
from tablemill.operators.permutation import keys, permuted
from tablemill.operators.quantiles import column_facts
from tablemill.operators.quantiles import quoted as q
from tablemill.session import materialize


def pearson_pairs(df: DataFrame, columns: list[str], centre: list[float] | None = None) -> DataFrame:
    """Absolute Pearson r of every column pair i < j over the rows where both are present.

    ``centre`` holds the column means when they are known already; it saves one pass.

    Pairwise sums are matrix products per partition, then one sum per pair.
    Columns: ``i, j, feature_i, feature_j, r``; r is NULL where a side is constant. One
    row per pair, so the result is as wide as the feature list and not as long as the data.
    """
    if len(columns) < 2:
        schema = "i int, j int, feature_i string, feature_j string, r double"
        return df.sparkSession.createDataFrame([], schema)
    m = len(columns)
    if centre is None:
        facts = column_facts(df, columns)
        centre = [facts[c]["mean"] or 0.0 for c in columns]
    shift = np.array(centre)
    rows, cols = np.triu_indices(m, k=1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            part = np.stack([here.T @ here, x.T @ here, here.T @ x, square.T @ here, here.T @ square, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            picked = total[:, rows, cols]
            yield pd.DataFrame(
                dict(zip(("i", "j", "n", "sa", "sb", "saa", "sbb", "sab"), (rows, cols, *picked)))
            )

    schema = "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double"
    partial = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    totals = (
        partial.mapInPandas(sums, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    )
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    var_a = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), F.col("n"))
    var_b = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), F.col("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return totals.select(
        "i",
        "j",
        F.get(names, F.col("i")).alias("feature_i"),
        F.get(names, F.col("j")).alias("feature_j"),
        F.abs(F.try_divide(cov, F.sqrt(F.greatest(var_a, F.lit(0.0))) * F.sqrt(F.greatest(var_b, F.lit(0.0))))).alias("r"),
    )


def fold_pair_sums(df: DataFrame, columns: list[str], fold: str, centre: list[float]) -> DataFrame:
    """(fold, i, j, n, sa, sb, sab) over the rows of a fold that have both of two columns.

    One pass for all folds; values are taken from ``centre``.
    """
    m = len(columns)
    shift = np.array(centre)
    rows, cols = np.triu_indices(m, k=1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch["fold"].to_numpy()
            x = batch.drop(columns="fold").to_numpy(dtype=float) - shift
            for f in np.unique(folds).tolist():
                own = x[folds == f]
                here = (~np.isnan(own)).astype(float)
                own = np.nan_to_num(own, posinf=np.inf, neginf=-np.inf)
                part = np.stack([here.T @ here, own.T @ here, here.T @ own, own.T @ own])
                totals[f] = totals[f] + part if f in totals else part
        for f, total in totals.items():
            yield pd.DataFrame({"fold": f, **dict(zip(("i", "j", "n", "sa", "sb", "sab"), (rows, cols, *total[:, rows, cols])))})

    source = df.select(F.col(q(fold)).cast("int").alias("fold"), *[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    partial = source.mapInPandas(sums, "fold int, i int, j int, n double, sa double, sb double, sab double")
    return partial.groupBy("fold", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])


def correlated_in_splits(sums: DataFrame, splits: DataFrame, stats: DataFrame, threshold: float) -> DataFrame:
    """(split, j): columns with a stronger-than-threshold earlier partner, per split.

    ``sums``: :func:`fold_pair_sums`. ``splits``: (split, fold) of the folds a split holds.
    ``stats``: (split, i, rows, n, s, q, m) of the columns that vary there: rows, values,
    their sum and sum of squares and the median, all from the same centre. NULLs count as
    the median, which the sums of the values alone decide: where one side is missing, the
    other side's sum is what it has in all less what it has where both are there.
    """
    side = lambda x, i: stats.select("split", F.col("i").alias(i), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "s", "q", "m")])
    both = sums.join(splits, "fold").groupBy("split", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
    sized = stats.groupBy("split").agg(F.max("rows").alias("rows"))
    joined = both.join(side("a", "i"), ["split", "i"]).join(side("b", "j"), ["split", "j"]).join(sized, "split")
    rows = F.col("rows")

    def filled(x: str) -> tuple:
        n, s, sq, m = (F.col(f"{c}_{x}") for c in ("n", "s", "q", "m"))
        total = s + (rows - n) * m
        return total, F.greatest(sq + (rows - n) * m * m - total * total / rows, F.lit(0.0))

    (sum_a, var_a), (sum_b, var_b) = filled("a"), filled("b")
    cross = (
        F.col("sab")
        + F.col("m_b") * (F.col("s_a") - F.col("sa"))
        + F.col("m_a") * (F.col("s_b") - F.col("sb"))
        + F.col("m_a") * F.col("m_b") * (rows - F.col("n_a") - F.col("n_b") + F.col("n"))
    )
    r = F.abs(F.try_divide(cross - sum_a * sum_b / rows, F.sqrt(var_a) * F.sqrt(var_b)))
    return joined.where(r > threshold).select("split", "j").distinct()


def pearson_matrix(pairs: DataFrame) -> DataFrame:
    """Both halves of the matrix from the pairs with i < j."""
    other = pairs.select(
        F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "r"
    )
    return pairs.select("feature_i", "feature_j", "r").unionByName(other)


def pearson_filter(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Features (``feature, position``) without a stronger-than-threshold earlier partner.

    An earlier column counts even when it is dropped itself.
    """
    dropped = (
        pairs.filter(F.col("r") > threshold).select(F.col("feature_j").alias("feature")).distinct()
    )
    return features.join(dropped, "feature", "left_anti")


def correlated_columns(pairs: DataFrame, threshold: float) -> list[str]:
    """Names dropped by the correlation filter, in column order."""
    hits = pairs.filter(F.col("r") > threshold).select("j", "feature_j").distinct().orderBy("j")
    return [r["feature_j"] for r in hits.collect()]


def permuted_rows(df: DataFrame, row_id: str, features: list[str], repeats: int, seed: int) -> DataFrame:
    """Every row once per (feature, repeat) with that feature's values shuffled over all rows.

    Rows are ranked once by md5(id, seed). The value of the row at a rank goes to the rank that
    an arithmetic permutation, keyed by seed, feature and repeat, names: each value is used
    exactly once, at every size. One join by rank serves all features and repeats; the wide rows
    are shuffled for it once, and a moved value travels as itself and three numbers. An empty
    table gives no rows. Columns ``feature`` and ``repeat`` of the table are replaced.
    """
    rank, which, turn = (free_name(df, c) for c in ("_rank", "_feature", "_repeat"))
    hashed = F.md5(F.concat_ws("-", F.col(q(row_id)).cast("string"), F.lit(str(seed))))
    ranked = materialize(hash_rank(df, hashed, [row_id], out=rank), "ranked")
    n = ranked.count()
    plan = [(i, rep, keys(seed, f, rep)) for i, f in enumerate(features) for rep in range(repeats)]
    types = list(dict.fromkeys(df.schema[f].dataType.simpleString() for f in features))
    slot = [types.index(df.schema[f].dataType.simpleString()) for f in features]

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() - 1
            empty = {i: pa.nulls(len(at), batch.column(slot.index(i) + 1).type) for i in range(len(types))}
            for i, rep, by in plan:
                to = pa.array(permuted(at, n, by) + 1)
                values = [batch.column(i + 1) if t == slot[i] else empty[t] for t in range(len(types))]
                about = [pa.array(np.full(len(at), v, np.int32)) for v in (i, rep)]
                yield pa.RecordBatch.from_arrays([to, *about, *values], ["to", "f", "rep", *[f"v{t}" for t in range(len(types))]])

    schema = ", ".join(["to long, f int, rep int", *[f"v{i} {t}" for i, t in enumerate(types)]])
    sent = ranked.select(F.col(rank).cast("long"), *[F.col(q(f)).alias(f"c{i}") for i, f in enumerate(features)]).mapInArrow(moves, schema)
    sent = sent.select(
        F.col("to").alias(rank), F.col("f").alias(which), F.col("rep").alias(turn), *[F.col(f"v{i}").alias(free_name(df, f"_value{i}")) for i in range(len(types))]
    )
    place = {f: i for i, f in enumerate(features)}

    def cell(c: str) -> Column:
        if c not in place:
            return F.col(q(c))
        return F.when(F.col(which) == place[c], F.col(free_name(df, f"_value{slot[place[c]]}"))).otherwise(F.col(q(c))).alias(c)

    name = F.get(F.array(*[F.lit(f) for f in features]), F.col(which)).alias("feature")
    kept = [cell(c) for c in df.columns if c not in ("feature", "repeat")]
    return ranked.join(sent, rank).select(*kept, name, F.col(turn).alias("repeat"))


def perm_importance(
    df: DataFrame,
    row_id: str,
    label: str,
    features: list[str],
    predict: Callable[[DataFrame], DataFrame],
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Baseline accuracy minus mean accuracy with one feature shuffled.

    ``predict`` adds ``y_pred``. Columns: ``feature, importance, baseline``.
    """
    hit = (F.col("y_pred") == F.col(label)).cast("double")
    base = predict(df).agg(F.avg(hit).alias("baseline")).first()
    moved = permuted_rows(df, row_id, features, repeats, seed)
    per_repeat = predict(moved).groupBy("feature", "repeat").agg(F.avg(hit).alias("accuracy"))
    return per_repeat.groupBy("feature").agg(
        (F.lit(base["baseline"]) - F.avg("accuracy")).alias("importance"),
        F.lit(base["baseline"]).alias("baseline"),
    )


def pfi_aggregate(importances: DataFrame, n_folds: int) -> DataFrame:
    """Mean importance over the folds a feature is present in, and that share of folds."""
    return importances.groupBy("feature").agg(
        F.avg("importance").alias("importance"),
        (F.count(F.lit(1)) / F.lit(float(n_folds))).alias("presence"),
    )


def pick_topk(scores: DataFrame, available: DataFrame, k: int) -> DataFrame:
    """First k available features by (importance, presence) descending, then name.

    With no scored feature available, the first k available ones by position.
    """
    order = [F.desc("importance"), F.desc("presence"), F.asc("feature")]
    chosen = scores.join(available.select("feature"), "feature", "left_semi")
    ranked = chosen.select("feature", "importance", "presence").orderBy(*order).limit(k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if not chosen.isEmpty():
        return ranked
    first = available.orderBy("position").limit(k)
    return first.select(
        "feature",
        F.lit(None).cast("double").alias("importance"),
        F.lit(None).cast("double").alias("presence"),
        F.row_number().over(Window.orderBy("position")).alias("rank"),
    )


def feature_presence(selected: DataFrame) -> DataFrame:
    """How often a feature was selected: per model, and overall where ``model`` is NULL.

    ``selected`` holds (fold, model, features array).
    """
    long = selected.select("model", F.explode("features").alias("feature"))
    per_model = long.groupBy("model", "feature").agg(F.count(F.lit(1)).alias("n"))
    overall = per_model.groupBy("feature").agg(F.sum("n").alias("n"))
    return per_model.unionByName(overall.withColumn("model", F.lit(None).cast("string")))


def stable_features(selected: DataFrame, n_lists: int, share: float = 0.5) -> DataFrame:
    """Features in at least ``ceil(share * lists)`` folds (``fold, feature``).

    A fold counts once, however many of its models chose the feature.
    """
    need = max(1, int(np.ceil(n_lists * share)))
    return selected.groupBy("feature").agg(F.count_distinct("fold").alias("n")).filter(F.col("n") >= need)


def feature_set_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each feature of ``before`` with whether it is still in ``after``."""
    marked = after.select("feature", F.lit(True).alias("_kept"))
    return before.select("feature").join(marked, "feature", "left").select(
        "feature", F.coalesce("_kept", F.lit(False)).alias("kept")
    )
