"""Shapley values, checked where they have a closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablemill.catalog.base import query, r, table
from tablemill.operators import explain
from tablemill.session import materialize

_FEATURES = ["size", "kind", "shade"]
# Weights of the linear scorer: feature x class.
_WEIGHTS = [[0.5, -0.25], [1.5, 2.0], [-3.0, 0.75]]
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _linear(x: np.ndarray) -> np.ndarray:
    return x @ np.array(_WEIGHTS)


def _parts(spark, sf_dir):
    types = F.array(*[F.lit(t) for t in _TYPES])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("size"),
        (F.array_position(types, F.col("p_type")) - 1).cast("double").alias("kind"),
        F.pmod(F.length("p_name"), F.lit(5)).cast("double").alias("shade"),
    )


_PARTS_SQL = (
    "px AS (SELECT p_partkey, p_size::DOUBLE AS size, (list_position(["
    + ", ".join(f"'{t}'" for t in _TYPES)
    + "], p_type) - 1)::DOUBLE AS kind, (length(p_name) % 5)::DOUBLE AS shade FROM part)"
)

PHI_SQL = f"{_PARTS_SQL}, phi AS (" + " UNION ALL ".join(
    f"SELECT p_partkey, {c} AS class, '{f}' AS feature, {_WEIGHTS[j][c]}::DOUBLE * ({f} - avg({f}) OVER ()) AS phi FROM px"
    for j, f in enumerate(_FEATURES)
    for c in range(2)
) + ")"


def linear_values(spark, sf_dir):
    """All parts explained against all parts."""
    rows = _parts(spark, sf_dir)
    background = explain.background_points(rows, _FEATURES)
    return explain.kernel_shap(rows, "p_partkey", _FEATURES, background, _linear, 2)


@query("kernel_shap", f"WITH {PHI_SQL} SELECT p_partkey, class, feature, round(phi, 6) + 0.0 AS phi FROM phi")
def kernel_shap(spark, sf_dir):
    """For a linear scorer the value is weight x (feature - mean)."""
    return linear_values(spark, sf_dir).withColumn("phi", r("phi"))


_SUPPLIER = {"nation": [2.0, -1.0], "balance": [0.001, 0.5], "digit": [-0.5, 0.25]}
_SUPPLIERS_SQL = "sx AS (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal::DOUBLE AS balance, (s_suppkey % 7)::DOUBLE AS digit FROM supplier)"


@query("kernel_shap_scorer",
       f"WITH {_SUPPLIERS_SQL} " + " UNION ALL ".join(
           f"SELECT s_suppkey, {c} AS class, '{f}' AS feature, round({w[c]}::DOUBLE * ({f} - avg({f}) OVER ()), 5) + 0.0 AS phi FROM sx"
           for f, w in _SUPPLIER.items() for c in range(2)))
def kernel_shap_scorer(spark, sf_dir):
    """All suppliers against all suppliers, through a scorer that is given as a DataFrame function."""
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").cast("double").alias("balance"),
        F.pmod("s_suppkey", F.lit(7)).cast("double").alias("digit"),
    )
    rows = materialize(rows, "suppliers")

    def score(df):
        each = [sum((F.lit(w[c]) * F.col(f) for f, w in _SUPPLIER.items()), F.lit(0.0)) for c in range(2)]
        return df.withColumn("proba", F.array(*each))

    names = list(_SUPPLIER)
    background = materialize(explain.background_points(rows, names), "points")
    return explain.explain_scorer(rows, "s_suppkey", names, background, score, 2, points_per_slice=500).withColumn("phi", r("phi", 5))


@query("shap_expected",
       f"WITH {_PARTS_SQL} " + " UNION ALL ".join(
           f"SELECT {c} AS class, round(avg(" + " + ".join(f"{_WEIGHTS[j][c]}::DOUBLE * {f}" for j, f in enumerate(_FEATURES))
           + "), 6) AS expected FROM px" for c in range(2)))
def shap_expected(spark, sf_dir):
    score = [sum((F.lit(_WEIGHTS[j][c]) * F.col(f) for j, f in enumerate(_FEATURES)), F.lit(0.0)) for c in range(2)]
    scored = _parts(spark, sf_dir).select(F.array(*score).alias("proba"))
    return explain.expected_value(scored, 2).withColumn("expected", r("expected"))


@query("shap_mean_abs",
       f"WITH {PHI_SQL} SELECT class, feature, round(avg(abs(phi)), 10) AS mean_abs FROM phi GROUP BY 1, 2")
def shap_mean_abs(spark, sf_dir):
    return explain.mean_abs(linear_values(spark, sf_dir)).withColumn("mean_abs", r("mean_abs", 10))


@query("shap_macro_rank",
       f"WITH {PHI_SQL}, m AS (SELECT class, feature, avg(abs(phi)) AS v FROM phi GROUP BY 1, 2), k AS (SELECT feature, avg(v) AS v FROM m GROUP BY 1) "
       "SELECT feature, round(v, 10) AS macro_mean_abs, row_number() OVER (ORDER BY v DESC, feature) AS rank FROM k")
def shap_macro_rank(spark, sf_dir):
    found = explain.macro_rank(explain.mean_abs(linear_values(spark, sf_dir)))
    return found.withColumn("macro_mean_abs", r("macro_mean_abs", 10)).withColumn("rank", F.col("rank").cast("long"))
