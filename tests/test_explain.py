"""Shapley values of whatever scores a DataFrame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.catalog.base import FEATURES, parted_table
from tablemill.operators import explain
from tablemill.plans import finalize, nested_cv, scoring
from tablemill.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundle(spark):
    names = [FEATURES[1], FEATURES[2], FEATURES[7], FEATURES[10]]
    wide = materialize(parted_table(spark, SF).select("row_id", "y", *names), "wide")
    params = {
        "RandomForest": {"n_estimators": 3, "max_depth": 3},
        "GradientBoosting": {"n_estimators": 1, "max_depth": 2},
        "MLP": {"hidden_layer_sizes": [3], "max_iter": 5},
        "ELM": {"hidden_units": 5, "activation_function": "tanh", "C": 1.0, "solver": "solution1"},
    }
    return names, wide, finalize.fit_final(wide, names, ["even", "odd"], params, nested_cv.Settings(k=2, threshold=1.0))


def test_the_ensemble_is_explained(spark, bundle):
    """Values of a row sum to its score less the mean score of the background."""
    names, wide, fitted = bundle
    filled = materialize(wide.fillna(0.0).orderBy("row_id").limit(40), "filled")
    score = scoring.scorer(fitted)
    points = materialize(explain.background_points(filled, names), "points")
    phi = explain.explain_scorer(filled.limit(6), "row_id", names, points, score, 2, points_per_slice=15).collect()
    own = {r.row_id: list(r.proba) for r in score(filled).collect()}
    mean = np.mean(list(own.values()), axis=0)
    assert len(phi) == 6 * 2 * len(names)
    for i in {r.row_id for r in phi}:
        for c in range(2):
            total = sum(r.phi for r in phi if r.row_id == i and r["class"] == c)
            assert total == pytest.approx(own[i][c] - mean[c], abs=1e-9)


def test_same_values_as_the_array_route(spark):
    """A scorer with an interaction, by both routes and for any size of a slice."""
    rows = [(i, float(i % 5), float(i * i % 7), float(i % 3)) for i in range(30)]
    df = materialize(spark.createDataFrame(rows, "id int, a double, `b c` double, d double"), "rows")
    names = ["a", "b c", "d"]
    points = materialize(explain.background_points(df, names), "points")

    def arrays(x):
        return np.stack([x[:, 0] * x[:, 1] + x[:, 2], x[:, 1] - x[:, 2] ** 2], 1)

    def score(frame):
        a, b, d = (F.col(f"`{n}`") for n in names)
        return frame.withColumn("proba", F.array(a * b + d, b - d * d))

    flat = lambda found: {(r.id, r["class"], r.feature): r.phi for r in found.collect()}
    expected = flat(explain.kernel_shap(df, "id", names, points, arrays, 2))
    for size in (4, 1000):
        assert flat(explain.explain_scorer(df, "id", names, points, score, 2, points_per_slice=size)) == pytest.approx(expected)


def test_nothing_is_shuffled_before_it_is_summed(spark):
    """The mixed rows go straight from their task's scorer into partial sums."""
    df = spark.range(10).select(F.col("id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    mixed = df.withColumnRenamed("id", "_id").mapInPandas(
        explain._mixed(["a", "b"], np.array([[True, False], [False, True]]), np.zeros((3, 2)), np.ones(3) / 3),
        "_id long, _coalition int, _share double, a double, b double",
    )
    assert mixed.count() == 10 * 2 * 3
    plan = mixed.groupBy("_id", "_coalition").agg(F.sum("a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") > plan.index("partial_sum") > plan.index("Exchange")


def test_a_coalition_scores_its_distinct_halves_only(spark):
    """300 rows with one feature of many values and two of few: far from 300 x 300 mixed rows a coalition."""
    rows = [(i, i * 1.25, float(i % 2), float(i % 3) if i % 7 else None) for i in range(300)]
    df = materialize(spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3), "rows")
    points = materialize(explain.background_points(df, ["a", "b", "c"]), "points")
    scored = spark.sparkContext.accumulator(0)

    def score(frame):
        def run(batches):
            for batch in batches:
                scored.add(len(batch))
                a, b, c = (batch[n].astype(float) for n in "abc")
                yield batch.assign(proba=[[x] for x in a * b - b * c.fillna(-2.0)])

        schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in frame.schema)
        return frame.mapInPandas(run, f"{schema}, proba array<double>")

    def arrays(x):
        return (x[:, :1] * x[:, 1:2]) - x[:, 1:2] * np.nan_to_num(x[:, 2:], nan=-2.0)

    flat = lambda found: {(r.id, r["class"], r.feature): r.phi for r in found.collect()}
    found = flat(explain.explain_scorer(df, "id", ["a", "b", "c"], points, score, 1, points_per_slice=50, rows_per_block=64))
    # insides x outsides: 300x8, 2x300, 4x300, 300x4, 300x2, 8x300 at most; background and rows themselves once each
    assert scored.value <= 300 * (8 + 2 + 4 + 4 + 2 + 8) + 2 * 300
    assert len(found) == 900
    assert found == pytest.approx(flat(explain.kernel_shap(df, "id", ["a", "b", "c"], points, arrays, 1)))
