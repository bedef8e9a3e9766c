"""Radix medians and preprocessing of all splits at once, against fitting each alone."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablemill.functions import vectors
from tablemill.operators import prep, quantiles, splitting
from tablemill.session import materialize


def test_keys_keep_the_order_of_doubles():
    draw = np.random.default_rng(1)
    x = np.r_[draw.normal(size=500) * 10.0 ** draw.integers(-300, 300, 500), 0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]
    keys = quantiles.sortable_keys(x)
    assert (np.sort(keys) == keys[np.argsort(x, kind="stable")]).all()
    assert [quantiles.value_of_key(int(k)) for k in keys] == x.tolist()
    assert quantiles.sortable_keys(np.array([np.nan, -np.nan])).min() > quantiles.sortable_keys(np.array([np.inf]))[0]


@pytest.fixture(scope="module")
def cells(spark):
    draw = random.Random(7)
    value = lambda: draw.choice([None, draw.gauss(0, 1), draw.gauss(0, 1e9), float(draw.randint(-2, 2)), float("inf"), -0.0])
    rows = [(i, draw.randint(1, 3), value(), value(), None, float("inf") if i % 3 else 1.0, 4.5 if i == 5 else None) for i in range(301)]
    return rows, materialize(spark.createDataFrame(rows, "i int, fold int, a double, `b b` double, c double, d double, e double").repartition(5), "cells")


def middle(values):
    return statistics.median(values) if values else 0.0


def test_medians_of_all_splits(cells):
    rows, df = cells
    names = ["a", "b b", "c", "d", "e"]
    found = quantiles.split_medians(df, names, "fold", [None, 1, 2, 3])
    for s, by_column in found.items():
        for k, c in enumerate(names):
            values = [r[k + 2] for r in rows if r[1] != s and r[k + 2] is not None]
            assert by_column[c] == middle(values), (s, c)
    assert quantiles.exact_medians(df, names) == found[None]
    assert quantiles.exact_medians(df.where("false"), names) == dict.fromkeys(names, 0.0)
    assert quantiles.exact_medians(df, []) == {}


def test_medians_shuffle_counts_only(cells):
    """No cell is shuffled: what a look exchanges are counts of digits."""
    _, df = cells
    plan = quantiles._digit_counts(df, ["a", "b b"], "fold", {0: {0}, 1: {0}}, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


@pytest.fixture(scope="module")
def wide(spark):
    draw = random.Random(11)
    rows = []
    for i in range(400):
        base = draw.gauss(5, 2)
        x = [base, base + draw.gauss(0, 0.5), draw.gauss(0, 1), 3.0, None if i % 4 else base * 2, float(i < 3), draw.gauss(100, 1e-3), None]
        x = [None if v is not None and draw.random() < 0.1 and k != 3 else v for k, v in enumerate(x)]
        rows.append((i, i % 5 + 1, *x))
    schema = "row_id int, f int, " + ", ".join(f"x{k} double" for k in range(8))
    return materialize(spark.createDataFrame(rows, schema), "wide")


def test_every_split_as_fitted_alone(wide):
    names = [f"x{k}" for k in range(8)]
    found = prep.fit_preprocessing_splits(wide, names, "f", [None, 1, 2, 3, 4, 5], 0.6)
    kinds = set()
    for s, pre in found.items():
        alone = prep.fit_preprocessing(wide if s is None else wide.filter(F.col("f") != s), names, 0.6)
        assert pre.medians == alone.medians
        for part in ("dropped_by_constant_filter", "kept_after_constant_filter", "final_features", "dropped_by_pearson"):
            assert getattr(pre, part) == getattr(alone, part), (s, part)
        assert pre.scaler_mean == pytest.approx(alone.scaler_mean) and pre.scaler_scale == pytest.approx(alone.scaler_scale)
        kinds.add(tuple(pre.final_features))
    assert all("x0" in k and "x1" not in k and "x3" not in k for k in kinds)


def test_looks_do_not_grow_with_splits(spark, wide):
    """As many jobs for five splits as for one."""
    names = [f"x{k}" for k in range(8)]

    def jobs(splits):
        group = f"splits-{len(splits)}"
        spark.sparkContext.setJobGroup(group, group)
        prep.fit_preprocessing_splits(wide, names, "f", splits, 0.6)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return n

    assert jobs([None, 1, 2, 3, 4, 5]) <= jobs([None]) + 2


def test_helper_columns_leave_equal_names_alone(spark):
    rows = [(i, i % 2, f"h{i}", -i, i * 2, i * 3, i * 5, i * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, _hash string, _piece int, _rank int, _one int, _i int, _offset int")
    dealt = splitting.stratified_kfold(df, "id", "y", 3, 1)
    plain = splitting.stratified_kfold(df.select("id", "y"), "id", "y", 3, 1)
    named = splitting.row_names(df, ["id"])
    assert dealt.columns == [*df.columns, "fold"] and named.columns == [*df.columns, "composition"]
    for found in (dealt, named):
        assert sorted(tuple(r)[:-1] for r in found.collect()) == rows
    assert {r["id"]: r["fold"] for r in dealt.collect()} == {r["id"]: r["fold"] for r in plain.collect()}
    assert {r["composition"] for r in named.collect()} == {f"row_{i}" for i in range(1, 61)}


def test_lists_become_rows_of_a_matrix():
    lists = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]])
    assert np.array_equal(vectors.matrix_of_lists(lists), [[1, 2], [3, np.nan], [5, 6]], equal_nan=True)
    assert vectors.lists_of_matrix(vectors.matrix_of_lists(lists.slice(2))).to_pylist() == [[5.0, 6.0]]
    for uneven in ([[1.0], [2.0, 3.0, 4.0]], [[1.0, 2.0], None]):
        with pytest.raises(ValueError, match="differ in length"):
            vectors.matrix_of_lists(pa.array(uneven))


def test_inner_folds_follow_from_the_outer_rank():
    """Of ranks alone: what the outer deal says of an inner one, and which cells a split leaves out."""
    for outer, k in ((2, 2), (5, 2), (5, 5), (3, 4)):
        for f in range(1, outer + 1):
            left = [r for r in range(1, 200) if (r - 1) % outer + 1 != f]
            dealt = {r: i % k + 1 for i, r in enumerate(left)}
            for r in range(1, 200):
                cell = (r - 1) % (outer * k)
                assert (cell in splitting.cells_left_out(outer, f, k, None)) == (r not in dealt)
                for i in range(1, k + 1):
                    assert (cell in splitting.cells_left_out(outer, f, k, i)) == (dealt.get(r, i) == i)
