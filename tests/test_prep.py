import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.functions.labels import (
    CLASS_ENGLISH,
    pick_class,
    short_feature,
    to_known_class,
    translate_feature,
    translate_label,
)
from tablemill.operators import prep, splitting
from tablemill.operators.ordering import running_totals
from tablemill.operators.quantiles import exact_medians


def _wide(spark, matrix, names=None):
    names = names or [f"c{i}" for i in range(len(matrix[0]))]
    schema = ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in row) for row in matrix], schema)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e300, 1e300), st.sampled_from([1.0, 2.0, 1e16, 1e16 + 2])), min_size=1, max_size=40))
def test_median_is_exact(spark, values):
    df = _wide(spark, [[v] for v in values])
    present = [v for v in values if v is not None]
    expected = float(np.median(present)) if present else 0.0
    assert exact_medians(df, ["c0"])["c0"] == pytest.approx(expected, rel=1e-15)


def test_medians_of_infinities_and_nothing(spark):
    inf = float("inf")
    df = _wide(spark, [[1.0, inf, None], [2.0, inf, None], [inf, -inf, None], [3.0, inf, None], [4.0, -inf, None]])
    assert exact_medians(df, df.columns) == {"c0": 3.0, "c1": inf, "c2": 0.0}


def test_fitted_preprocessing_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 20))
    x[:, 5] = 2 * x[:, 4] + 0.01 * rng.normal(size=200)
    x[:, 7] = 3.0
    x[::9, 2] = np.nan
    rows = [[None if np.isnan(v) else v for v in row] for row in x]
    names = [f"c {i}-x" for i in range(19)] + ["empty"]
    for row in rows:
        row[19] = None
    pre = prep.fit_preprocessing(_wide(spark, rows, names), names)
    filled = np.where(np.isnan(x[:, :19]), np.nanmedian(x[:, :19], axis=0), x[:, :19])
    assert pre.dropped_by_constant_filter == ["c 7-x", "empty"]
    assert pre.medians["empty"] == 0.0
    assert pre.medians["c 2-x"] == pytest.approx(np.nanmedian(x[:, 2]))
    assert "c 5-x" in pre.dropped_by_pearson and "c 4-x" in pre.final_features
    keep = [names.index(c) for c in pre.final_features]
    assert pre.scaler_mean == pytest.approx(list(filled[:, keep].mean(axis=0)), abs=1e-12)
    assert pre.scaler_scale == pytest.approx(list(filled[:, keep].std(axis=0)), abs=1e-12)
    out = prep.apply_preprocessing(_wide(spark, rows, names).drop("c 2-x"), pre, []).select("features_scaled")
    assert len(out.first()[0]) == len(pre.final_features)
    again = prep.Preprocessing.from_json(pre.to_json())
    assert again == pre


def test_constant_rule(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 2.0), (1.0, None, None, 3.0)], "a double, b double, c double, d double")
    assert prep.varying_columns(df, df.columns) == ["b", "d"]
    assert prep.drop_all_null(df, df.columns).columns == ["a", "b", "d"]


def test_aliases(spark):
    assert prep.accepted_spellings("atomic_ea_minimo") == {"atomic_ea_minimo", "atomic_ea_min"}
    assert prep.accepted_spellings("en_allen _soma") == {"en_allen_soma", "en_allen_sum"}
    assert prep.accepted_spellings("plain") == {"plain"}
    df = spark.createDataFrame([(1, 2, 3, 4)], "x_mean int, en_allen_sum int, `en_allen _sum` int, y int")
    _, made = prep.rename_aliases(df, ["x_media", "x_medio", "en_allen _soma"])
    assert made == {"x_mean": "x_media", "en_allen_sum": "en_allen _soma"}


def test_alias_never_overwrites(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_min int, a_minimo int, composition int")
    renamed, made = prep.rename_aliases(df, ["a_minimo"])
    assert renamed.columns == ["a_min", "a_minimo", "composition"] and made == {}


def test_scaler_zero_spread(spark):
    df = _wide(spark, [[1.0, 5.0], [3.0, 5.0]])
    assert prep.fit_scaler(df, ["c0", "c1"]) == ([2.0, 5.0], [1.0, 1.0])


def test_labels(spark):
    df = spark.createDataFrame([(f" {k} ",) for k in CLASS_ENGLISH] + [("other",)], "c string")
    found = [r[0] for r in df.select(translate_label(F.col("c"))).collect()]
    assert found == [*CLASS_ENGLISH.values(), "other"]
    classes = ["Fluorita", "Mixed", "RockSalt"]
    assert [pick_class(classes, w) for w in ("fluorite", "Rock Salt", "Mixed", "nothing", None)] == [0, 2, 1, 0, 0]


def test_feature_names(spark):
    names = ["atomic_en_allen _soma", "x_minimo", "y_outro", "z"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(translate_feature(F.col("c"))).collect()] == [
        "atomic_en_allen_sum", "x_minimum", "y_outro", "z",
    ]
    shown = spark.createDataFrame([("a_maximum",), ("b_minimum",)], "c string").select(short_feature(F.col("c")))
    assert [r[0] for r in shown.collect()] == ["a_max", "b_min"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        prep.require_columns(spark.range(1), ["nope"])


def test_running_totals_with_a_hot_value(spark):
    rows = [("g", i, 5 if i % 3 else 1) for i in range(500)] + [("h", 1, 2)]
    df = spark.createDataFrame(rows, "g string, i int, n long").repartition(7)
    found = running_totals(df, [F.desc("n"), F.asc("i")], {"c": "n"}, ["g"], grand={"t": "n"}).collect()
    total = 0
    for g, i, n in sorted((r for r in rows if r[0] == "g"), key=lambda r: (-r[2], r[1])):
        total += n
        assert next(r["c"] for r in found if r["g"] == "g" and r["i"] == i) == total
    assert {r["t"] for r in found if r["g"] == "g"} == {total}


def test_folds_are_balanced_and_complete(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(1000)]
    dealt = splitting.stratified_kfold(spark.createDataFrame(rows, "id long, label string"), "id", "label", 5)
    counts = {(r["label"], r["fold"]): r["n"] for r in dealt.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 1000
    for label in ("hot", "cold"):
        sizes = [counts[label, f] for f in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    again = splitting.stratified_kfold(spark.createDataFrame(rows, "id long, label string").repartition(13), "id", "label", 5, prefix=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dealt.collect()))


def test_row_names(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, None)], "k int, composition string")
    found = {r["k"]: r["composition"] for r in splitting.row_names(df, ["k"]).collect()}
    assert found == {1: "a", 2: "row_2", 3: "row_3"}


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(30)], "g string, i int")
    found = running_totals(df, [F.asc("i")], {"c": "i"}, ["g"]).collect()
    assert len(found) == 30 and max(r["c"] for r in found if r["g"] is None) == sum(range(0, 30, 3))


def test_class_spellings(spark):
    df = spark.createDataFrame([("Fluorita",), (" Fluorite ",), ("Mista",), ("Rocksalt",), ("x",), (None,)], "c string")
    found = [r[0] for r in df.select(to_known_class(F.col("c"), ["Fluorite", "Mixed", "RockSalt"])).collect()]
    assert found == ["Fluorite", "Fluorite", "Mixed", "RockSalt", "x", None]
