import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.operators import metrics, permutation, ranking, selection, tuning

# Published counts of a six-class ensemble: rows are true classes.
COUNTS = [
    [23, 0, 1, 1, 0, 0],
    [2, 1, 2, 3, 1, 2],
    [2, 1, 16, 2, 0, 0],
    [3, 3, 1, 9, 0, 0],
    [0, 1, 0, 0, 36, 1],
    [0, 0, 0, 0, 3, 23],
]


def _preds(spark, counts, fold=1, model="Ensemble"):
    rows = [(fold, model, t, p) for t, row in enumerate(counts) for p, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "fold int, model string, y_true int, y_pred int")


def test_published_summary(spark):
    row = metrics.oof_metrics(_preds(spark, COUNTS), 6).first()
    assert row["accuracy"] == pytest.approx(108 / 137)
    assert row["f1_macro"] == pytest.approx(0.6871393281746409)
    assert row["f1_weighted"] == pytest.approx(0.7734357526726788)
    assert row["recall_weighted"] == pytest.approx(row["accuracy"])
    assert row["n_samples_oof"] == 137


def test_published_classwise(spark):
    rows = {r["class"]: r for r in metrics.prf_classwise(_preds(spark, COUNTS), 6, ["model"]).collect()}
    assert rows[0]["precision"] == pytest.approx(0.766667, abs=1e-6)
    assert rows[0]["recall"] == pytest.approx(0.92)
    assert rows[0]["f1"] == pytest.approx(0.836364, abs=1e-6)
    assert rows[1]["f1"] == pytest.approx(0.117647, abs=1e-6)
    assert (rows[3]["precision"], rows[3]["recall"]) == (pytest.approx(0.6), pytest.approx(0.5625))
    assert [rows[c]["support"] for c in range(6)] == [25, 11, 21, 16, 38, 26]


def test_zero_division_and_absent_class(spark):
    preds = _preds(spark, [[2, 0, 0], [1, 0, 0], [0, 0, 0]])
    rows = {r["class"]: r for r in metrics.prf_classwise(preds, 3, ["model"]).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"]) == (0.0, 0.0, 0.0)
    assert rows[2]["support"] == 0
    summary = metrics.oof_metrics(preds, 3).first()
    # the third class occurs nowhere and stays out of the macro mean
    assert summary["f1_macro"] == pytest.approx((0.8 + 0.0) / 2)
    shares = metrics.confusion_norm(metrics.confusion_counts(preds, 3, ["model"]), ["model"]).collect()
    assert len(shares) == 9 and all(r["share"] == 0 for r in shares if r["y_true"] == 2)


def test_printed_mean_and_deviation(spark):
    values = [0.8214285714, 0.7142857143, 0.7777777778, 0.8518518519, 0.7777777778]
    rows = [(i + 1, "Ensemble", v, 27) for i, v in enumerate(values)]
    per_fold = spark.createDataFrame(rows, "fold int, model string, accuracy double, n_test long")
    row = metrics.fold_mean_std(per_fold, ("accuracy",)).first()
    assert row["accuracy_mean_pm_std"] == "0.7886 ± 0.0520"
    assert (row["n_folds"], row["n_samples_total"]) == (5, 135)


def test_accuracy_summary(spark):
    values = ["0.8214285714", "0.75", "0.7777777778", "0.8518518519", "0.7777777778"]
    rows = [(i + 1, "Ensemble", v) for i, v in enumerate(values)] + [(1, "solo", "0.5"), (2, "solo", "n/a")]
    found = {r["model"]: r for r in metrics.accuracy_summary(spark.createDataFrame(rows, "fold int, model string, accuracy string")).collect()}
    assert found["Ensemble"]["mean"] == pytest.approx(0.7957671958)
    assert found["Ensemble"]["std"] == pytest.approx(0.0404532736)
    assert (found["solo"]["n"], found["solo"]["std"]) == (1, 0.0)
    assert found["Ensemble"]["per_fold"][2] == 0.75


def test_levels_agree(spark):
    both = _preds(spark, COUNTS, 1).unionByName(_preds(spark, [list(reversed(r)) for r in COUNTS], 2))
    table = metrics.metrics_by_level(both, 6)
    pooled = table.filter("fold IS NULL").first()
    direct = metrics.oof_metrics(both, 6).first()
    assert all(pooled[m] == pytest.approx(direct[m]) for m in metrics.METRICS)
    assert table.count() == 3


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet([1, 1, 1], size=300), 2)
    y = rng.integers(0, 2, 300)
    rows = [(int(a), [float(v) for v in b], "m") for a, b in zip(y, p)]
    preds = spark.createDataFrame(rows, "y_true int, proba array<double>, model string")
    found = {r["class"]: r["auc"] for r in metrics.auc_ovr(preds, 3, ["model"]).collect()}
    for c in (0, 1):
        pos, neg = p[y == c, c], p[y != c, c]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert found[c] == pytest.approx(wins / (len(pos) * len(neg)))
    assert found[2] is None
    points = metrics.roc_points(preds, 3, ["model"]).collect()
    assert {r["class"] for r in points} == {0, 1}
    assert max(r["tpr"] for r in points) == 1.0 and max(r["fpr"] for r in points) == 1.0


def test_external_labels(spark):
    rows = [("Fluorite ", "Fluorita"), ("Fluorita", "Spinel"), (None, "Spinel"), ("Bixbyite", "Spinel"), ("Spinel", "Spinel")]
    df = spark.createDataFrame(rows, "`Crystal Structure` string, guess string")
    facts, summary, classwise = metrics.eval_external(df, "Crystal Structure", "guess", ["Fluorita", "Spinel"])
    row = facts.first()
    assert (row.n_rows_total, row.n_rows_with_label, row.n_rows_unknown_label, row.n_rows_evaluated) == (5, 4, 1, 3)
    assert row.unknown_labels_preview == "Bixbyite" and row.status == "ok"
    assert summary.first()["accuracy"] == pytest.approx(2 / 3)
    assert classwise.count() == 2
    skipped, none, _ = metrics.eval_external(df, "absent", "guess", ["Spinel"])
    assert skipped.first()["status"] == "skipped" and none is None
    assert skipped.dtypes == facts.dtypes and skipped.first()["reason"] == "no column absent" and row.reason is None
    nothing = metrics.eval_external(df.filter("guess = 'x'"), "Crystal Structure", "guess", ["Spinel"])[0].first()
    assert nothing["status"] == "skipped"


def test_many_unknown_labels(spark):
    df = spark.createDataFrame([(f"u{i:02d}", "a") for i in range(25)], "t string, g string")
    text = metrics.eval_external(df, "t", "g", ["a"])[0].first()["unknown_labels_preview"]
    assert text == "; ".join(f"u{i:02d}" for i in range(20)) + " ..."


def test_pareto_line(spark):
    counts = spark.createDataFrame([("a", 6), ("b", 2), ("c", 1), ("d", 1)], "element string, n long")
    rows = ranking.pareto(counts, "element").orderBy("cumulative").collect()
    assert [(r["element"], r["cumulative"], r["cumulative_pct"]) for r in rows] == [
        ("a", 6, 60.0), ("b", 8, 80.0), ("c", 9, 90.0), ("d", 10, 100.0),
    ]
    assert ranking.pareto_cut(ranking.pareto(counts, "element")).count() == 2
    assert ranking.topk_features(counts, "n", "element", 0).count() == 4


def test_grid_sizes():
    assert len(tuning.combinations(tuning.GRID_FOREST)) == 1056
    assert len(tuning.combinations(tuning.GRID_BOOSTING)) == 192
    assert len(tuning.combinations(tuning.GRID_MLP)) == 864
    assert len(tuning.combinations(tuning.GRID_ELM)) == 7200


def test_first_of_equal_trials_wins(spark):
    rows = [(1, 1, None), (2, 1, 0.5), (2, 2, 0.7), (3, 1, 0.6), (3, 2, 0.6), (4, 1, 0.1), (4, 2, None)]
    log = tuning.trial_log(spark.createDataFrame(rows, "trial int, fold int, accuracy double"))
    assert tuning.best_trial(log).first()["trial"] == 2
    assert {r["trial"]: (r["n_ok"], r["n_failed"]) for r in log.collect()}[4] == (1, 1)
    assert tuning.best_trial(log.filter("trial = 1")).first() is None


def test_most_frequent_value(spark):
    values = {
        "clear": ["1", "1", "2", "3", "1"],
        "tied_with_best": ["1", "2", "2", "1", "3"],  # fold 4 is best
        "tied_without_best": ["1", "1", "2", "3", "2"],
    }
    rows = [(f + 1, "m", p, v) for p, vs in values.items() for f, v in enumerate(vs)]
    params = spark.createDataFrame(rows, "fold int, model string, param string, value string")
    outer = spark.createDataFrame([(f, "m", a) for f, a in zip(range(1, 6), [0.1, 0.2, 0.3, 0.9, 0.4])], "fold int, model string, accuracy double")
    found = {r["param"]: r["value"] for r in tuning.mode_tiebreak(params, outer).collect()}
    assert found == {"clear": "1", "tied_with_best": "1", "tied_without_best": "1"}


def test_pearson_with_missing_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) + 1e6
    mask = rng.random((300, 20)) < 0.2
    names = [f"c{i}" for i in range(20)]
    rows = [tuple(None if m else float(v) for v, m in zip(r, mr)) for r, mr in zip(x, mask)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    for some in (names, names[:6]):
        for r in selection.pearson_pairs(df, some).collect():
            ok = ~mask[:, r["i"]] & ~mask[:, r["j"]]
            assert r["r"] == pytest.approx(abs(np.corrcoef(x[ok, r["i"]], x[ok, r["j"]])[0, 1]), abs=1e-9)


def test_dropped_column_still_drops_others(spark):
    pairs = spark.createDataFrame([(0, 1, "a", "b", 0.9), (0, 2, "a", "c", 0.1), (1, 2, "b", "c", 0.7)],
                                  "i int, j int, feature_i string, feature_j string, r double")
    assert selection.correlated_columns(pairs, 0.59) == ["b", "c"]
    assert selection.correlated_columns(pairs, 0.9) == []


def test_constant_pair_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert selection.pearson_pairs(df, ["a", "b"]).first()["r"] is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000, 10001])
def test_arithmetic_permutation(n):
    places = [permutation.permuted(np.arange(n), n, permutation.keys(1, "f", rep)) for rep in range(3)]
    assert all(sorted(p) == list(range(n)) for p in places)
    if n >= 5000:
        assert all(abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.05 for p in places)
        assert abs(np.corrcoef(places[0], places[1])[0, 1]) < 0.05
        assert all((p == np.arange(n)).sum() < 10 for p in places)
        # neighbours part, and a tenth of the places receives from everywhere alike
        assert all(np.abs(np.diff(p)).mean() == pytest.approx(n / 3, rel=0.05) for p in places)
        assert all(np.bincount(p[: n // 10] * 10 // n, minlength=10) == pytest.approx(np.full(10, n / 100), rel=0.5) for p in places)


def test_arithmetic_permutation_of_a_large_range():
    n = 2**61 + 12345
    x = np.random.default_rng(3).integers(0, n, 5000)
    to = permutation.permuted(x, n, permutation.keys(5))
    assert to.min() >= 0 and to.max() < n and len(set(to.tolist())) == len(set(x.tolist()))


def test_moved_values_keep_their_types_and_all_columns(spark):
    """One shuffle of the rows for all features; NULLs, clashing names and odd ones included."""
    rows = [(i, i if i % 7 else None, f"s{i}", i / 2, i * 10, -1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, `a.b` long, s string, x double, _rank int, _feature int")
    moved = selection.permuted_rows(df, "id", ["a.b", "s", "x"], 3, 9)
    assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in moved.schema if f.name not in ("feature", "repeat")}
    found = moved.collect()
    assert len(found) == 400 * 9
    for f, at in (("a.b", 1), ("s", 2), ("x", 3)):
        for rep in range(3):
            part = [r for r in found if (r["feature"], r["repeat"]) == (f, rep)]
            assert sorted((r[f] for r in part), key=str) == sorted((r[at] for r in rows), key=str)
            for r in part:
                own = rows[r["id"]]
                assert all(r[c] == own[i] for i, c in enumerate(df.columns) if c != f)
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert selection.permuted_rows(df.filter("false"), "id", ["x"], 2, 1).count() == 0


def test_permutation_uses_each_value_once(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), i % 2) for i in range(300)], "id long, a double, b double, y int")
    moved = selection.permuted_rows(df, "id", ["a"], 2, 7).collect()
    for rep in (0, 1):
        part = [r for r in moved if r["repeat"] == rep]
        assert sorted(r["a"] for r in part) == [float(i) for i in range(300)]
        assert all(r["b"] == -r["id"] for r in part)
        assert sum(r["a"] != r["id"] for r in part) > 200
    found = selection.perm_importance(df, "id", "y", ["a", "b"], lambda d: d.withColumn("y_pred", F.pmod(F.col("a"), F.lit(2)).cast("int")), 3)
    scores = {r["feature"]: r["importance"] for r in found.collect()}
    assert scores["b"] == 0.0 and 0.3 < scores["a"] < 0.7


def test_topk_falls_back_to_available(spark):
    scores = spark.createDataFrame([("x", 0.5, 1.0)], "feature string, importance double, presence double")
    available = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "position int, feature string")
    assert [r["feature"] for r in selection.pick_topk(scores, available, 2).orderBy("rank").collect()] == ["p", "q"]


def test_a_missing_prediction_is_a_miss(spark):
    preds = spark.createDataFrame([("m", 1, 1), ("m", 1, None), ("m", 0, 0)], "model string, y_true int, y_pred int")
    found = {r["class"]: r.asDict() for r in metrics.prf_classwise(preds, 2, ["model"]).collect()}
    assert set(found) == {0, 1} and found[1]["recall"] == 0.5 and found[1]["support"] == 2
    assert metrics.accuracy(preds, ["model"]).first()["accuracy"] == 2 / 3
