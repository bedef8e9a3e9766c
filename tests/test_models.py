import itertools
import json
import sys
from math import factorial

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablemill.functions.vectors import argmax_index, mean_of_arrays, softmax, top_entries
from tablemill.operators import boosting, calibration, elm, explain, models, network
from tablemill.operators.tuning import combinations

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _blobs(spark, n=240, k=3, d=4, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    x = rng.normal(size=(n, d)) + 2.5 * np.eye(k, d)[y]
    rows = [(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "row_id long, y int, features array<double>")
    return x, y, df.withColumn("features_scaled", F.col("features"))


@pytest.mark.parametrize("name,params", [
    ("RandomForest", {"n_estimators": 10, "max_depth": 4, "criterion": "log_loss"}),
    ("GradientBoosting", {"n_estimators": 3, "max_depth": 2}),
    ("MLP", {"hidden_layer_sizes": [6], "max_iter": 60}),
    ("MLP", {"hidden_layer_sizes": [6], "activation": "tanh", "alpha": 0.01, "max_iter": 25}),
    ("ELM", {"hidden_units": 20, "activation_function": "tanh", "C": 10.0, "solver": "solution1"}),
])
def test_models_learn_and_give_probabilities(spark, name, params):
    _, _, df = _blobs(spark)
    model = models.fit_model(name, df, "y", 4, params)
    rows = model.score(df).select("y", "proba").collect()
    assert all(len(r["proba"]) == 4 and sum(r["proba"]) == pytest.approx(1.0) for r in rows)
    assert all(r["proba"][3] == 0.0 for r in rows) or name == "MLP"
    assert np.mean([np.argmax(r["proba"]) == r["y"] for r in rows]) > 0.8


@pytest.mark.parametrize("name,params", [
    ("RandomForest", {"max_leaf_nodes": 7}),
    ("MLP", {"alpha": 0.1, "solver": "sgd"}),
    ("MLP", {"activation": "softplus"}),
    ("MLP", {"activation": "relu", "learning_rate_init": 0.1}),
    ("MLP", {"solver": "adam"}),
    ("GradientBoosting", {"criterion": "friedman_mse"}),
])
def test_parameters_that_cannot_be_expressed_are_refused(spark, name, params):
    _, _, df = _blobs(spark, n=12)
    with pytest.raises(ValueError, match=name):
        models.fit_model(name, df, "y", 3, params)


@pytest.mark.parametrize("k", [2, 3])
def test_boosted_leaves_step_by_newton(spark, k):
    """Rounds redone in numpy over the found splits: values, losses and probabilities agree."""
    x, y, df = _blobs(spark, k=k)
    odd = df.limit(2).withColumn("y", F.lit(None).cast("int")).unionByName(df.limit(2).withColumn("features", F.lit(None).cast("array<double>")))
    rows = df.unionByName(odd).repartition(5)
    model = boosting.fit_boosted(rows.withColumn("y", 2 * F.col("y") + 1), "features", "y", 6, 0.5, maxDepth=2)
    assert model.classes == [2 * c + 1 for c in range(k)]
    assert all(a > b for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) == 6
    scores = np.zeros((len(y), k)) + np.log(np.bincount(y) / len(y))
    for trees, loss in zip(model.rounds, model.losses):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        assert loss == pytest.approx(-np.mean(np.log(p[np.arange(len(y)), y])))
        for tree, c in zip(trees, [1] if k == 2 else range(k)):
            at, rest = tree.leaves(x), (y == c) - p[:, c]
            for leaf in np.unique(at):
                inside = at == leaf
                newton = rest[inside].sum() / (p[inside, c] * (1 - p[inside, c])).sum()
                assert tree.value[leaf] == pytest.approx(0.5 * newton * (1 if k == 2 else (k - 1) / k))
            scores[:, c] += tree.value[at]
    want = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    found = rows.select("row_id", "features", model.probabilities(F.col("features"), 8).alias("p")).collect()
    for r in found:
        if r["features"] is None:
            assert r["p"] is None
        else:
            assert [r["p"][c] for c in model.classes] == pytest.approx(want[r["row_id"]])
            assert sum(r["p"]) == pytest.approx(1.0)


def test_boosting_of_one_class_or_none(spark):
    _, _, df = _blobs(spark, n=12)
    sure = models.fit_model("GradientBoosting", df.filter("y = 1"), "y", 3).score(df).select("proba").distinct().collect()
    assert [r["proba"] for r in sure] == [[0.0, 1.0, 0.0]]
    with pytest.raises(ValueError, match="no rows"):
        models.fit_model("GradientBoosting", df.filter("false"), "y", 3)


def test_a_tree_without_a_split():
    tree = boosting.tree_of("DecisionTreeRegressionModel: uid=u, depth=0, numNodes=1, numFeatures=2\n  Predict: 0.5\n")
    assert tree.leaves(np.array([[1.0, np.nan], [np.inf, 2.0]])).tolist() == [0, 0]


@pytest.mark.parametrize("activation", ["sigmoid", "relu", "sin", "tanh", "leaky_relu"])
def test_elm_equals_least_squares(spark, activation):
    x, y, df = _blobs(spark)
    layer = elm.draw_layer(12, activation, "normal", 4)
    h = elm.hidden(x, layer)
    target = np.eye(3)[y]
    plain = elm.fit_elm(df, "features", "y", 3, 12, activation, solver="no_re").beta
    assert h @ plain == pytest.approx(h @ np.linalg.lstsq(h, target, rcond=None)[0], abs=1e-6)
    ridge = elm.fit_elm(df.repartition(7), "features", "y", 3, 12, activation, C=2.0, solver="solution2").beta
    assert ridge == pytest.approx(np.linalg.solve(np.eye(12) / 2 + h.T @ h, h.T @ target), abs=1e-8)


def test_elm_of_values_equals_least_squares(spark):
    x, y, df = _blobs(spark)
    layer = elm.draw_layer(12, "tanh", "normal", 4)
    h, target = elm.hidden(x, layer), y * 1.5 + np.sin(x[:, 0])
    rows = df.withColumn("v", F.col("y") * 1.5 + F.sin(F.get("features", F.lit(0))))
    rows = rows.unionByName(rows.limit(3).withColumn("v", F.lit(None).cast("double")))
    model = elm.fit_elm(rows.repartition(5), "features", "v", None, 12, "tanh")
    want = h @ np.linalg.lstsq(h, target, rcond=None)[0]
    assert h @ model.beta[:, 0] == pytest.approx(want, abs=1e-6)
    scored = rows.select(F.lit("m").alias("model"), "v", model.values(F.col("features")).alias("p"))
    found = elm.elm_score(scored, "v", "p", ["model"], ("reg",)).first()
    assert found["rmse"] == pytest.approx(np.sqrt(np.mean((want - target) ** 2)), abs=1e-6)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 1)], "t int, p int")
    assert elm.elm_score(labels, "t", "p", [], ("clf",)).first()["accuracy"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("activation", sorted(network.ACTIVATIONS))
def test_network_slope_equals_differences(activation):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 3, 7)
    sizes = [3, 4, 2, 3]
    theta = network.flat(network.first_guess(sizes, activation, 1))
    loss = lambda t: network.loss_and_slope(x, y, network.shaped(t, sizes, activation))[0]
    slope = network.loss_and_slope(x, y, network.shaped(theta, sizes, activation))[1]
    nudges = 1e-6 * np.eye(len(theta))
    assert slope == pytest.approx([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in nudges], abs=1e-5)


def test_network_reaches_the_minimum(spark):
    """Without a hidden layer the penalised loss has one minimum, where the slope vanishes."""
    x, y, df = _blobs(spark)
    odd = df.limit(2).withColumn("y", F.lit(None).cast("int")).unionByName(df.limit(2).withColumn("features", F.lit(None).cast("array<double>")))
    rows = df.withColumn("y", F.col("y").cast("int")).select("y", "features").unionByName(odd.select("y", "features"))
    net = network.fit_network(rows.repartition(3), "features", "y", 3, (), "identity", 2.0, tol=1e-5)
    _, slope = network.loss_and_slope(x, y, net)
    penalty = network.flat(network.Network("identity", [2.0 * net.weights[0]], [0.0 * net.biases[0]]))
    assert np.abs(slope + penalty).max() / len(y) <= 1e-5
    scored = rows.select(net.probabilities(F.col("features")).alias("p"), "features").collect()
    assert all((r["p"] is None) == (r["features"] is None) for r in scored)
    with pytest.raises(ValueError, match="no rows"):
        network.fit_network(rows.filter("false"), "features", "y", 3)


def test_elm_grid_equals_single_fits(spark):
    x, y, df = _blobs(spark)
    train, valid = df.filter("row_id % 4 <> 0"), df.filter("row_id % 4 = 0")
    grid = [
        {"hidden_units": [5, 9], "activation_function": ["tanh"], "C": [0, 1], "random_type": ["uniform"], "solver": ["no_re"]},
        {"hidden_units": [5], "activation_function": ["relu"], "C": [0, 3], "random_type": ["normal"], "solver": ["solution1", "solution2"]},
    ]
    combos = combinations(grid)
    found = elm.grid_accuracy(train, valid, combos, "features", "y", 3)
    assert list(sorted(found)) == list(range(1, len(combos) + 1))
    for i, p in enumerate(combos, start=1):
        if p["solver"] != "no_re" and p["C"] == 0:
            assert found[i] is None
            continue
        model = elm.fit_elm(train, "features", "y", 3, p["hidden_units"], p["activation_function"], p["C"], p["random_type"], p["solver"])
        rows = valid.select("y", argmax_index(model.scores(F.col("features"))).alias("p")).collect()
        assert found[i] == pytest.approx(np.mean([r["y"] == r["p"] for r in rows]))


def test_array_helpers(spark):
    row = spark.range(1).select(
        softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
        argmax_index(F.array(F.lit(0.5), F.lit(0.5))).alias("a"),
        top_entries(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), 2).alias("t"),
        mean_of_arrays([F.array(F.lit(0.3), F.lit(0.7))] * 4).alias("m"),
    ).first()
    assert row.s == [0.5, 0.5] and row.a == 0
    assert [e["index"] for e in row.t] == [1, 2]
    assert row.m == pytest.approx([0.3, 0.7])


def test_platt_equals_direct_minimum(spark):
    rng = np.random.default_rng(4)
    s = np.round(rng.random(400), 3)
    y = (rng.random(400) < 1 / (1 + np.exp(-6 * (s - 0.4)))).astype(int)
    rows = [(1, 0, float(a), int(b)) for a, b in zip(s, y)]
    scores = spark.createDataFrame(rows, "fold int, class int, score double, pos int").groupBy("fold", "class", "score").agg(
        F.sum("pos").alias("pos"), F.count("*").alias("n"))
    a, b = calibration.platt_parameters(scores)[1, 0]
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    p = 1 / (1 + np.exp(a * s + b))
    # at the minimum both derivatives vanish
    assert abs(((t - p) * s).sum()) < 1e-5 and abs((t - p).sum()) < 1e-5
    assert a < 0


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_probabilities(spark, method):
    _, _, df = _blobs(spark)
    df = df.withColumn("fold", (F.pmod(F.floor(F.col("row_id") / 3), F.lit(3)) + 1).cast("int")).cache()
    fit = lambda part: models.fit_model("RandomForest", part, "y", 3, {"n_estimators": 5, "max_depth": 3})
    model = calibration.calibrate(df, fit, "y", 3, "fold", 3, method)
    rows = model.score(df).select("y", "proba").collect()
    assert all(sum(r["proba"]) == pytest.approx(1.0) for r in rows)
    assert np.mean([np.argmax(r["proba"]) == r["y"] for r in rows]) > 0.8
    with pytest.raises(ValueError):
        calibration.calibrate(df, fit, "y", 3, "fold", 3, "other")


def _game(x):
    return np.column_stack([x[:, 0] * x[:, 1] + np.sin(x[:, 2]), np.maximum(x[:, 0], x[:, 3])])


def _brute_shapley(x, points, weights, f):
    m = x.shape[1]
    w = weights / weights.sum()

    def value(row, members):
        mixed = points.copy()
        mixed[:, list(members)] = row[list(members)]
        return w @ f(mixed)

    out = np.zeros((len(x), m, 2))
    for r, row in enumerate(x):
        for j in range(m):
            rest = [i for i in range(m) if i != j]
            for s in range(m):
                for members in itertools.combinations(rest, s):
                    share = factorial(s) * factorial(m - s - 1) / factorial(m)
                    out[r, j] += share * (value(row, (*members, j)) - value(row, members))
    return out


def test_shapley_values_are_exact(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(12, 4)), 1)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    background = explain.background_points(df, names)
    points = np.array([[r[n] for n in names] for r in background.collect()])
    weights = np.array([r["weight"] for r in background.collect()], dtype=float)
    expected = _brute_shapley(x, points, weights, _game)
    for per_piece in (2000, 5):
        rows = explain.kernel_shap(
            df, "id", names, background, _game, 2, points_per_piece=per_piece, rows_per_piece=4
        ).collect()
        assert len(rows) == 12 * 4 * 2
        for r in rows:
            assert r["phi"] == pytest.approx(expected[r["id"], names.index(r["feature"]), r["class"]], abs=1e-9)


def test_sampled_coalitions_keep_the_sum(spark):
    masks, weights = explain.coalitions(13, n_samples=300)
    assert len(masks) == len(weights) <= 300 and not masks.all(axis=1).any() and masks.any(axis=1).all()
    project = explain.projector(masks, weights)
    v = np.random.default_rng(0).normal(size=len(masks) + 1)
    assert (project @ v).sum() == pytest.approx(v[-1])
    # an additive game is recovered exactly from any sample
    w = np.arange(13.0)
    assert project @ np.append(masks @ w, w.sum()) == pytest.approx(w, abs=1e-8)


def test_ensemble_of_equal_members_is_itself(spark):
    _, _, df = _blobs(spark, n=30)
    one = models.fit_model("RandomForest", df, "y", 3, {"n_estimators": 5})
    both = models.ensemble_of({n: one for n in models.MODEL_NAMES}, 3).score(one.score(df, "single"), "mean")
    for r in both.collect():
        assert r["mean"] == pytest.approx(r["single"])
    assert json.dumps(one.params)


def _direct_pooling(score, pos, n):
    """Least squares under rising values, by the largest lower and smallest upper mean."""
    order = np.argsort(score)
    p, w = np.cumsum(np.r_[0, pos[order]]), np.cumsum(np.r_[0, n[order]])
    fit = [
        max(min((p[b + 1] - p[a]) / (w[b + 1] - w[a]) for b in range(i, len(order))) for a in range(i + 1))
        for i in range(len(order))
    ]
    return score[order], np.array(fit)


def test_isotonic_curves_equal_direct_pooling(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for fold, label, size in ((1, 0, 90), (1, 1, 1), (2, 0, 60), (2, 2, 40)):
        score, n = rng.permutation(size) / 128, rng.integers(1, 5, size)
        pos = rng.binomial(n, np.clip(score if label != 2 else 1 - score, 0, 1))
        want[fold, label] = _direct_pooling(score, pos, n)
        rows += [(fold, label, float(s), int(a), int(b)) for s, a, b in zip(score, pos, n)]
    rows += [(3, 0, None, 1, 2)]
    df = spark.createDataFrame(rows, "fold int, class int, score double, pos long, n long")
    found = calibration.isotonic_curves(df.repartition(3))
    assert set(found) == set(want)
    for group, (score, fit) in want.items():
        curve = found[group]
        assert curve.at(score) == pytest.approx(fit)
        assert curve.at(np.array([-5.0, 5.0])) == pytest.approx([fit[0], fit[-1]])
        assert len(curve.scores) <= 2 * len(set(fit.round(12)))
    assert calibration.isotonic_curves(df.filter("false")) == {}


def test_boosting_rows_stay_arrow_columns(spark):
    """Scores and what is left over come from matrices over Arrow's own memory, without an object per row."""
    rows = [([float(i), float(-i)], i % 3, [0.1 * i, 0.0, -0.2]) for i in range(50)]
    df = spark.createDataFrame(rows, "x array<double>, y int, s array<double>").repartition(3)
    tree = lambda at, v: boosting.Tree(
        np.array([0, 0, 0]), np.array([at, np.inf, np.inf]), np.array([1, 1, 2]), np.array([2, 1, 2]), np.array([0.0, v, -v])
    )
    trees = [tree(10.0, 1.0), tree(20.0, 2.0), tree(49.0, 3.0)]
    stepped = boosting._stepped(df, trees)
    assert "MapInArrow" in stepped._jdf.queryExecution().executedPlan().toString()
    for r in stepped.collect():
        i = int(r.x[0])
        s = np.array([0.1 * i, 0.0, -0.2]) + [1.0 if i <= 10 else -1.0, 2.0 if i <= 20 else -2.0, 3.0]
        p = np.exp(s) / np.exp(s).sum()
        assert (r.x, r.y) == ([i, -i], i % 3)
        assert r.s == pytest.approx(s) and r.r == pytest.approx(np.eye(3)[i % 3] - p)
    sums, loss = boosting.leaf_sums(stepped, trees)
    kept = stepped.collect()
    assert loss == pytest.approx(-np.mean([np.log(np.exp(r.s) / np.exp(r.s).sum())[r.y] for r in kept]))
    assert set(sums) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)}
    assert sums[0, 1][0] == pytest.approx(sum(r.r[0] for r in kept if r.x[0] <= 10))
