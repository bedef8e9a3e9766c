"""Evaluation tables, rankings and Pareto tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog.base import (
    PRED_SQL,
    PRIORITY,
    PROBA_SQL,
    STATUS,
    predictions,
    probabilities,
    probability_arrays,
    query,
    r,
    table,
)
from tablemill.functions.vectors import (
    activation,
    argmax_index,
    label_at,
    softmax,
)
from tablemill.operators import elm, metrics, ranking
from tablemill.operators.models import ensemble_proba
from tablemill.sources.sinks import model_columns, predictions_table

K = len(PRIORITY)

# Per (by, class) tallies and scores; {by} is a column list.
def _class_sql(by: str) -> str:
    keys = ", ".join(f"g.{b.strip()}" for b in by.split(","))
    match = " AND ".join(f"p.{b.strip()} = g.{b.strip()}" for b in by.split(","))
    return (
        f"cls AS (SELECT {keys}, c.class, count(*) FILTER (WHERE y_true = c.class AND y_pred = c.class) AS tp, "
        "count(*) FILTER (WHERE y_true <> c.class AND y_pred = c.class) AS fp, "
        "count(*) FILTER (WHERE y_true = c.class AND y_pred <> c.class) AS fn "
        f"FROM (SELECT DISTINCT {by} FROM preds) g CROSS JOIN (SELECT unnest(range({K}))::INTEGER AS class) c "
        f"JOIN preds p ON {match} GROUP BY {keys}, c.class), "
        "sc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
        "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM cls)"
    )


def _summary_sql(by: str, total: str) -> str:
    return (
        f"SELECT {by}, round(sum(tp) / sum(support), 8) AS accuracy, "
        + ", ".join(
            f"round(avg({m}) FILTER (WHERE tp + fp + fn > 0), 8) AS {m}_macro, "
            f"round(sum({m} * support) / sum(support), 8) AS {m}_weighted"
            for m in ("precision", "recall", "f1")
        )
        + f", sum(support)::BIGINT AS {total} FROM sc GROUP BY {by}"
    )


def _rounded(df, columns, digits=8):
    return df.withColumns({c: r(c, digits) for c in columns})


@query("accuracy",
       f"WITH {PRED_SQL} SELECT fold, model, round(avg((y_true = y_pred)::INT), 8) AS accuracy, count(*) AS n FROM preds GROUP BY 1, 2")
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(predictions(spark, sf_dir), ["fold", "model"]), ["accuracy"])


_CELLS_SQL = (
    f"cells AS (SELECT m.model, a.c AS y_true, b.c AS y_pred, count(p.row_id) AS n FROM (SELECT DISTINCT model FROM preds) m "
    f"CROSS JOIN (SELECT unnest(range({K}))::INTEGER AS c) a CROSS JOIN (SELECT unnest(range({K}))::INTEGER AS c) b "
    "LEFT JOIN preds p ON p.model = m.model AND p.y_true = a.c AND p.y_pred = b.c GROUP BY 1, 2, 3)"
)


@query("confusion_counts", f"WITH {PRED_SQL}, {_CELLS_SQL} SELECT model, y_true, y_pred, n FROM cells")
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(predictions(spark, sf_dir), K, ["model"])


@query("confusion_norm",
       f"WITH {PRED_SQL}, {_CELLS_SQL} SELECT model, y_true, y_pred, n, "
       "round(coalesce(n / nullif(sum(n) OVER (PARTITION BY model, y_true), 0), 0), 8) AS share FROM cells")
def confusion_norm(spark, sf_dir):
    cells = confusion_counts(spark, sf_dir)
    return _rounded(metrics.confusion_norm(cells, ["model"]), ["share"])


@query("confusion_pivot",
       f"WITH {PRED_SQL}, {_CELLS_SQL} SELECT model, ["
       + ", ".join(f"'{p}'" for p in PRIORITY)
       + "][y_true + 1] AS class_name, "
       + ", ".join(f"sum(n) FILTER (WHERE y_pred = {i})::BIGINT AS \"{p}\"" for i, p in enumerate(PRIORITY))
       + " FROM cells GROUP BY 1, 2")
def confusion_pivot(spark, sf_dir):
    return metrics.pivot_confusion(confusion_counts(spark, sf_dir), PRIORITY, "n", ["model"])


@query("prf_classwise",
       f"WITH {PRED_SQL}, {_class_sql('model')} SELECT model, class, tp, fp, fn, round(precision, 8) AS precision, "
       "round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM sc")
def prf_classwise(spark, sf_dir):
    found = metrics.prf_classwise(predictions(spark, sf_dir), K, ["model"])
    return _rounded(found, ["precision", "recall", "f1"])


@query("prf_macro",
       f"WITH {PRED_SQL}, {_class_sql('model')} SELECT model, "
       + ", ".join(f"round(avg({m}) FILTER (WHERE tp + fp + fn > 0), 8) AS {m}_macro" for m in ("precision", "recall", "f1"))
       + " FROM sc GROUP BY 1")
def prf_macro(spark, sf_dir):
    found = metrics.oof_metrics(predictions(spark, sf_dir), K)
    return _rounded(found, [f"{m}_macro" for m in ("precision", "recall", "f1")]).select(
        "model", "precision_macro", "recall_macro", "f1_macro"
    )


@query("prf_weighted",
       f"WITH {PRED_SQL}, {_class_sql('model')} SELECT model, "
       + ", ".join(f"round(sum({m} * support) / sum(support), 8) AS {m}_weighted" for m in ("precision", "recall", "f1"))
       + " FROM sc GROUP BY 1")
def prf_weighted(spark, sf_dir):
    found = metrics.oof_metrics(predictions(spark, sf_dir), K)
    return _rounded(found, [f"{m}_weighted" for m in ("precision", "recall", "f1")]).select(
        "model", "precision_weighted", "recall_weighted", "f1_weighted"
    )


@query("oof_metrics", f"WITH {PRED_SQL}, {_class_sql('model')} {_summary_sql('model', 'n_samples_oof')}")
def oof_metrics(spark, sf_dir):
    return _rounded(metrics.oof_metrics(predictions(spark, sf_dir), K), metrics.METRICS)


@query("fold_metrics", f"WITH {PRED_SQL}, {_class_sql('fold, model')} {_summary_sql('fold, model', 'n_test')}")
def fold_metrics(spark, sf_dir):
    return _rounded(metrics.fold_metrics(predictions(spark, sf_dir), K), metrics.METRICS)


@query("fold_classwise",
       f"WITH {PRED_SQL}, {_class_sql('fold, model')} SELECT fold, model, class, round(precision, 8) AS precision, "
       "round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM sc")
def fold_classwise(spark, sf_dir):
    found = metrics.fold_classwise(predictions(spark, sf_dir), K).drop("tp", "fp", "fn")
    return _rounded(found, ["precision", "recall", "f1"])


@query("metrics_by_level",
       f"WITH {PRED_SQL}, {_class_sql('fold, model')} ({_summary_sql('fold, model', 'n')}) UNION ALL BY NAME "
       f"(WITH {_class_sql('model')} SELECT NULL::INTEGER AS fold, * FROM ({_summary_sql('model', 'n')}))")
def metrics_by_level(spark, sf_dir):
    return _rounded(metrics.metrics_by_level(predictions(spark, sf_dir), K), metrics.METRICS)


def _mean_std_sql(names, digits=8) -> str:
    return ", ".join(
        f"round(avg({m}), {digits}) AS {m}_mean, round(stddev_samp({m}), {digits}) AS {m}_std" for m in names
    )


@query("fold_mean_std",
       f"WITH {PRED_SQL}, {_class_sql('fold, model')}, f AS ({_summary_sql('fold, model', 'n_test')}) SELECT model, "
       f"{_mean_std_sql(metrics.METRICS, 6)}, count(DISTINCT fold) AS n_folds, sum(n_test)::BIGINT AS n_samples_total, "
       + ", ".join(f"format('{{:.4f}} ± {{:.4f}}', avg({m}), stddev_samp({m})) AS {m}_mean_pm_std" for m in metrics.METRICS)
       + " FROM f GROUP BY 1")
def fold_mean_std(spark, sf_dir):
    found = metrics.fold_mean_std(fold_metrics(spark, sf_dir))
    return _rounded(found, [f"{m}_{s}" for m in metrics.METRICS for s in ("mean", "std")], 6)


@query("classwise_mean_std",
       f"WITH {PRED_SQL}, {_class_sql('fold, model')} SELECT model, class, "
       f"{_mean_std_sql(('precision', 'recall', 'f1', 'support'), 6)}, sum(support)::BIGINT AS support_total, "
       + ", ".join(f"format('{{:.4f}} ± {{:.4f}}', avg({m}), stddev_samp({m})) AS {m}_mean_pm_std" for m in ("precision", "recall", "f1"))
       + " FROM sc GROUP BY 1, 2")
def classwise_mean_std(spark, sf_dir):
    found = metrics.classwise_mean_std(metrics.fold_classwise(predictions(spark, sf_dir), K))
    names = [f"{m}_{s}" for m in ("precision", "recall", "f1", "support") for s in ("mean", "std")]
    return _rounded(found, names, 6)


@query("accuracy_summary",
       f"WITH {PRED_SQL}, a AS (SELECT fold, model, avg((y_true = y_pred)::INT) AS v FROM preds WHERE model <> 'MLP' OR fold = 3 GROUP BY 1, 2) "
       "SELECT model, count(*) AS n, round(avg(v), 8) AS mean, round(coalesce(stddev_samp(v), 0), 8) AS std, "
       "string_agg(fold || '=' || printf('%.5f', v), '; ' ORDER BY fold) AS per_fold FROM a GROUP BY 1")
def accuracy_summary(spark, sf_dir):
    """One model has a number in a single fold and text in the others."""
    values = metrics.accuracy(predictions(spark, sf_dir), ["fold", "model"]).select(
        "fold",
        "model",
        F.when((F.col("model") == "MLP") & (F.col("fold") != 3), F.lit("failed"))
        .otherwise(F.col("accuracy").cast("string"))
        .alias("accuracy"),
    )
    found = metrics.accuracy_summary(values)
    shown = F.transform(
        F.map_entries("per_fold"),
        lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.format_string("%.5f", e["value"])),
    )
    return _rounded(found, ["mean", "std"]).withColumn("per_fold", F.array_join(shown, "; "))


_OVR_SQL = (
    "ovr AS (SELECT model, 0 AS class, p0 AS score, (y_true = 0)::INT AS pos FROM proba UNION ALL "
    "SELECT model, 1, p1, (y_true = 1)::INT FROM proba UNION ALL SELECT model, 2, p2, (y_true = 2)::INT FROM proba)"
)


@query("roc_points",
       f"WITH {PROBA_SQL}, {_OVR_SQL}, s AS (SELECT model, class, score, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM ovr GROUP BY 1, 2, 3) "
       "SELECT model, class, round(score, 12) AS score, round(sum(neg) OVER w / sum(neg) OVER g, 8) AS fpr, round(sum(pos) OVER w / sum(pos) OVER g, 8) AS tpr "
       "FROM s WINDOW w AS (PARTITION BY model, class ORDER BY score DESC), g AS (PARTITION BY model, class)")
def roc_points(spark, sf_dir):
    points = metrics.roc_points(probabilities(spark, sf_dir), 3, ["model"])
    return _rounded(points.select("model", "class", r("score", 12).alias("score"), "fpr", "tpr"), ["fpr", "tpr"])


@query("auc_ovr",
       f"WITH {PROBA_SQL}, {_OVR_SQL}, k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0 AS rk FROM ovr "
       "WINDOW w AS (PARTITION BY model, class ORDER BY score)) "
       "SELECT model, class, round((sum(rk * pos)::DOUBLE - sum(pos)::DOUBLE * (sum(pos) + 1) / 2) / (sum(pos)::DOUBLE * (count(*) - sum(pos))), 8) AS auc, "
       "sum(pos)::BIGINT AS support_pos FROM k GROUP BY 1, 2")
def auc_ovr(spark, sf_dir):
    """Checked against average ranks, a different route to the same area."""
    return _rounded(metrics.auc_ovr(probabilities(spark, sf_dir), 3, ["model"]), ["auc"])


_KNOWN = ["Fluorita", "Mixed", "Spinel"]
# Order priority -> label text as found in a foreign sheet.
_FOREIGN = {"1-URGENT": " Fluorite", "2-HIGH": "Mixed ", "3-MEDIUM": "Bixbyite", "4-NOT SPECIFIED": None, "5-LOW": "Spinel"}


def _external_rows(spark, sf_dir):
    code = F.col("o_orderpriority")
    truth = None
    for k, v in _FOREIGN.items():
        value = F.lit(v).cast("string")
        truth = F.when(code == k, value) if truth is None else truth.when(code == k, value)
    status = F.col("o_orderstatus")
    guess = F.when(status == "F", "Fluorita").when(status == "O", "Mixed").otherwise("Spinel")
    return table(spark, sf_dir, "orders").select(truth.alias("truth_text"), guess.alias("guess_text"))


def _external(spark, sf_dir):
    return metrics.eval_external(_external_rows(spark, sf_dir), "truth_text", "guess_text", _KNOWN)


@query("eval_external",
       "SELECT count(*) AS n_rows_total, count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS n_rows_with_label, "
       "count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS n_rows_missing_label, "
       "count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS n_rows_unknown_label, "
       "count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) AS n_rows_evaluated, "
       "'Bixbyite' AS unknown_labels_preview, 'ok' AS status FROM orders")
def eval_external(spark, sf_dir):
    return _external(spark, sf_dir)[0].drop("reason")


@query("eval_external_reasons",
       "WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS l, "
       "count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) AS e FROM orders) "
       "SELECT 'absent' AS kind, n AS n_rows_total, 0 AS n_rows_with_label, 0 AS n_rows_evaluated, 'skipped' AS status, 'no column nothing' AS reason FROM n "
       "UNION ALL SELECT 'empty', n, 0, 0, 'skipped', 'no label in empty_text' FROM n "
       "UNION ALL SELECT 'unknown', n, n, 0, 'skipped', 'no known class in unknown_text' FROM n "
       "UNION ALL SELECT 'known', n, l, e, 'ok', '' FROM n")
def eval_external_reasons(spark, sf_dir):
    """Labels that are absent, all empty, of no known class, and as they should be."""
    rows = _external_rows(spark, sf_dir).withColumns(
        {"empty_text": F.lit(None).cast("string"), "unknown_text": F.concat(F.lit("Other "), "guess_text")}
    )
    labels = {"absent": "nothing", "empty": "empty_text", "unknown": "unknown_text", "known": "truth_text"}
    facts = [
        metrics.eval_external(rows, label, "guess_text", _KNOWN)[0].select(
            F.lit(kind).alias("kind"), "n_rows_total", "n_rows_with_label", "n_rows_evaluated", "status",
            F.coalesce("reason", F.lit("")).alias("reason"),
        )
        for kind, label in labels.items()
    ]
    return reduce(DataFrame.unionByName, facts)


@query("eval_external_metrics",
       "WITH p AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS y_true, "
       "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_pred FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')), "
       "c AS (SELECT k AS class, count(*) FILTER (WHERE y_true = k AND y_pred = k) AS tp, count(*) FILTER (WHERE y_true <> k AND y_pred = k) AS fp, "
       "count(*) FILTER (WHERE y_true = k AND y_pred <> k) AS fn FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1) "
       "SELECT class, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, "
       "round(2 * tp / (2 * tp + fp + fn), 8) AS f1, tp + fn AS support FROM c")
def eval_external_metrics(spark, sf_dir):
    classwise = _external(spark, sf_dir)[2]
    return _rounded(classwise.select("class", "precision", "recall", "f1", "support"), ["precision", "recall", "f1"])


@query("class_order_firstseen",
       "SELECT o_orderpriority AS name, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS class_order FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def class_order_firstseen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("model")
    )
    found = metrics.class_order_firstseen(rows, "name", "position", "model", "P")
    return found.withColumn("class_order", F.col("class_order").cast("long"))


# --- scores and probabilities ---------------------------------------------------------


@query("elm_activation",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-x)), 8) AS sigmoid, greatest(x, 0) AS relu, round(sin(x), 8) AS sin, "
       "round(tanh(x), 8) AS tanh, round(greatest(x, 0) + 0.1::DOUBLE * least(x, 0), 8) AS leaky_relu FROM "
       "(SELECT *, l_quantity - 25 AS x FROM lineitem)")
def elm_activation(spark, sf_dir):
    x = F.col("l_quantity") - 25
    names = ["sigmoid", "relu", "sin", "tanh", "leaky_relu"]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r(activation(n, x), 8).alias(n) for n in names]
    )


@query("softmax",
       "SELECT o_orderkey, " + ", ".join(f"round(e{i} / (e0 + e1 + e2), 8) AS s{i}" for i in range(3))
       + " FROM (SELECT o_orderkey, exp((o_custkey % 7)::DOUBLE) AS e0, exp((o_orderkey % 5)::DOUBLE) AS e1, exp(o_totalprice / 100000) AS e2 FROM orders)")
def softmax_(spark, sf_dir):
    z = F.array(
        F.pmod("o_custkey", F.lit(7)).cast("double"),
        F.pmod("o_orderkey", F.lit(5)).cast("double"),
        F.col("o_totalprice") / 100000,
    )
    s = table(spark, sf_dir, "orders").select("o_orderkey", softmax(z).alias("s"))
    return s.select("o_orderkey", *[r(F.get("s", F.lit(i)), 8).alias(f"s{i}") for i in range(3)])


def _three_models(spark, sf_dir):
    """Probability arrays and a label per row."""
    return probability_arrays(spark, sf_dir).withColumn("e", F.pmod("row_id", F.lit(3)).cast("int"))


_ENS_SQL = (
    "three AS (SELECT t.row_id, t.p0 AS a0, t.p1 AS a1, t.p2 AS a2, u.p0 AS b0, u.p1 AS b1, u.p2 AS b2, t.row_id % 3 AS e "
    "FROM proba t JOIN proba u ON t.row_id = u.row_id AND t.model = 'RandomForest' AND u.model = 'Ensemble'), "
    "ens AS (SELECT row_id, " + ", ".join(f"(a{i} + b{i} + a{i} + (e = {i})::INT) / 4 AS p{i}" for i in range(3)) + " FROM three)"
)


@query("ensemble_proba",
       f"WITH {PROBA_SQL}, {_ENS_SQL} SELECT row_id, " + ", ".join(f"round(p{i}, 12) AS p{i}" for i in range(3)) + " FROM ens")
def ensemble_proba_(spark, sf_dir):
    rows = _three_models(spark, sf_dir)
    p = ensemble_proba(F.col("tied"), F.col("smooth"), F.col("tied"), F.col("e"), 3)
    found = rows.select("row_id", p.alias("p"))
    return found.select("row_id", *[r(F.get("p", F.lit(i)), 12).alias(f"p{i}") for i in range(3)])


_ARG_SQL = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("argmax_label",
       f"WITH {PROBA_SQL} SELECT row_id, model, {_ARG_SQL} AS y_idx, ['F', 'O', 'P'][{_ARG_SQL} + 1] AS y_label FROM proba")
def argmax_label(spark, sf_dir):
    index = argmax_index(F.col("proba"))
    return probabilities(spark, sf_dir).select(
        "row_id", "model", index.alias("y_idx"), label_at(index, STATUS).alias("y_label")
    )


@query("pmax", f"WITH {PROBA_SQL} SELECT row_id, model, round(greatest(p0, p1, p2), 12) AS pmax FROM proba")
def pmax(spark, sf_dir):
    return probabilities(spark, sf_dir).select("row_id", "model", r(F.array_max("proba"), 12).alias("pmax"))


_TOP2_SQL = (
    "tops AS (SELECT row_id, model, p0, p1, p2, list_sort([(-p0, 0, 'F'), (-p1, 1, 'O'), (-p2, 2, 'P')]) AS t FROM proba), "
    "top2 AS (SELECT row_id, model, p0, p1, p2, t[1][3] AS phase_top1, -t[1][1] AS proba_top1, t[2][3] AS phase_top2, -t[2][1] AS proba_top2 FROM tops)"
)


@query("top2",
       f"WITH {PROBA_SQL}, {_TOP2_SQL} SELECT row_id, model, phase_top1, round(proba_top1, 12) AS proba_top1, phase_top2, round(proba_top2, 12) AS proba_top2 FROM top2")
def top2(spark, sf_dir):
    found = predictions_table(probabilities(spark, sf_dir), ["row_id", "model"], STATUS)
    return _rounded(found, ["proba_top1", "proba_top2"], 12)


_WIDE_MODELS = ["RandomForest", "Ensemble"]


def _wide_sql(m: str) -> str:
    return (
        f"(SELECT row_id, ['F', 'O', 'P'][{_ARG_SQL} + 1] AS \"pred_{m}\", {_ARG_SQL} AS \"pred_{m}_idx\", "
        f"round(greatest(p0, p1, p2), 12) AS \"pred_{m}_pmax\", round(p0, 12) AS \"proba_{m}_F\", "
        f"round(p1, 12) AS \"proba_{m}_O\", round(p2, 12) AS \"proba_{m}_P\" FROM proba WHERE model = '{m}')"
    )


@query("sink_preds_columns",
       f"WITH {PROBA_SQL} SELECT * FROM {_wide_sql('RandomForest')} JOIN {_wide_sql('Ensemble')} USING (row_id)")
def sink_preds_columns(spark, sf_dir):
    """The wide output form: label, index, largest probability and all probabilities of every model."""
    rows = probabilities(spark, sf_dir).groupBy("row_id").pivot("model", _WIDE_MODELS).agg(F.first("proba"))
    found = rows.select("row_id", *[c for m in _WIDE_MODELS for c in model_columns(m, F.col(m), STATUS, full=True)])
    return _rounded(found, [c for c in found.columns if c.startswith("proba_") or c.endswith("pmax")], 12)


@query("elm_score",
       f"WITH {PRED_SQL} SELECT model, round(avg((y_true = y_pred)::INT), 8) AS accuracy, "
       "round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 8) AS rmse FROM preds GROUP BY 1")
def elm_score(spark, sf_dir):
    """Accuracy for labels, root mean square error for values."""
    found = elm.elm_score(predictions(spark, sf_dir), "y_true", "y_pred", ["model"])
    return _rounded(found, ["accuracy", "rmse"])


# --- Pareto and rankings --------------------------------------------------------------

_COUNTS_SQL = (
    "counts AS (SELECT l_partkey AS element, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey "
    "WHERE p_type NOT IN ('SMALL', 'PROMO') GROUP BY 1), par AS (SELECT element, n, sum(n) OVER (ORDER BY n DESC, element)::BIGINT AS cumulative, "
    "100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, element) / sum(n) OVER () AS cumulative_pct FROM counts)"
)


def _element_counts(spark, sf_dir):
    """Counts per element after leaving out two kinds, joined once per distinct element."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("element")).agg(F.count(F.lit(1)).alias("n"))
    kept = (
        table(spark, sf_dir, "part")
        .filter(~F.col("p_type").isin("SMALL", "PROMO"))
        .select(F.col("p_partkey").alias("element"))
    )
    return counts.join(kept, "element", "left_semi")


@query("pareto", f"WITH {_COUNTS_SQL} SELECT element, n, cumulative, round(cumulative_pct, 8) AS cumulative_pct FROM par")
def pareto(spark, sf_dir):
    return _rounded(ranking.pareto(_element_counts(spark, sf_dir), "element"), ["cumulative_pct"])


@query("pareto_cut",
       f"WITH {_COUNTS_SQL} SELECT element, n, cumulative, round(cumulative_pct, 8) AS cumulative_pct FROM par WHERE cumulative_pct <= 80")
def pareto_cut(spark, sf_dir):
    table_ = ranking.pareto(_element_counts(spark, sf_dir), "element")
    return _rounded(ranking.pareto_cut(table_), ["cumulative_pct"])


def _scores(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_tax").alias("s"), F.count(F.lit(1)).alias("c")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        lines.join(parts, "l_partkey")
        .groupBy(F.col("p_brand").alias("feature"))
        .agg(r(F.sum("s") / F.sum("c"), 8).alias("value"), F.sum("c").alias("n"))
    )


_SCORES_SQL = "sc AS (SELECT p_brand AS feature, round(avg(l_tax), 8) AS value, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@query("rank_desc", f"WITH {_SCORES_SQL} SELECT feature, value, row_number() OVER (ORDER BY value DESC, feature) AS rank FROM sc")
def rank_desc(spark, sf_dir):
    found = ranking.rank_desc(_scores(spark, sf_dir).drop("n"), "value", "feature")
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("topk_features",
       f"WITH {_SCORES_SQL} SELECT feature, value, row_number() OVER (ORDER BY value DESC, feature) AS rank FROM sc QUALIFY rank <= 5")
def topk_features(spark, sf_dir):
    found = ranking.topk_features(_scores(spark, sf_dir).drop("n"), "value", "feature", 5)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("sort_counts", f"WITH {_SCORES_SQL} SELECT feature, n FROM sc ORDER BY n DESC, feature")
def sort_counts(spark, sf_dir):
    return ranking.sort_counts(_scores(spark, sf_dir).select("feature", "n"), "feature")
