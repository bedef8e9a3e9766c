"""Readers and writers: each query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.base import (
    FEATURES,
    FEAT_SQL,
    PRED_SQL,
    PRIORITY,
    PROBA_SQL,
    STATUS,
    feature_table,
    predictions,
    probabilities,
    query,
    r,
    table,
)
from tablemill.catalog.explain import PHI_SQL, linear_values
from tablemill.catalog.metrics import (
    _CELLS_SQL,
    _TOP2_SQL,
    _class_sql,
    _rounded,
    _summary_sql,
    confusion_norm,
    oof_metrics,
)
from tablemill.operators import explain, metrics, prep
from tablemill.session import materialize, new_path
from tablemill.sources import sinks, tables


@query("src_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def src_table(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )


@query("src_table_formats",
       "SELECT f AS format, o_orderkey, o_totalprice, o_orderpriority FROM orders, (SELECT unnest(['csv', 'json', 'orc']) AS f)")
def src_table_formats(spark, sf_dir):
    """The same table through every other format, dispatched on the file ending."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = None
    for suffix in ("csv", "json", "orc"):
        path = new_path(spark, "formats") + f".{suffix}"
        writer = rows.write.option("header", True)
        getattr(writer, suffix)(path)
        back = tables.read_table(spark, path, rows.schema).withColumn("format", F.lit(suffix))
        out = back if out is None else out.unionByName(back)
    return out


@query("src_bundle",
       f"WITH {FEAT_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 8) AS median FROM feat" for c in FEATURES))
def src_bundle(spark, sf_dir):
    """Fit a bundle, write it as JSON, read it back and list its medians."""
    wide = materialize(feature_table(spark, sf_dir), "wide")
    pre = prep.fit_preprocessing(wide, FEATURES)
    path = new_path(spark, "bundle")
    spark.createDataFrame([(pre.to_json(),)], "value string").coalesce(1).write.text(path)
    bundle = tables.read_bundle(spark, path)
    medians = bundle.select(F.explode("medians").alias("feature", "median"))
    return medians.select("feature", r("median", 8).alias("median"))


@query("src_fold_preds",
       f"WITH {PRED_SQL} SELECT fold, model, count(*) AS n, sum((y_true = y_pred)::INT)::BIGINT AS hits FROM preds GROUP BY 1, 2")
def src_fold_preds(spark, sf_dir):
    """Stored predictions, checked against the rows of each fold."""
    preds = predictions(spark, sf_dir)
    path = new_path(spark, "preds")
    sinks.write_folds(preds, path)
    truth = preds.filter("model = 'MLP'").select("fold", "row_id")
    back = tables.read_fold_predictions(spark, path, truth)
    return back.groupBy("fold", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hits")
    )


_NAMES = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium"}


def _translated(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + f" ELSE {column} END"


@query("src_confusion_csv",
       f"WITH {PRED_SQL}, {_CELLS_SQL}, named AS (SELECT model, ["
       + ", ".join(f"'{p}'" for p in PRIORITY) + "][y_true + 1] AS a, ["
       + ", ".join(f"'{p}'" for p in PRIORITY) + "][y_pred + 1] AS b, "
       "round(coalesce(n / nullif(sum(n) OVER (PARTITION BY model, y_true), 0), 0), 8) AS value FROM cells) "
       f"SELECT model, {_translated('a')} AS class_name, {_translated('b')} AS predicted, value FROM named")
def src_confusion_csv(spark, sf_dir):
    """The matrix of each model, written and read back to long form with translated labels."""
    cells = materialize(confusion_norm(spark, sf_dir), "cells")
    found = None
    for (model,) in cells.select("model").distinct().orderBy("model").collect():
        path = new_path(spark, "confusion")
        sinks.write_metrics(metrics.pivot_confusion(cells.filter(F.col("model") == model), PRIORITY, "share", []), path)
        part = tables.read_confusion_csv(spark, path, _NAMES).select(F.lit(model).alias("model"), "*")
        found = part if found is None else found.unionByName(part)
    return _rounded(found, ["value"])


@query("sink_metrics", f"WITH {PRED_SQL}, {_class_sql('model')} {_summary_sql('model', 'n_samples_oof')}")
def sink_metrics(spark, sf_dir):
    found = oof_metrics(spark, sf_dir)
    path = new_path(spark, "metrics")
    sinks.write_metrics(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


@query("sink_preds",
       f"WITH {PROBA_SQL}, {_TOP2_SQL} SELECT model, row_id, phase_top1, round(proba_top1, 12) AS proba_top1, phase_top2, round(proba_top2, 12) AS proba_top2, "
       "round(p0, 12) AS \"proba_F\", round(p1, 12) AS \"proba_O\", round(p2, 12) AS \"proba_P\" FROM top2")
def sink_preds(spark, sf_dir):
    rows = probabilities(spark, sf_dir)
    found = sinks.predictions_table(rows, ["model", "row_id"], STATUS, write_full_proba=True)
    path = new_path(spark, "scored")
    found.write.parquet(path)
    return _rounded(spark.read.parquet(path), [c for c in found.columns if c.startswith("proba_")], 12)


@query("sink_fold",
       f"WITH {PRED_SQL} SELECT fold, model, count(*) AS n, sum((fold = 2 OR y_true = y_pred)::INT)::BIGINT AS hits FROM preds GROUP BY 1, 2")
def sink_fold(spark, sf_dir):
    """All folds written, then one fold written again: only that one is replaced."""
    preds = predictions(spark, sf_dir)
    path = new_path(spark, "folds")
    sinks.write_folds(preds, path)
    sinks.write_folds(preds.filter("fold = 2").withColumn("y_pred", F.col("y_true")), path)
    return spark.read.parquet(path).groupBy("fold", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hits")
    )


@query("sink_json",
       f"WITH {PRED_SQL} SELECT model, round(avg((y_true = y_pred)::INT), 8) AS accuracy FROM preds GROUP BY 1")
def sink_json(spark, sf_dir):
    """A nested summary written as JSON and opened again."""
    found = metrics.accuracy(predictions(spark, sf_dir), ["model"])
    path = new_path(spark, "summary")
    sinks.write_json(sinks.json_summary(found, "model", r("accuracy", 8).alias("accuracy")), path)
    back = spark.read.schema("summary map<string,double>").json(path)
    return back.select(F.explode("summary").alias("model", "accuracy"))


def _stored_values(spark, sf_dir):
    path = new_path(spark, "shap")
    sinks.write_shap(linear_values(spark, sf_dir), path)
    return tables.read_shap(spark, path)


@query("src_shap",
       f"WITH {PHI_SQL} SELECT class, feature, count(*) AS n, round(max(phi), 6) AS largest FROM phi GROUP BY 1, 2")
def src_shap(spark, sf_dir):
    """Stored attributions by class."""
    return _stored_values(spark, sf_dir).groupBy("class", "feature").agg(
        F.count(F.lit(1)).alias("n"), r(F.max("phi")).alias("largest")
    )


@query("sink_shap",
       f"WITH {PHI_SQL}, m AS (SELECT class, feature, avg(abs(phi)) AS v FROM phi GROUP BY 1, 2), k AS (SELECT feature, avg(v) AS v FROM m GROUP BY 1) "
       "SELECT feature, round(v, 10) AS macro_mean_abs, row_number() OVER (ORDER BY v DESC, feature) AS rank FROM k")
def sink_shap(spark, sf_dir):
    """Attributions written by class, ranked from the stored table."""
    found = explain.macro_rank(explain.mean_abs(_stored_values(spark, sf_dir)))
    return _rounded(found, ["macro_mean_abs"], 10).withColumn("rank", F.col("rank").cast("long"))
