"""Splits, grids, trials and the choice of parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.base import FEATURES, WRONG_EVERY, feature_table, predictions, query, r, table
from tablemill.operators import metrics, splitting, tuning

FOLDS_SQL = (
    "folds AS (SELECT o_orderkey AS row_id, o_orderstatus AS label, ((row_number() OVER (PARTITION BY o_orderstatus "
    "ORDER BY md5(o_orderkey || '-42'), o_orderkey) - 1) % 5 + 1)::INTEGER AS fold FROM orders)"
)


def _dealt(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label")
    )
    return splitting.stratified_kfold(rows, "row_id", "label", 5, 42)


@query("stratified_kfold", f"WITH {FOLDS_SQL} SELECT row_id, label, fold FROM folds")
def stratified_kfold(spark, sf_dir):
    return _dealt(spark, sf_dir)


@query("split_train_test",
       f"WITH {FOLDS_SQL} SELECT label, CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM folds GROUP BY ALL")
def split_train_test(spark, sf_dir):
    train, test = splitting.split_train_test(_dealt(spark, sf_dir), 2)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


@query("class_counts", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def class_counts(spark, sf_dir):
    return splitting.class_counts(
        table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label")), "label"
    )


@query("inner_split_shrink",
       "WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT min(n) AS min_class_count, "
       "CASE WHEN min(n) < 5 THEN greatest(2, min(n)) ELSE 5 END AS inner_splits FROM c")
def inner_split_shrink(spark, sf_dir):
    counts = splitting.class_counts(table(spark, sf_dir, "supplier"), "s_nationkey")
    return splitting.inner_split_count(counts, 5)


def _values(spark, sf_dir, column):
    """A short list of values with their place in the list."""
    return table(spark, sf_dir, "lineitem").select(F.col(column).alias("value")).distinct().withColumn(
        "ord", F.col("value").cast("double")
    )


@query("param_grid",
       "SELECT row_number() OVER (ORDER BY a.v, b.v, c.v) AS trial, a.v::VARCHAR AS value_0, b.v::VARCHAR AS value_1, c.v::VARCHAR AS value_2 "
       "FROM (SELECT DISTINCT l_linenumber AS v FROM lineitem) a, (SELECT DISTINCT l_discount AS v FROM lineitem) b, "
       "(SELECT DISTINCT l_tax AS v FROM lineitem) c")
def param_grid(spark, sf_dir):
    tables = [_values(spark, sf_dir, c) for c in ("l_linenumber", "l_discount", "l_tax")]
    return tuning.grid_of_tables(tables).withColumn("trial", F.col("trial").cast("long"))


@query("param_grid_union",
       "WITH a AS (SELECT row_number() OVER (ORDER BY l, f) AS trial, l, f FROM (SELECT DISTINCT l_linenumber AS l FROM lineitem), "
       "(SELECT DISTINCT l_returnflag AS f FROM lineitem)), b AS (SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY s) AS trial, s "
       "FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem)) SELECT trial, 'line' AS name, l::VARCHAR AS value FROM a "
       "UNION ALL SELECT trial, 'flag', '\"' || f || '\"' FROM a UNION ALL SELECT trial, 'status', '\"' || s || '\"' FROM b")
def param_grid_union(spark, sf_dir):
    """Two grids one after another, values as JSON."""
    # codes of a line: short lists
    listed = lambda c: [x[0] for x in table(spark, sf_dir, "lineitem").select(c).distinct().orderBy(c).collect()]
    grids = [{"line": listed("l_linenumber"), "flag": listed("l_returnflag")}, {"status": listed("l_linestatus")}]
    found = tuning.param_grid(spark, grids)
    return found.select(F.col("trial").cast("long").alias("trial"), F.explode("params").alias("name", "value"))


def _trials(spark, sf_dir):
    """(trial, fold, accuracy): a trial is a line number and a discount; some folds failed."""
    trial = F.col("l_linenumber") * 100 + F.round(F.col("l_discount") * 100).cast("int")
    kind = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(trial.alias("trial"), kind.alias("fold"))
        .agg(F.round(F.avg("l_tax"), 3).alias("accuracy"))
        .withColumn(
            "accuracy",
            F.when(
                (F.pmod("trial", F.lit(4)) != 1) & ((F.pmod("trial", F.lit(3)) != 0) | (F.col("fold") != "A")),
                F.col("accuracy"),
            ),
        )
    )


_TRIAL_SQL = (
    "t AS (SELECT l_linenumber * 100 + round(l_discount * 100)::INTEGER AS trial, l_returnflag AS fold, "
    "round(avg(l_tax), 3) AS a FROM lineitem GROUP BY 1, 2), "
    "u AS (SELECT trial, fold, CASE WHEN trial % 4 <> 1 AND (trial % 3 <> 0 OR fold <> 'A') THEN a END AS accuracy FROM t), "
    "log AS (SELECT trial, avg(accuracy) AS mean_accuracy, count(accuracy) AS n_ok, count(*) - count(accuracy) AS n_failed FROM u GROUP BY 1)"
)


@query("trial_log", f"WITH {_TRIAL_SQL} SELECT trial, round(mean_accuracy, 6) AS mean_accuracy, n_ok, n_failed FROM log")
def trial_log(spark, sf_dir):
    return tuning.trial_log(_trials(spark, sf_dir)).withColumn("mean_accuracy", r("mean_accuracy"))


@query("trial_best",
       f"WITH {_TRIAL_SQL} SELECT trial, round(mean_accuracy, 6) AS mean_accuracy, n_ok, n_failed FROM log WHERE n_ok > 0 "
       "ORDER BY round(mean_accuracy, 6) DESC, trial LIMIT 1")
def trial_best(spark, sf_dir):
    return tuning.best_trial(trial_log(spark, sf_dir))


@query("pending_folds",
       "SELECT DISTINCT (o_custkey % 50)::INTEGER AS fold FROM orders WHERE o_custkey % 50 NOT IN "
       "(SELECT o_custkey % 50 FROM orders WHERE o_totalprice > 499000)")
def pending_folds(spark, sf_dir):
    fold = F.pmod("o_custkey", F.lit(50)).cast("int").alias("fold")
    orders = table(spark, sf_dir, "orders")
    planned = orders.select(fold).distinct()
    return tuning.pending_folds(planned, orders.filter("o_totalprice > 499000").select(fold))


def _fold_params(spark, sf_dir):
    """(fold, model, param, value): values with ties across folds, and the fold accuracies."""
    preds = predictions(spark, sf_dir)
    outer = metrics.accuracy(preds, ["fold", "model"]).select(
        "fold", "model", F.round("accuracy", 6).alias("accuracy")
    )
    wrong = F.create_map(*[F.lit(x) for pair in WRONG_EVERY.items() for x in pair])[F.col("model")]
    params = outer.select(
        "fold",
        "model",
        F.inline(
            F.array(
                F.struct(
                    F.lit("model__depth").alias("param"),
                    F.pmod(F.col("fold") * wrong, F.lit(3)).cast("string").alias("value"),
                ),
                F.struct(
                    F.lit("model__kind").alias("param"),
                    F.when(F.pmod("fold", F.lit(2)) == 0, '"even"')
                    .when(F.col("fold") == 5, '"five"')
                    .otherwise('"odd"')
                    .alias("value"),
                ),
            )
        ),
    )
    return params, outer


_PARAM_SQL = (
    "outer_ AS (SELECT o.fold, m.model, round(avg(CASE WHEN row_id % m.n = 0 THEN 0 ELSE 1 END), 6) AS accuracy, any_value(m.n) AS n "
    "FROM (SELECT o_orderkey AS row_id, (o_custkey % 5 + 1)::INTEGER AS fold FROM orders) o "
    "CROSS JOIN (VALUES " + ", ".join(f"('{m}', {n})" for m, n in WRONG_EVERY.items()) + ") m(model, n) GROUP BY 1, 2), "
    "params AS (SELECT fold, model, 'model__depth' AS param, ((fold * n) % 3)::VARCHAR AS value, accuracy FROM outer_ "
    "UNION ALL SELECT fold, model, 'model__kind', CASE WHEN fold % 2 = 0 THEN '\"even\"' WHEN fold = 5 THEN '\"five\"' ELSE '\"odd\"' END, accuracy FROM outer_), "
    "best AS (SELECT model, param, value AS best_value FROM params QUALIFY row_number() OVER (PARTITION BY model, param ORDER BY accuracy DESC, fold) = 1), "
    "cnt AS (SELECT model, param, value, count(*) AS n_folds, min(fold) AS first_fold FROM params GROUP BY 1, 2, 3), "
    "win AS (SELECT model, param, value, n_folds FROM cnt JOIN best USING (model, param) QUALIFY row_number() OVER "
    "(PARTITION BY model, param ORDER BY n_folds DESC, (value = best_value)::INT DESC, first_fold) = 1)"
)


@query("mode_tiebreak", f"WITH {_PARAM_SQL} SELECT model, param, value, n_folds FROM win")
def mode_tiebreak(spark, sf_dir):
    return tuning.mode_tiebreak(*_fold_params(spark, sf_dir))


@query("final_params", f"WITH {_PARAM_SQL} SELECT model, replace(param, 'model__', '') AS param, value, n_folds FROM win")
def final_params(spark, sf_dir):
    return tuning.final_params(*_fold_params(spark, sf_dir))


@query("dataset_profile",
       "SELECT o_orderstatus AS label, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS n_rows, 30::BIGINT AS n_features, "
       f"'{'; '.join(FEATURES)}' AS feature_names FROM orders GROUP BY 1")
def dataset_profile(spark, sf_dir):
    """Class counts with the size and the feature names of the training table."""
    wide = feature_table(spark, sf_dir)
    names = [c for c in wide.columns if c not in ("row_id", "y")]
    label = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("y") + 1)
    counts = splitting.class_counts(wide.select(label.alias("label")), "label")
    packed = counts.agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("label", "n")).alias("c"))
    return packed.select(
        F.inline("c"),
        "n_rows",
        F.lit(len(names)).cast("long").alias("n_features"),
        F.lit("; ".join(names)).alias("feature_names"),
    )
