"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.base import FEAT_SQL, FEATURES, feature_table, query, r, table
from tablemill.operators import permutation, prep, selection
from tablemill.operators.permutation import PRIME, ROUNDS
from tablemill.session import materialize

FEW = ["qty_soma", "price_soma", "disc_media", "tax_maximo", "size_minimo", "retail_media"]


def _pairs_sql(names: list[str], source: str, digits: int) -> str:
    rows = [
        f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_i, '{b}' AS feature_j, "
        f"round(abs(corr({a}, {b})), {digits}) AS r FROM {source}"
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i < j
    ]
    return " UNION ALL ".join(rows)


def _holes(df):
    """Missing cells of different rows in different columns."""
    gap = {c: n for c, n in zip(FEW, (3, 5, 7, 11, 13, 17))}
    return df.select(*[F.when(F.pmod("row_id", F.lit(n)) != 0, F.col(c)).alias(c) for c, n in gap.items()])


_HOLES_SQL = "holes AS (SELECT " + ", ".join(
    f"CASE WHEN row_id % {n} <> 0 THEN {c} END AS {c}" for c, n in zip(FEW, (3, 5, 7, 11, 13, 17))
) + " FROM feat)"


@query("pearson_matrix",
       f"WITH {FEAT_SQL}, {_HOLES_SQL}, p AS ({_pairs_sql(FEW, 'holes', 6)}) "
       "SELECT feature_i, feature_j, r FROM p UNION ALL SELECT feature_j, feature_i, r FROM p")
def pearson_matrix(spark, sf_dir):
    pairs = selection.pearson_pairs(_holes(feature_table(spark, sf_dir)), FEW)
    return selection.pearson_matrix(pairs).withColumn("r", r("r"))


@query("pearson_matrix_wide", f"WITH {FEAT_SQL} {_pairs_sql(FEATURES, 'feat', 5)}")
def pearson_matrix_wide(spark, sf_dir):
    """All pairs of a wide table from matrix products per partition."""
    wide = materialize(feature_table(spark, sf_dir), "wide")
    return selection.pearson_pairs(wide, FEATURES).withColumn("r", r("r", 5))


_FILLED = "filled AS (SELECT " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM feat)) AS {c}" for c in FEATURES) + " FROM feat)"


@query("pearson_filter",
       f"WITH {FEAT_SQL}, {_FILLED}, p AS ({_pairs_sql(FEATURES, 'filled', 9)}), "
       "names AS (SELECT unnest(range(30)) AS position, unnest(["
       + ", ".join(f"'{c}'" for c in FEATURES)
       + "]) AS feature) SELECT feature, position::INTEGER AS position FROM names WHERE feature NOT IN "
       "(SELECT feature_j FROM p WHERE r > 0.59)")
def pearson_filter(spark, sf_dir):
    wide = materialize(feature_table(spark, sf_dir), "wide")
    medians, facts = prep.exact_medians(wide, FEATURES), prep.column_facts(wide, FEATURES)
    # the means after imputation follow from the facts before it
    centre = [prep.filled_moments(facts[c], medians[c])[0] for c in FEATURES]
    pairs = selection.pearson_pairs(prep.impute(wide, medians), FEATURES, centre)
    names = spark.createDataFrame(
        [(f, i) for i, f in enumerate(FEATURES)], "feature string, position int"
    )
    return selection.pearson_filter(pairs, names, 0.59)


_RULE_FEATURES = ["cust", "price", "idle"]


def _rule(df):
    """A stated scoring rule over three features, one of which it ignores."""
    hit = (F.col("cust") > 700) & (F.col("price") > 200000)
    return df.withColumn("y_pred", F.when(hit, 2).when(F.col("price") > 90000, 1).otherwise(0))


_RULE_SQL = "CASE WHEN cust > 700 AND price > 200000 THEN 2 WHEN price > 90000 THEN 1 ELSE 0 END"


def _rule_rows(spark, sf_dir):
    """Labels the rule gets right for four rows in five."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("price"),
        F.pmod("o_orderkey", F.lit(11)).alias("idle"),
    )
    label = F.when(F.pmod("row_id", F.lit(5)) == 0, F.pmod(F.col("y_pred") + 1, F.lit(3))).otherwise(F.col("y_pred"))
    return _rule(rows).withColumn("y", label).drop("y_pred")


_REPEATS = 10


def _round_sql(source: str) -> str:
    """The rounds of the permutation over ``source``, which has l, r, a and the keys."""
    for i in range(ROUNDS):
        t = f"((r + u{i}) % {PRIME})"
        source = f"(SELECT * REPLACE (r AS l, (l + ({t} * {t} % {PRIME} * v{i} + w{i}) % {PRIME}) % a AS r) FROM {source})"
    return f"SELECT feature, repeat, d, l * a + r AS x FROM {source}"


def _walk_sql() -> str:
    """Where the value of the row at place d goes: x, once it is below n."""
    rows = [
        f"('{f}', {rep}, {', '.join(str(v) + '::BIGINT' for key in permutation.keys(42, f, rep) for v in key)})"
        for f in _RULE_FEATURES
        for rep in range(_REPEATS)
    ]
    names = ", ".join(f"{c}{i}" for i in range(ROUNDS) for c in "uvw")
    return (
        f"ks(feature, repeat, {names}) AS (VALUES {', '.join(rows)}), "
        "dims AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM rows_), "
        "walk AS ("
        + _round_sql("(SELECT ks.*, rn AS d, rn // a AS l, rn % a AS r, a FROM ranked, ks, dims)")
        + " UNION ALL "
        + _round_sql("(SELECT ks.*, d, x // a AS l, x % a AS r, a FROM walk JOIN ks USING (feature, repeat), dims WHERE x >= n)")
        + ")"
    )


def _permuted_sql() -> str:
    """Per feature and repeat: rows by md5 of id and seed, values sent on by the permutation."""
    parts = []
    for f in _RULE_FEATURES:
        others = ", ".join(f"b.{c}" for c in _RULE_FEATURES if c != f)
        parts.append(
            f"SELECT '{f}' AS feature, repeat, b.y, {others}, s.{f} FROM walk JOIN ranked s ON s.rn = d "
            f"JOIN ranked b ON b.rn = x WHERE feature = '{f}'"
        )
    return " UNION ALL BY NAME ".join(parts)


@query("perm_importance",
       "WITH RECURSIVE raw AS (SELECT o_orderkey AS row_id, o_custkey AS cust, o_totalprice AS price, o_orderkey % 11 AS idle FROM orders), "
       f"ruled AS (SELECT *, {_RULE_SQL} AS guess FROM raw), "
       "rows_ AS (SELECT * EXCLUDE (guess), CASE WHEN row_id % 5 = 0 THEN (guess + 1) % 3 ELSE guess END AS y FROM ruled), "
       "ranked AS (SELECT *, row_number() OVER (ORDER BY md5(row_id || '-42'), row_id) - 1 AS rn FROM rows_), "
       f"{_walk_sql()}, moved AS ({_permuted_sql()}), "
       f"acc AS (SELECT feature, repeat, avg(({_RULE_SQL} = y)::INT) AS a FROM moved GROUP BY 1, 2), "
       f"base AS (SELECT avg(({_RULE_SQL} = y)::INT) AS baseline FROM rows_) "
       "SELECT feature, round(baseline - avg(a), 8) + 0.0 AS importance, round(baseline, 8) AS baseline FROM acc, base GROUP BY feature, baseline")
def perm_importance(spark, sf_dir):
    found = selection.perm_importance(
        _rule_rows(spark, sf_dir), "row_id", "y", _RULE_FEATURES, _rule, repeats=_REPEATS, seed=42
    )
    return found.select("feature", r("importance", 8).alias("importance"), r("baseline", 8).alias("baseline"))


def _importances(spark, sf_dir):
    """(fold, feature, importance): brands by line number; some are absent from some folds."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_tax", "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return (
        lines.join(parts, "l_partkey")
        .filter((F.col("p_size") + F.col("l_linenumber")) % 9 < 7)
        .groupBy(F.col("l_linenumber").alias("fold"), F.col("p_brand").alias("feature"))
        .agg((F.avg("l_tax") - F.avg("l_discount")).alias("importance"))
    )


_IMP_SQL = ("imp AS (SELECT l_linenumber AS fold, p_brand AS feature, avg(l_tax) - avg(l_discount) AS importance "
            "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size + l_linenumber) % 9 < 7 GROUP BY 1, 2), "
            "agg AS (SELECT feature, avg(importance) AS importance, count(*) / 7.0::DOUBLE AS presence FROM imp GROUP BY 1)")


@query("pfi_aggregate",
       f"WITH {_IMP_SQL} SELECT feature, round(importance, 8) AS importance, round(presence, 6) AS presence FROM agg")
def pfi_aggregate(spark, sf_dir):
    found = selection.pfi_aggregate(_importances(spark, sf_dir), 7)
    return found.select("feature", r("importance", 8).alias("importance"), r("presence").alias("presence"))


@query("pick_topk",
       f"WITH {_IMP_SQL}, ok AS (SELECT DISTINCT p_brand AS feature FROM part WHERE p_brand <> 'Brand#3' AND p_brand <> 'Brand#5') "
       "SELECT feature, round(importance, 8) AS importance, "
       "row_number() OVER (ORDER BY round(importance, 10) DESC, presence DESC, feature) AS rank "
       "FROM agg WHERE feature IN (SELECT feature FROM ok) QUALIFY rank <= 10")
def pick_topk(spark, sf_dir):
    scores = selection.pfi_aggregate(_importances(spark, sf_dir), 7).withColumn("importance", r("importance", 10))
    available = (
        table(spark, sf_dir, "part")
        .filter(~F.col("p_brand").isin("Brand#3", "Brand#5"))
        .groupBy(F.col("p_brand").alias("feature"))
        .agg(F.min("p_partkey").alias("position"))
    )
    chosen = selection.pick_topk(scores, available, 10)
    return chosen.select("feature", r("importance", 8).alias("importance"), F.col("rank").cast("long").alias("rank"))


def _selected(spark, sf_dir):
    """(fold, model, features): brands with a large enough mean discount."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag", "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    means = (
        lines.join(parts, "l_partkey")
        .groupBy(F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("model"), "p_brand")
        .agg(F.round(F.avg("l_discount"), 8).alias("d"))
        .filter("d > 0.05")
    )
    return means.groupBy("fold", "model").agg(F.sort_array(F.collect_set("p_brand")).alias("features"))


_SEL_SQL = ("sel AS (SELECT l_linenumber AS fold, l_returnflag AS model, p_brand AS feature FROM lineitem "
            "JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3 HAVING round(avg(l_discount), 8) > 0.05)")


@query("feature_presence",
       f"WITH {_SEL_SQL} SELECT model, feature, count(*) AS n FROM sel GROUP BY GROUPING SETS ((model, feature), (feature))")
def feature_presence(spark, sf_dir):
    counts = selection.feature_presence(_selected(spark, sf_dir))
    return counts.select("model", "feature", "n")


@query("stable_features",
       f"WITH {_SEL_SQL} SELECT feature, count(DISTINCT fold) AS n FROM sel GROUP BY 1 HAVING count(DISTINCT fold) >= 4")
def stable_features(spark, sf_dir):
    """Over the selections of all models; a fold counts once."""
    chosen = _selected(spark, sf_dir).select("fold", F.explode("features").alias("feature"))
    return selection.stable_features(chosen, 7)


@query("feature_set_report",
       f"WITH {_SEL_SQL}, s AS (SELECT feature FROM sel GROUP BY 1 HAVING count(DISTINCT fold) >= 4) "
       "SELECT b.p_brand AS feature, s.feature IS NOT NULL AS kept FROM (SELECT DISTINCT p_brand FROM part) b "
       "LEFT JOIN s ON s.feature = b.p_brand")
def feature_set_report(spark, sf_dir):
    before = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct()
    return selection.feature_set_report(before, stable_features(spark, sf_dir))
