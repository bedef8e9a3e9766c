"""Column and row preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.base import FEATURES, FEAT_SQL, STATUS, feature_table, query, r, table
from tablemill.functions.labels import CLASS_ENGLISH, SUFFIX_WORD, to_known_class, translate_feature, translate_label
from tablemill.functions.text import compact_name, fold_name, squeeze_spaces, underscore_name
from tablemill.functions.vectors import one_hot
from tablemill.operators import prep
from tablemill.operators.splitting import encode_labels, label_codes, row_names
from tablemill.session import materialize

# Columns of the feature table the queries below work on, and digits to compare.
COLS = {"qty_soma": 4, "qty_media": 6, "disc_media": 8, "tax_desvio": 8, "size_minimo": 2, "retail_maximo": 2}
NAMES = list(COLS)


def _features(spark, sf_dir):
    return feature_table(spark, sf_dir).select("row_id", "y", *NAMES)


def _orders_named(spark, sf_dir):
    """Orders under the column names of a training sheet."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("Classe"),
        F.col("o_orderpriority").alias("Composto"),
        F.col("o_totalprice").alias("gibbs-oxidos_minimo"),
        F.col("o_custkey").alias("Keq_x"),
        F.col("o_custkey").alias("atomic_en_allen _soma"),
    )


@query("drop_cols_regex", 'SELECT o_orderkey AS row_id, o_orderstatus AS "Classe", o_orderpriority AS "Composto", '
       'o_totalprice AS "gibbs-oxidos_minimo", o_custkey AS "atomic_en_allen _soma" FROM orders')
def drop_cols_regex(spark, sf_dir):
    return prep.drop_matching(_orders_named(spark, sf_dir))


@query("drop_id_cols", 'SELECT o_orderkey AS row_id, o_totalprice AS "gibbs-oxidos_minimo", o_custkey AS "Keq_x", '
       'o_custkey AS "atomic_en_allen _soma" FROM orders')
def drop_id_cols(spark, sf_dir):
    return prep.drop_id_columns(_orders_named(spark, sf_dir))


def _messy(spark, sf_dir):
    """Text cells among numbers: plain, padded, wrong, with a type letter, missing; and NaN."""
    kind = F.pmod("p_size", F.lit(6))
    size = F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, size)
        .when(kind == 1, F.concat(F.lit(" "), size, F.lit(".5 ")))
        .when(kind == 2, F.lit("abc"))
        .when(kind == 3, F.lit("1d"))
        .when(kind == 4, F.concat(size, F.lit("e2")))
    )
    number = F.when(kind == 5, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), number.alias("number"))


@query("coerce_numeric",
       "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE "
       "WHEN 4 THEN p_size * 100.0::DOUBLE END AS text, "
       "CASE WHEN p_size % 6 < 5 THEN p_retailprice END AS number FROM part")
def coerce_numeric(spark, sf_dir):
    return prep.coerce_numeric(_messy(spark, sf_dir), keep=["p_partkey"])


@query("coerce_stats",
       "SELECT 2 * count(*) FILTER (WHERE p_size % 6 = 5) AS nan_before, "
       "2 * count(*) FILTER (WHERE p_size % 6 = 5) + count(*) FILTER (WHERE p_size % 6 IN (2, 3)) AS nan_after, "
       "count(*) FILTER (WHERE p_size % 6 IN (2, 3)) AS nan_added FROM part")
def coerce_stats(spark, sf_dir):
    return prep.coerce_stats(_messy(spark, sf_dir), ["text", "number"])


@query("drop_all_null", "SELECT c_custkey, c_acctbal FROM customer")
def drop_all_null(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_custkey") < 0, 1.0).alias("empty")
    )
    return prep.drop_all_null(rows, ["c_acctbal", "empty"])


@query("align_schema",
       "SELECT o_orderkey AS row_id, NULL::DOUBLE AS absent, o_totalprice AS price, o_custkey AS customer, "
       "'absent' AS missing, 'extra_a, extra_b' AS extra FROM orders")
def align_schema(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("extra_a"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("extra_b"),
    )
    aligned, missing, extra = prep.align_schema(rows, ["absent", "price", "customer"], ["row_id"])
    return aligned.withColumn("missing", F.lit(", ".join(missing))).withColumn("extra", F.lit(", ".join(extra)))


@query("rename_alias",
       'SELECT o_orderkey AS row_id, o_totalprice AS "en_allen _minimo", o_custkey AS qty_media, '
       'o_orderkey + 1 AS qty_max, o_orderkey + 2 AS qty_maximo, o_orderkey + 3 AS other FROM orders')
def rename_alias(spark, sf_dir):
    """An alias is renamed, an alias of a present column is not, others stay."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("en_allen_min"),
        F.col("o_custkey").alias("qty_mean"),
        (F.col("o_orderkey") + 1).alias("qty_max"),
        (F.col("o_orderkey") + 2).alias("qty_maximo"),
        (F.col("o_orderkey") + 3).alias("other"),
    )
    renamed, _ = prep.rename_aliases(rows, ["en_allen _minimo", "qty_media", "qty_maximo"])
    return renamed


_ENDINGS = [*SUFFIX_WORD, "outro"]


@query("translate_feature",
       "SELECT p_partkey, replace(p_name, ' ', '-') || '_' || CASE p_size % 8 "
       + " ".join(f"WHEN {i} THEN '{SUFFIX_WORD.get(e, e)}'" for i, e in enumerate(_ENDINGS))
       + " END AS feature FROM part")
def translate_feature_(spark, sf_dir):
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), F.pmod("p_size", F.lit(8)))
    name = F.concat(F.translate("p_name", " ", "-"), F.lit(" _"), ending)
    return table(spark, sf_dir, "part").select("p_partkey", translate_feature(name).alias("feature"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_LABELS = ["Fluorita", "Rocksalt", "Mista", "Spinel", "Outra"]


def _labels_of(segment):
    """A class name with stray blanks for every market segment."""
    pairs = [F.lit(x) for pair in zip(_SEGMENTS, _LABELS) for x in pair]
    return F.concat(F.lit(" "), F.create_map(*pairs)[segment], F.lit("  "))


@query("translate_label",
       "SELECT c_custkey, CASE c_mktsegment "
       + " ".join(f"WHEN '{s}' THEN '{CLASS_ENGLISH.get(c, c)}'" for s, c in zip(_SEGMENTS, _LABELS))
       + " END AS class_name FROM customer")
def translate_label_(spark, sf_dir):
    label = _labels_of(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", translate_label(label).alias("class_name"))


@query("label_to_known_classes",
       "SELECT c_custkey, CASE c_mktsegment "
       + " ".join(f"WHEN '{s}' THEN '{'Fluorite' if c == 'Fluorita' else c}'" for s, c in zip(_SEGMENTS, _LABELS))
       + " END AS to_english, CASE c_mktsegment "
       + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in zip(_SEGMENTS, _LABELS))
       + " END AS to_original FROM customer")
def label_to_known_classes(spark, sf_dir):
    label = _labels_of(F.col("c_mktsegment"))
    english = to_known_class(label, ["Fluorite", "Spinel"])
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        english.alias("to_english"),
        to_known_class(english, ["Fluorita", "Spinel"]).alias("to_original"),
    )


@query("label_encode",
       "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS y FROM part")
def label_encode(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    codes = label_codes(parts, "p_brand").withColumn("code", F.col("code").cast("long"))
    return encode_labels(parts, "p_brand", codes).select("p_partkey", "p_brand", "y")


@query("one_hot",
       "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT::DOUBLE AS h{i}" for i, s in enumerate(STATUS))
       + " FROM orders")
def one_hot_(spark, sf_dir):
    code = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("o_orderstatus")).cast("int") - 1
    hot = table(spark, sf_dir, "orders").select("o_orderkey", one_hot(code, 3).alias("h"))
    return hot.select("o_orderkey", *[F.get("h", F.lit(i)).alias(f"h{i}") for i in range(3)])


@query("row_id_fallback",
       "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'row_' || row_number() OVER (ORDER BY c_custkey) "
       "ELSE c_name END AS composition FROM customer")
def row_id_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.pmod("c_nationkey", F.lit(3)) != 0, F.col("c_name")).alias("composition")
    )
    return row_names(rows, ["c_custkey"])


def _stored(spark, sf_dir):
    return materialize(_features(spark, sf_dir), "wide")


def _with_infinities(c: str, i: int):
    """Some cells of a column without a bound, some missing, besides orders without lines."""
    endless = F.when(F.pmod("row_id", F.lit(31)) == i % 31, F.lit(float("inf") if i % 2 else float("-inf")))
    return F.when(F.pmod("row_id", F.lit(7)) != i % 7, F.coalesce(endless, F.col(c))).alias(c)


_INFINITE_SQL = "ends AS (SELECT " + ", ".join(
    f"CASE WHEN row_id % 7 <> {i % 7} THEN CASE WHEN row_id % 31 = {i % 31} THEN '{'' if i % 2 else '-'}Infinity'::DOUBLE ELSE {c} END END AS {c}"
    for i, c in enumerate(FEATURES)
) + " FROM feat)"


@query("median_impute_fit",
       f"WITH {FEAT_SQL}, {_INFINITE_SQL} " + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, round(median({c}), 8) AS median FROM ends" for c in FEATURES))
def median_impute_fit(spark, sf_dir):
    """All features, with missing and infinite cells."""
    wide = feature_table(spark, sf_dir).select("row_id", *[_with_infinities(c, i) for i, c in enumerate(FEATURES)])
    rows = [(c, m) for c, m in prep.exact_medians(materialize(wide, "wide"), FEATURES).items()]
    return spark.createDataFrame(rows, "feature string, median double").select("feature", r("median", 8).alias("median"))


@query("median_impute_fit_narrowing",
       "SELECT 'l_extendedprice' AS feature, round(median(l_extendedprice), 6) AS median FROM lineitem "
       "UNION ALL SELECT 'l_quantity', median(l_quantity) FROM lineitem "
       "UNION ALL SELECT 'l_tax', median(l_tax) FROM lineitem")
def median_impute_fit_narrowing(spark, sf_dir):
    """Columns with few and with many distinct values, straight from the scan."""
    found = prep.exact_medians(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return spark.createDataFrame(list(found.items()), "feature string, median double").select(
        "feature", r("median").alias("median")
    )


@query("median_impute_apply",
       f"WITH {FEAT_SQL} SELECT row_id, " + ", ".join(
           f"round(coalesce({c}, (SELECT median({c}) FROM feat)), {n}) AS {c}" for c, n in COLS.items())
       + " FROM feat")
def median_impute_apply(spark, sf_dir):
    wide = _stored(spark, sf_dir)
    filled = prep.impute(wide, prep.exact_medians(wide, NAMES))
    return filled.select("row_id", *[r(c, n).alias(c) for c, n in COLS.items()])


@query("remove_constant",
       "SELECT feature FROM (SELECT 'price' AS feature, count(DISTINCT o_totalprice) AS n, count(*) - count(o_totalprice) AS m FROM orders "
       "UNION ALL SELECT 'fixed', count(DISTINCT o_orderkey * 0), 0 FROM orders "
       "UNION ALL SELECT 'sparse', count(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 1 END), "
       "count(*) - count(CASE WHEN o_custkey % 2 = 0 THEN 1 END) FROM orders "
       "UNION ALL SELECT 'empty', 0, count(*) FROM orders) WHERE n + (m > 0)::INT > 1")
def remove_constant(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("price"),
        (F.col("o_orderkey") * 0).alias("fixed"),
        F.when(F.pmod("o_custkey", F.lit(2)) == 0, 1).alias("sparse"),
        F.lit(None).cast("double").alias("empty"),
    )
    kept = prep.varying_columns(rows, ["price", "fixed", "sparse", "empty"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_SCALE_COLS = ["o_totalprice", "o_custkey", "fixed"]


def _to_scale(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_custkey", (F.col("o_orderkey") * 0 + 3).alias("fixed")
    )


@query("scale_fit",
       "SELECT 'o_totalprice' AS feature, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS scale FROM orders "
       "UNION ALL SELECT 'o_custkey', round(avg(o_custkey), 4), round(stddev_pop(o_custkey), 4) FROM orders "
       "UNION ALL SELECT 'fixed', 3.0, 1.0")
def scale_fit(spark, sf_dir):
    mean, scale = prep.fit_scaler(_to_scale(spark, sf_dir), _SCALE_COLS)
    rows = list(zip(_SCALE_COLS, mean, scale))
    fitted = spark.createDataFrame(rows, "feature string, mean double, scale double")
    return fitted.select("feature", r("mean", 4).alias("mean"), r("scale", 4).alias("scale"))


@query("scale_apply",
       "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice, "
       "round((o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER (), 6) AS o_custkey, 0.0::DOUBLE AS fixed FROM orders")
def scale_apply(spark, sf_dir):
    rows = _to_scale(spark, sf_dir)
    scaled = prep.scale(rows, _SCALE_COLS, *prep.fit_scaler(rows, _SCALE_COLS))
    return scaled.select("o_orderkey", *[r(c).alias(c) for c in _SCALE_COLS])


@query("select_features",
       f"WITH {FEAT_SQL} SELECT row_id, round(tax_desvio, 8) AS tax_desvio, qty_soma FROM feat")
def select_features(spark, sf_dir):
    """An ordered final subset; the wide table is not computed beyond it."""
    chosen = ["tax_desvio", "qty_soma"]
    wide = feature_table(spark, sf_dir, ["qty", "price", "disc", "tax"])
    return wide.select("row_id", *chosen).withColumn("tax_desvio", r("tax_desvio", 8))


@query("impute_diagnostics",
       "SELECT count(*) AS n_rows, 3 * count(*) FILTER (WHERE p_size % 6 = 5) - count(*) FILTER (WHERE p_size % 6 = 5) AS nan_before_coerce, "
       "2 * count(*) FILTER (WHERE p_size % 6 = 5) + count(*) FILTER (WHERE p_size % 6 IN (2, 3)) AS nan_after_coerce, "
       "count(*) FILTER (WHERE p_size % 6 IN (2, 3)) AS nan_added_by_coerce, "
       "count(*) + 2 * count(*) FILTER (WHERE p_size % 6 = 5) + count(*) FILTER (WHERE p_size % 6 IN (2, 3)) AS nan_before_imputation, "
       "4::BIGINT AS n_input_columns, 1::BIGINT AS n_renamed, 3::BIGINT AS n_required, 1::BIGINT AS n_missing, "
       "0::BIGINT AS n_extra, 2::BIGINT AS n_features_used, 'absent_soma' AS missing_columns, '' AS extra_columns FROM part")
def impute_diagnostics(spark, sf_dir):
    rows = _messy(spark, sf_dir).select(
        F.col("p_partkey").alias("composition"),
        F.col("text").alias("size_sum"),
        F.col("number").alias("retail_media"),
        F.lit(1).alias("Keq_x"),
    )
    return prep.diagnostics(rows, ["size_soma", "retail_media", "absent_soma"], ["size_soma", "retail_media"])


@query("name_forms",
       "SELECT p_partkey, replace(replace(lower(p_name), ' ', '_') || '__', '-', '_') || p_size AS underscored, "
       "replace(p_name, ' ', '') || p_size AS compact, 'atomos ' || lower(p_name) AS folded, "
       "p_name || ' ' || p_size AS squeezed FROM part")
def name_forms(spark, sf_dir):
    """The four ways names are made comparable or file-safe."""
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        underscore_name(F.concat(F.col("p_name"), F.lit(" -"), size)).alias("underscored"),
        compact_name(F.concat(F.col("p_name"), F.lit(" -"), size)).alias("compact"),
        fold_name(F.concat(F.lit(" Átomos "), F.col("p_name"))).alias("folded"),
        squeeze_spaces(F.concat(F.col("p_name"), F.lit("   "), size, F.lit(" "))).alias("squeezed"),
    )
