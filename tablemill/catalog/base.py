"""Registry of queries and the stand-in tables they share.

An order plays a composition, its line items are the atoms, parts are the elements and
suppliers the oxides. Predictions and probabilities are derived from order columns by
arithmetic that gives the same doubles in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.compose import stat5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Classes of the stand-in labels.
STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Model name -> every how many rows it is wrong.
WRONG_EVERY = {"RandomForest": 4, "MLP": 5, "Ensemble": 7}
# Value columns of the wide feature table.
VALUES = ["qty", "price", "disc", "tax", "size", "retail"]
STATS = ["minimo", "maximo", "soma", "media", "desvio"]
FEATURES = [f"{v}_{s}" for v in VALUES for s in STATS]


def query(name: str, sql: str | None = None):
    """Register a query under its operator name, with its SQL if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, half away from zero, in double arithmetic and without a negative zero."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with their values: line items joined to parts."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail")
    )
    return lines.join(parts, "p_partkey")


def feature_table(spark: SparkSession, sf_dir: str, values: list[str] | None = None) -> DataFrame:
    """Wide features per order with its label code ``y``; no lines means NULL features."""
    wanted = values or VALUES
    source = line_values(spark, sf_dir)
    if not {"size", "retail"} & set(wanted):
        lines = table(spark, sf_dir, "lineitem")
        names = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
        source = lines.select(
            F.col("l_orderkey").alias("row_id"), *[F.col(names[v]).alias(v) for v in wanted]
        )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), status_code(F.col("o_orderstatus")).alias("y")
    )
    return stat5(source, "row_id", wanted, every=orders, carry=["y"])


FEAT_SQL = (
    "feat AS (SELECT o_orderkey AS row_id, "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, "
    + ", ".join(
        f"{fn}({col}::DOUBLE) AS {v}_{s}"
        for v, col in zip(
            VALUES,
            ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"],
        )
        for s, fn in zip(STATS, ["min", "max", "sum", "avg", "stddev_pop"])
    )
    + " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
    " LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
)


def status_code(c: Column) -> Column:
    return F.when(c == "F", 0).when(c == "O", 1).otherwise(2)


def priority_code(c: Column) -> Column:
    return F.substring(c, 1, 1).cast("int") - 1


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, fold, model, y_true, y_pred): five classes, five folds, three models."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.pmod("o_custkey", F.lit(5)) + 1).cast("int").alias("fold"),
        priority_code(F.col("o_orderpriority")).alias("y_true"),
    )
    per_model = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.when(
                    F.pmod("row_id", F.lit(n)) == 0, F.pmod(F.col("y_true") + 1, F.lit(5))
                ).otherwise(F.col("y_true")).alias("y_pred"),
            )
            for m, n in WRONG_EVERY.items()
        ]
    )
    return rows.select("row_id", "fold", "y_true", F.inline(per_model))


PRED_SQL = (
    "preds AS (SELECT o_orderkey AS row_id, (o_custkey % 5 + 1)::INTEGER AS fold, m.model, "
    "ascii(o_orderpriority) - 49 AS y_true, "
    "CASE WHEN o_orderkey % m.n = 0 THEN (ascii(o_orderpriority) - 48) % 5 "
    "ELSE ascii(o_orderpriority) - 49 END AS y_pred "
    "FROM orders CROSS JOIN (VALUES "
    + ", ".join(f"('{m}', {n})" for m, n in WRONG_EVERY.items())
    + ") m(model, n))"
)


def probability_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y_true, tied, smooth): two arrays of three class probabilities per order."""
    a, b, c = (
        (1 + F.pmod("o_custkey", F.lit(7))).cast("double"),
        (1 + F.pmod("o_orderkey", F.lit(5))).cast("double"),
        (1 + F.pmod(F.floor("o_totalprice"), F.lit(6))).cast("double"),
    )
    total = a + b + c
    x = F.col("o_totalprice") / 1000000.0
    rest = (F.lit(1.0) - x) / 2.0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        status_code(F.col("o_orderstatus")).alias("y_true"),
        F.array(a / total, b / total, c / total).alias("tied"),
        F.array(x, rest, rest).alias("smooth"),
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, model, y_true, proba): three classes; one model with many tied scores."""
    per_model = F.array(
        F.struct(F.lit("RandomForest").alias("model"), F.col("tied").alias("proba")),
        F.struct(F.lit("Ensemble").alias("model"), F.col("smooth").alias("proba")),
    )
    return probability_arrays(spark, sf_dir).select("row_id", "y_true", F.inline(per_model))


PROBA_SQL = (
    "base AS (SELECT o_orderkey AS row_id, "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true, "
    "(1 + o_custkey % 7)::DOUBLE AS a, (1 + o_orderkey % 5)::DOUBLE AS b, "
    "(1 + floor(o_totalprice)::BIGINT % 6)::DOUBLE AS c, o_totalprice / 1000000.0::DOUBLE AS x FROM orders), "
    "proba AS (SELECT row_id, 'RandomForest' AS model, y_true, "
    "a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM base "
    "UNION ALL SELECT row_id, 'Ensemble', y_true, x, "
    "(1.0::DOUBLE - x) / 2.0::DOUBLE, (1.0::DOUBLE - x) / 2.0::DOUBLE FROM base)"
)


def parted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, features, features_scaled): embeddings moved so far apart by their ten
    labels that every right classifier names the label of every row.

    Each dimension is a staircase over the labels in an order of its own; what is left of
    the embedding is a step's unevenness. Few distinct values, so a tree sees all of them.
    """
    turns = F.array(*[F.lit(m) for m in (1, 3, 7, 9)])
    step = lambda d: F.pmod(F.col("y") * F.get(turns, d % 4) + d, F.lit(10))
    uneven = lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 1000), F.lit(3))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"), "embedding"
    )
    raw = rows.select(
        "row_id", "y", F.transform("embedding", lambda x, d: (10 * step(d) + uneven(x)).cast("double")).alias("features")
    )
    return raw.withColumn("features_scaled", F.transform("features", lambda x: (x - 46.0) / 29.0))


def parted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, all features): half of the features tell the two classes apart, the other
    half are the plain statistics, with NULLs for orders without lines.

    A telling feature is NULL in a few rows as well, each in others.
    """
    wide = feature_table(spark, sf_dir).withColumn("y", F.pmod("row_id", F.lit(2)).cast("int"))

    def telling(i: int, c: str) -> Column:
        side = F.col("y") if i % 4 == 1 else 1 - F.col("y")
        value = 100 * side + F.pmod(F.floor(F.coalesce(F.col(c), F.lit(0.0))), F.lit(9))
        return F.when((F.pmod("row_id", F.lit(29)) != i) | F.lit(i == 1), value.cast("double")).alias(c)

    return wide.select("row_id", "y", *[telling(i, c) if i % 2 else F.col(c) for i, c in enumerate(FEATURES)])
