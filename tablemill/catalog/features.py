"""Features of compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.base import FEAT_SQL, FEATURES, feature_table, query, r, table
from tablemill.functions.numeric import bad_value_to_zero
from tablemill.functions.text import atoms_list, formula_elements, parse_equations, valence_d_count
from tablemill.operators import compose


# Digits kept per value column: fewer for large amounts, whose deviations carry rounding noise.
DIGITS = {"qty": 6, "price": 3, "disc": 8, "tax": 8, "size": 6, "retail": 4}


def digits_of(feature: str) -> int:
    return 5 if feature == "price_media" else DIGITS[feature.split("_")[0]]


def is_exact(feature: str) -> bool:
    return feature.endswith(("_minimo", "_maximo"))


@query(
    "stat5",
    f"WITH {FEAT_SQL} SELECT row_id, "
    + ", ".join(f if is_exact(f) else f"round({f}, {digits_of(f)}) AS {f}" for f in FEATURES)
    + " FROM feat",
)
def stat5(spark, sf_dir):
    wide = feature_table(spark, sf_dir)
    return wide.select("row_id", *[F.col(f) if is_exact(f) else r(f, digits_of(f)).alias(f) for f in FEATURES])


@query(
    "stat5_long",
    "SELECT l_orderkey AS row_id, property, min(value) AS minimo, max(value) AS maximo, "
    "round(sum(value), 4) AS soma, round(avg(value), 4) AS media, round(stddev_pop(value), 4) AS desvio "
    "FROM (SELECT l_orderkey, 'size' AS property, p_size::DOUBLE AS value FROM lineitem JOIN part ON p_partkey = l_partkey "
    "UNION ALL SELECT l_orderkey, 'retail', p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey) "
    "GROUP BY 1, 2",
)
def stat5_long(spark, sf_dir):
    long = _long_values(spark, sf_dir)
    table_ = compose.stat5_long(long, "row_id")
    return table_.select(
        "row_id", "property", "minimo", "maximo", *[r(c, 4).alias(c) for c in ("soma", "media", "desvio")]
    )


def _element_properties(spark, sf_dir):
    """(element, property, value) rows, as element tables come."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("element"),
        F.expr("stack(2, 'size', cast(p_size as double), 'retail', p_retailprice) as (property, value)"),
    )


def _long_values(spark, sf_dir):
    atoms = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("element")
    )
    return compose.lookup_skip(atoms, _element_properties(spark, sf_dir), "element")


@query(
    "stat5_pivot",
    "SELECT l_orderkey AS row_id, "
    + ", ".join(
        f"round({fn}({col}::DOUBLE), 4) AS {p}_{s}"
        for p, col in (("size", "p_size"), ("retail", "p_retailprice"))
        for s, fn in zip(compose.STATISTICS, ("min", "max", "sum", "avg", "stddev_pop"))
    )
    + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
)
def stat5_pivot(spark, sf_dir):
    long = compose.stat5_long(_long_values(spark, sf_dir), "row_id")
    wide = compose.stat5_pivot(long, "row_id", ["size", "retail"])
    return wide.select("row_id", *[r(c, 4).alias(c) for c in wide.columns if c != "row_id"])


@query(
    "formula_parse",
    "SELECT p_partkey, 0 AS position, 'Ce' AS atom, CAST('0.' || p_size AS DOUBLE) AS fraction FROM part "
    "UNION ALL SELECT p_partkey, 1, 'La', 1.0::DOUBLE FROM part "
    "UNION ALL SELECT p_partkey, 2, 'O', 2.0::DOUBLE FROM part",
)
def formula_parse(spark, sf_dir):
    formula = F.concat(F.lit("Ce0."), F.col("p_size").cast("string"), F.lit("LaO2"))
    parsed = table(spark, sf_dir, "part").select(
        "p_partkey", F.posexplode(formula_elements(formula)).alias("position", "e")
    )
    return parsed.select("p_partkey", "position", "e.atom", "e.fraction")


def _atom_cells(spark, sf_dir):
    cell = (
        F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit(None).cast("string"))
        .when(F.pmod("p_partkey", F.lit(7)) == 1, F.lit(" "))
        .when(F.pmod("p_partkey", F.lit(7)) == 2, F.concat(F.lit("["), F.col("p_brand"), F.lit(",O]")))
        .otherwise(F.concat(F.lit("['"), F.col("p_brand"), F.lit("', 'O', '"), F.col("p_type"), F.lit("']")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", atoms_list(cell).alias("atoms"))


@query(
    "atoms_list_parse",
    "SELECT p_partkey, CASE WHEN p_partkey % 7 < 2 THEN NULL WHEN p_partkey % 7 = 2 THEN p_brand || '|O' "
    "ELSE p_brand || '|O|' || p_type END AS atoms, "
    "CASE WHEN p_partkey % 7 < 2 THEN NULL WHEN p_partkey % 7 = 2 THEN 2 ELSE 3 END AS n_atoms FROM part",
)
def atoms_list_parse(spark, sf_dir):
    cells = _atom_cells(spark, sf_dir)
    return cells.select(
        "p_partkey",
        F.array_join("atoms", "|").alias("atoms"),
        F.when(F.col("atoms").isNotNull(), F.size("atoms")).alias("n_atoms"),
    )


@query(
    "atoms_explode",
    "SELECT p_partkey, 0 AS position, p_brand AS atom FROM part WHERE p_partkey % 7 >= 2 "
    "UNION ALL SELECT p_partkey, 1, 'O' FROM part WHERE p_partkey % 7 >= 2 "
    "UNION ALL SELECT p_partkey, 2, p_type FROM part WHERE p_partkey % 7 > 2",
)
def atoms_explode(spark, sf_dir):
    return compose.explode_atoms(_atom_cells(spark, sf_dir), "atoms", ["p_partkey"])


@query(
    "exclude_atoms",
    "SELECT l_orderkey AS row_id, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey "
    "WHERE p_type NOT IN ('SMALL', 'PROMO') GROUP BY 1, 2",
)
def exclude_atoms(spark, sf_dir):
    atoms = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("p_partkey")
    )
    parts = compose.exclude_atoms(
        table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ("SMALL", "PROMO")
    )
    joined = compose.lookup_skip(atoms, parts, "p_partkey")
    return joined.groupBy("row_id", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prop_lookup_skip",
    "SELECT l_orderkey AS row_id, count(*) AS n_found, round(avg(p_size), 6) AS size_media "
    "FROM lineitem JOIN part ON p_partkey = l_partkey AND p_brand <> 'Brand#7' GROUP BY 1",
)
def prop_lookup_skip(spark, sf_dir):
    """Parts of one brand have no entry, so their atoms drop out of the vector."""
    atoms = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("p_partkey")
    )
    known = table(spark, sf_dir, "part").filter(F.col("p_brand") != "Brand#7").select("p_partkey", "p_size")
    found = compose.lookup_skip(atoms, known, "p_partkey")
    return found.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_found"), r(F.avg("p_size")).alias("size_media")
    )


@query(
    "prop_direct",
    "SELECT property, count(*) AS n, min(value) AS minimo, max(value) AS maximo, round(avg(value), 4) AS media "
    "FROM (SELECT 'size' AS property, p_size::DOUBLE AS value FROM lineitem JOIN part ON p_partkey = l_partkey "
    "UNION ALL SELECT 'retail', p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1",
)
def prop_direct(spark, sf_dir):
    return _long_values(spark, sf_dir).groupBy("property").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("minimo"),
        F.max("value").alias("maximo"),
        r(F.avg("value"), 4).alias("media"),
    )


@query(
    "prop_lookup_strict",
    "SELECT l_orderkey AS row_id, count(*) AS n, round(sum(s_acctbal), 2) AS acctbal_soma, "
    "min(s_acctbal) AS acctbal_minimo FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
)
def prop_lookup_strict(spark, sf_dir):
    """The table lists every supplier twice; the first entry counts."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cation"), "s_acctbal")
    doubled = base.select(
        "cation",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("position"), F.col("s_acctbal").alias("acctbal")),
                F.struct(F.lit(2).alias("position"), (F.col("s_acctbal") + 1).alias("acctbal")),
            )
        ).alias("e"),
    ).select("cation", "e.*")
    oxide = compose.first_entries(doubled, "cation", ["position"], ["acctbal"])
    atoms = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("cation")
    )
    values = compose.lookup_strict(atoms, oxide, "cation", ["acctbal"])
    return values.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum("acctbal"), 2).alias("acctbal_soma"),
        F.min("acctbal").alias("acctbal_minimo"),
    )


@query(
    "bad_value_to_zero",
    "SELECT p_brand, count(*) AS n, round(sum(v), 2) AS soma, min(v) AS minimo FROM (SELECT p_brand, "
    "CASE WHEN p_size % 6 < 5 THEN 0.0 ELSE p_retailprice END AS v FROM part) GROUP BY 1",
)
def bad_value_to_zero_(spark, sf_dir):
    kind = F.pmod("p_size", F.lit(6))
    text = (
        F.when(kind == 0, "nan")
        .when(kind == 1, "-infinity")
        .when(kind == 2, "abc")
        .when(kind == 3, "1d")
        .when(kind == 5, F.col("p_retailprice").cast("string"))
    )
    values = table(spark, sf_dir, "part").select("p_brand", bad_value_to_zero(text).alias("v"))
    return values.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("soma"), F.min("v").alias("minimo")
    )


@query(
    "dict_prop_mean",
    "SELECT l_orderkey AS row_id, round(avg(v), 8) AS media FROM "
    "(SELECT l_orderkey, l_linenumber, max(l_tax) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def dict_prop_mean(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("v"))
    maps = entries.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_linenumber", "v")))).alias("d")
    )
    return maps.select("row_id", r(compose.dict_mean(F.col("d")), 8).alias("media"))


@query(
    "config_entropy",
    "SELECT o_orderkey AS row_id, count(l_orderkey) AS n_atoms, "
    "CASE WHEN count(l_orderkey) > 1 THEN round(8.31::DOUBLE * ln(count(l_orderkey) - 1), 6) END AS entropia "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def config_entropy(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.lit(1).alias("one"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.lit(None).cast("int").alias("one")
    )
    counts = lines.unionByName(orders).groupBy("row_id").agg(F.count("one").alias("n_atoms"))
    return counts.select("row_id", "n_atoms", r(compose.config_entropy(F.col("n_atoms"))).alias("entropia"))


# Numerals and their values, as used by the two queries below.
NUMERALS = {"VI": 6, "IV": 4, "IVSQ": 4, "IIIPY": 3, "IX": 9, "XII": 12}


def _numeral_sql(index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(NUMERALS.values()))
    return f"CASE {index} {cases} END"


@query(
    "coord_mean",
    f"SELECT p_partkey, round(({_numeral_sql('p_size % 6')} + {_numeral_sql('p_partkey % 6')} + 14) / 3.0::DOUBLE, 6) "
    "AS media FROM part",
)
def coord_mean(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in NUMERALS])
    numerals = F.array(
        F.get(names, F.pmod("p_size", F.lit(6))),
        F.get(names, F.pmod("p_partkey", F.lit(6)).cast("int")),
        F.lit("XIV"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", r(compose.coordination_mean(numerals)).alias("media"))


@query(
    "oxid_mean",
    "SELECT p_partkey, round((p_size % 5 - 2 + p_size % 3 + 2) / 3.0::DOUBLE, 6) AS media FROM part",
)
def oxid_mean(spark, sf_dir):
    states = F.array(F.pmod("p_size", F.lit(5)) - 2, F.pmod("p_size", F.lit(3)), F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", r(compose.oxidation_mean(states)).alias("media"))


@query(
    "valence_ratio",
    "SELECT p_partkey, round((p_size % 8)::DOUBLE / nullif(p_size % 4, 0), 6) AS ratio FROM part",
)
def valence_ratio(spark, sf_dir):
    ratio = compose.valence_ratio(F.pmod("p_size", F.lit(8)), F.pmod("p_size", F.lit(4)))
    return table(spark, sf_dir, "part").select("p_partkey", r(ratio).alias("ratio"))


@query(
    "valence_d",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE (p_size % 11)::DOUBLE END AS valence_d FROM part",
)
def valence_d(spark, sf_dir):
    shells = F.when(F.pmod("p_size", F.lit(3)) == 0, F.lit("2s2 2p4")).otherwise(
        F.concat(F.lit("3d"), F.pmod("p_size", F.lit(11)).cast("string"), F.lit(" 4s2"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", valence_d_count(shells).alias("valence_d"))


def _equations(spark, sf_dir):
    """Oxidation equations in three shapes: coefficients, none, and a subscripted cation."""
    n = F.col("l_linenumber").cast("string")
    text = (
        F.when(F.col("l_linenumber") == 1, F.lit("Ce + O2 -> CeO2"))
        .when(F.col("l_linenumber") == 2, F.lit("P4 + 5O2 -> 2P2O5"))
        .otherwise(F.concat(n, F.lit("Al + 3O2 -> "), n, F.lit("Al2O3")))
    )
    return table(spark, sf_dir, "lineitem").withColumn("equation", text)


@query(
    "equation_parse",
    "SELECT CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE l_linenumber END AS mols_cation, "
    "CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 3 END AS mols_oxygen, "
    "CASE l_linenumber WHEN 2 THEN 4 ELSE 1 END AS coef_cation, 2 AS coef_oxygen, "
    "CASE l_linenumber WHEN 1 THEN 'CeO2' WHEN 2 THEN 'P2O5' ELSE 'Al2O3' END AS product, "
    "CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE l_linenumber END AS mols_product, count(*) AS n "
    "FROM lineitem GROUP BY ALL",
)
def equation_parse(spark, sf_dir):
    """Each distinct text is parsed once, however many rows carry it."""
    texts = _equations(spark, sf_dir).groupBy("equation").agg(F.count(F.lit(1)).alias("n"))
    parts = parse_equations(texts, "equation").drop("equation")
    return parts.groupBy(*[c for c in parts.columns if c != "n"]).agg(F.sum("n").alias("n"))


@query(
    "equation_lookup",
    "WITH e AS (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN 'Ce + O2 -> CeO2' WHEN 2 THEN 'P4 + 5O2 -> 2P2O5' "
    "ELSE l_linenumber || 'Al + 3O2 -> ' || l_linenumber || 'Al2O3' END AS equation, "
    "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn "
    "FROM lineitem) "
    "SELECT s_suppkey AS cation, coalesce(equation, 'not found') AS equation "
    "FROM supplier LEFT JOIN e ON l_suppkey = s_suppkey AND rn = 1",
)
def equation_lookup(spark, sf_dir):
    equations = (
        _equations(spark, sf_dir)
        .select(F.col("l_suppkey").alias("cation"), "l_orderkey", "l_linenumber", "equation")
    )
    first = compose.first_entries(equations, "cation", ["l_orderkey", "l_linenumber"], ["equation"])
    cations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cation"))
    return cations.join(first, "cation", "left").select(
        "cation", F.coalesce("equation", F.lit("not found")).alias("equation")
    )


