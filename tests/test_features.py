import math

import pytest
from pyspark.sql import functions as F

from tablemill.functions.numeric import bad_value_to_zero, text_to_double
from tablemill.functions.text import (
    atoms_list,
    fold_name,
    formula_elements,
    parse_equations,
    roman_value,
    valence_d_count,
)
from tablemill.operators import compose


def _one(spark, values, schema, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_atoms_cells(spark):
    cells = ["['Ni', 'Fe', 'O']", "[Ce,La,O]", "", None, "['F','O']", "['Ni','Ni','O']", "[]"]
    assert _one(spark, cells, "c string", atoms_list(F.col("c"))) == [
        ["Ni", "Fe", "O"], ["Ce", "La", "O"], None, None, ["F", "O"], ["Ni", "Ni", "O"], None,
    ]


def test_formula(spark):
    found = _one(spark, ["Ce0.2La0.8O2", "NiO"], "c string", formula_elements(F.col("c")))
    assert [[tuple(e) for e in f] for f in found] == [[("Ce", 0.2), ("La", 0.8), ("O", 2.0)], [("Ni", 1.0), ("O", 1.0)]]


def test_numerals(spark):
    given = {"VI": 6, "IV": 4, "IVSQ": 4, "IIIPY": 3, "IX": 9, "XII": 12, "XIV": 14, "MCMXC": 1990}
    assert _one(spark, list(given), "c string", roman_value(F.col("c"))) == list(given.values())


def test_valence(spark):
    assert _one(spark, ["3d6 4s2", "2s2 2p4", "5d1"], "c string", valence_d_count(F.col("c"))) == [6.0, 0.0, 1.0]


def test_equations(spark):
    given = {
        "4Al + 3O2 -> 2Al2O3": (4, 3, 1, 2, "Al2O3", 2),
        "Ce + O2 -> CeO2": (1, 1, 1, 2, "CeO2", 1),
        "P4 + 5O2 -> 2P2O5": (1, 5, 4, 2, "P2O5", 2),
    }
    df = parse_equations(spark.createDataFrame([(e,) for e in given], "equation string"), "equation")
    found = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert found == given


def test_bad_values(spark):
    cells = ["15.7", "nan", "infinity", None, "abc", "-inf", "1e3", " 2 "]
    assert _one(spark, cells, "c string", bad_value_to_zero(F.col("c"))) == [15.7, 0, 0, 0, 0, 0, 1000.0, 2.0]


def test_number_text(spark):
    cells = ["1d", "1f", "0x10", "1_000", ".5", "5.", "-1.5E-2", "", None, "nan"]
    assert _one(spark, cells, "c string", text_to_double(F.col("c"))) == [None] * 4 + [0.5, 5.0, -0.015] + [None] * 3


def test_folded_name(spark):
    assert _one(spark, [" Átomos ", "MÉDIA"], "c string", fold_name(F.col("c"))) == ["atomos", "media"]


def test_entropy(spark):
    found = _one(spark, [6, 2, 1, 0], "n int", compose.config_entropy(F.col("n")))
    assert found[0] == pytest.approx(13.37442905232737, abs=1e-12)
    assert found[1:] == [0.0, None, None]


def test_five_statistics_skip_and_empty(spark):
    comps = spark.createDataFrame([(1, ["Ni", "Xx", "O"]), (2, ["Xx"]), (3, ["O", "O"])], "id int, atoms array<string>")
    props = spark.createDataFrame([("Ni", 3.0), ("O", 1.0)], "atom string, v double")
    atoms = compose.explode_atoms(comps, "atoms", ["id"])
    rows = compose.stat5(compose.lookup_skip(atoms, props, "atom"), "id", ["v"], every=comps).collect()
    found = {r["id"]: tuple(r)[1:] for r in rows}
    assert found == {1: (1.0, 3.0, 4.0, 2.0, 1.0), 2: (None,) * 5, 3: (1.0, 1.0, 2.0, 1.0, 0.0)}


def test_strict_lookup_fails_on_a_missing_cation(spark):
    atoms = spark.createDataFrame([(1, "Ce"), (1, "Zz")], "id int, cation string")
    thermo = spark.createDataFrame([("Ce", 1, -5.0), ("Ce", 2, -6.0)], "cation string, pos int, gibbs double")
    first = compose.first_entries(thermo, "cation", ["pos"], ["gibbs"])
    good = compose.lookup_strict(atoms.filter("cation = 'Ce'"), first, "cation", ["gibbs"]).collect()
    assert [r["gibbs"] for r in good] == [-5.0]
    with pytest.raises(Exception, match="no gibbs for Zz"):
        compose.lookup_strict(atoms, first, "cation", ["gibbs"]).collect()


def test_property_count():
    n = len(compose.DIRECT_PROPERTIES) + len(compose.DICT_PROPERTIES) + len(compose.OXIDE_PROPERTIES)
    # atomic number, Ghosh electronegativity, coordination, oxidation, valence ratio, valence d
    assert (n + 6) * len(compose.STATISTICS) + 1 == 246


def test_means(spark):
    row = spark.range(1).select(
        compose.dict_mean(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(4.0))).alias("d"),
        compose.coordination_mean(F.array(F.lit("VI"), F.lit("IVSQ"))).alias("c"),
        compose.oxidation_mean(F.array(F.lit(2), F.lit(3))).alias("o"),
        compose.valence_ratio(F.lit(4), F.lit(0)).alias("v"),
    ).first()
    assert (row.d, row.c, row.o, row.v) == (2.5, 5.0, 2.5, None) and math.isfinite(row.d)


def test_formulas_add_up_or_are_refused(spark):
    cells = ["CH3COOH", "Ce0.5La.5O2", "Ca(OH)2", "", None, "ni2"]
    found = _one(spark, cells, "c string", formula_elements(F.col("c")))
    assert [None if f is None else [tuple(x) for x in f] for f in found] == [
        [("C", 2.0), ("H", 4.0), ("O", 2.0)],
        [("Ce", 0.5), ("La", 0.5), ("O", 2.0)],
        None,
        [],
        None,
        None,
    ]


def test_equation_terms_are_read_alone(spark):
    given = ["2 Ni + Fe2 + O2 -> NiFe2O4", "3O2", ""]
    df = parse_equations(spark.createDataFrame([(e,) for e in given], "equation string"), "equation")
    assert [tuple(r)[1:] for r in df.collect()] == [(2, 1, 1, 2, "NiFe2O4", 1), (0, 3, 0, 2, "", 1), (0, 0, 0, 0, "", 1)]


def test_atoms_are_spread_before_any_partial_statistic(spark):
    """One value is 8 bytes and its partial statistics 64: what is shuffled are the atoms."""
    atoms = spark.createDataFrame(
        [(1, 2.0, 5.0), (1, 4.0, None), (2, 7.0, 1.0), (None, 9.0, 9.0)], "k long, a double, b double"
    )
    every = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (None, 1)], "k long, y int")
    found = compose.stat5(atoms, "k", ["a", "b"], every=every, carry=["y"])
    plan = compose.stat5(atoms, "k", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") < plan.index("Exchange")
    rows = {r.k: tuple(r) for r in found.collect()}
    assert rows[1] == (1, 0, 2.0, 4.0, 6.0, 3.0, 1.0, 5.0, 5.0, 5.0, 5.0, 0.0)
    assert rows[2] == (2, 1, 7.0, 7.0, 7.0, 7.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0)
    assert rows[3] == (3, 0, *[None] * 10) and rows[None] == (None, 1, *[None] * 10)
