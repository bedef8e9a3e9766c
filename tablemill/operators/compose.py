"""Features of compositions: explode to atoms, look up element values, aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numeric import array_mean, ratio_or_null
from tablemill.functions.text import roman_value

# Names of the five statistics, and the gas constant used for the entropy.
STATISTICS = ("minimo", "maximo", "soma", "media", "desvio")
GAS_CONSTANT = 8.31

# Elements left out of element counts and of oxide lookups.
COUNT_EXCLUDES = ("O", "F")
OXIDE_EXCLUDES = ("O",)

# Atomic properties looked up directly.
DIRECT_PROPERTIES = (
    "atomic_ea", "atomic_en_allen ", "atomic_en_allredroch", "atomic_en_paul",
    "atomic_en_sanderson", "atomic_hatm", "atomic_hfu", "atomic_hvap", "atomic_radius",
    "atomic_radius_calculated", "atomic_spacegroupnum", "boiling_point", "brinell_hardness",
    "bulk_mod", "coeff_of_lte", "covalent_rad", "covalent_rad_emp", "critical_temperature",
    "density_of_solid", "electrical_resist", "liquid_range", "melting_point",
    "mineral_hardness", "molar_vol", "poissons_ratio", "reflectivity", "refract_index",
    "rigidity_mod", "thermal_conduct", "supercond_temp", "van_der_waals_rad", "vel_of_sound",
    "vickers_hardness", "youngs_mod",
)

# Atomic properties that are dictionaries and enter as their mean.
DICT_PROPERTIES = ("atomic_ebe ", "atomic_enc", "atomic_ie", "atomic_orbital_radii", "paul_ionic_radii")

# Oxide properties looked up by cation.
OXIDE_PROPERTIES = ("entalpia-oxidos", "gibbs-oxidos", "entropia-oxidos", "deltaCp-oxidos")


def explode_atoms(df: DataFrame, atoms: str, keep: list[str]) -> DataFrame:
    """One row per (composition, position, atom)."""
    return df.select(*keep, F.posexplode(atoms).alias("position", "atom"))


def exclude_atoms(df: DataFrame, column: str, names: tuple[str, ...] = COUNT_EXCLUDES) -> DataFrame:
    return df.filter(~F.col(column).isin(*names))


def lookup_skip(atoms: DataFrame, properties: DataFrame, on: str) -> DataFrame:
    """Element values per atom; atoms without an entry drop out.

    No broadcast hint: adaptive execution broadcasts the property table when its size
    allows, and splits a hot element's partition when it does not.
    """
    return atoms.join(properties, on, "inner")


def first_entries(table: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """First row per key in the given order, by partial aggregation rather than a window."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return table.groupBy(key).agg(picked).select(key, "_first.*")


def lookup_strict(
    atoms: DataFrame, table: DataFrame, on: str, columns: list[str]
) -> DataFrame:
    """Values per atom from a de-duplicated table; a missing or empty entry fails the job."""
    joined = atoms.join(table, on, "left")
    checks = [
        F.coalesce(
            F.col(c),
            F.raise_error(F.concat(F.lit(f"no {c} for "), F.col(on).cast("string"))).cast("double"),
        ).alias(c)
        for c in columns
    ]
    return joined.select(*atoms.columns, *checks)


def stat5_columns(value: Column, name: str) -> list[Column]:
    """Minimum, maximum, sum, mean and population deviation of one value per group."""
    v = value.cast("double")
    return [
        F.min(v).alias(f"{name}_minimo"),
        F.max(v).alias(f"{name}_maximo"),
        F.sum(v).alias(f"{name}_soma"),
        F.avg(v).alias(f"{name}_media"),
        F.stddev_pop(v).alias(f"{name}_desvio"),
    ]


def stat5(
    atoms: DataFrame,
    key: str,
    values: list[str],
    every: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Five statistics of each value column per composition, wide.

    ``every`` (one row per composition, holding ``key`` and the ``carry`` columns) keeps
    compositions without atoms, with NULL statistics. The aggregate is already spread by
    ``key``, so joining it to ``every`` moves only that thin table.

    Atoms are spread by ``key`` as they are: one value takes 8 bytes, its partial statistics
    64, and a composition has few atoms in a task to share them.
    """
    spread = atoms.select(key, *values).repartition(key)
    rows = spread.groupBy(key).agg(*[c for v in values for c in stat5_columns(F.col(v), v)])
    if every is None:
        return rows
    return every.select(key, *(carry or [])).join(rows, key, "left")


def stat5_long(values: DataFrame, key: str, prop: str = "property", value: str = "value") -> DataFrame:
    """Five statistics per (composition, property), long: serves any number of properties."""
    v = F.col(value).cast("double")
    return values.groupBy(key, prop).agg(
        F.min(v).alias("minimo"),
        F.max(v).alias("maximo"),
        F.sum(v).alias("soma"),
        F.avg(v).alias("media"),
        F.stddev_pop(v).alias("desvio"),
    )


def stat5_pivot(long: DataFrame, key: str, properties: list[str], prop: str = "property") -> DataFrame:
    """Long statistics to 5 x P columns, for a stated list of properties."""
    picked = [
        F.max(F.when(F.col(prop) == p, F.col(s))).alias(f"{p}_{s}")
        for p in properties
        for s in STATISTICS
    ]
    return long.groupBy(key).agg(*picked)


def config_entropy(n_atoms: Column) -> Column:
    """R ln(n - 1) with oxygen as the only anion; NULL below two atoms."""
    return F.when(n_atoms > 1, F.lit(GAS_CONSTANT) * F.log(n_atoms.cast("double") - 1))


def dict_mean(values: Column) -> Column:
    """Mean over the values of a map."""
    return array_mean(F.map_values(values))


def coordination_mean(numerals: Column) -> Column:
    """Mean of an array of coordination numerals."""
    return array_mean(F.transform(numerals, roman_value))


def oxidation_mean(states: Column) -> Column:
    return array_mean(states)


def valence_ratio(n_valence: Column, n_electrons: Column) -> Column:
    return ratio_or_null(n_valence, n_electrons)


def element_counts(atoms: DataFrame, element: str) -> DataFrame:
    return atoms.groupBy(element).agg(F.count(F.lit(1)).alias("n"))
