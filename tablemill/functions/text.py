"""Column expressions over the text cells of composition and property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numeric import text_to_double

# Letters with accents and their plain forms, for name comparison.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"

# Roman symbols of coordination numbers, and marks that carry no number.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_MARKS = "[SQPY]"


def fold_name(c: Column) -> Column:
    """Lower-case, trimmed, accent-free form of a name."""
    return F.lower(F.trim(F.translate(c, ACCENTED, PLAIN)))


def squeeze_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def underscore_name(c: Column) -> Column:
    """File-safe name: every other character becomes an underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def compact_name(c: Column) -> Column:
    """File-safe name: every other character is removed."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "")


def atoms_list(c: Column) -> Column:
    """``"['Ni', 'O']"`` to an array of names; blank, empty or NULL cells give NULL."""
    bare = F.regexp_replace(c, "[\\[\\]'\" ]", "")
    names = F.filter(F.split(bare, ","), lambda x: x != "")
    return F.when(F.size(names) > 0, names)


def formula_elements(c: Column) -> Column:
    """Flat formula to ``array<struct<atom, fraction>>``, each atom once in order of first place.

    An absent number means 1, repeated atoms add up. NULL for text that is no flat formula,
    such as one with brackets.
    """
    atom, number = "[A-Z][a-z]?", "(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)?"
    bare = F.regexp_replace(c, "\\s+", "")
    found = F.transform(
        F.regexp_extract_all(bare, F.lit(f"{atom}{number}"), F.lit(0)),
        lambda t: F.struct(
            F.regexp_extract(t, atom, 0).alias("atom"),
            F.coalesce(text_to_double(F.regexp_replace(t, f"^{atom}", "")), F.lit(1.0)).alias("fraction"),
        ),
    )
    summed = F.transform(
        F.array_distinct(found["atom"]),
        lambda a: F.struct(
            a.alias("atom"),
            F.aggregate(
                F.filter(found, lambda t: t["atom"] == a), F.lit(0.0), lambda total, t: total + t["fraction"]
            ).alias("fraction"),
        ),
    )
    return F.when(bare.rlike(f"^(?:{atom}{number})*$"), summed)


def roman_value(c: Column) -> Column:
    """Coordination numeral such as ``IVSQ`` to its integer.

    Symbols are read right to left; one that is smaller than the symbol after it counts
    as negative.
    """
    symbols = F.reverse(F.split(F.regexp_replace(c, ROMAN_MARKS, ""), ""))
    worth = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(F.filter(symbols, lambda s: s != ""), lambda s: worth[s])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("after"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            (acc["total"] + F.when(v < acc["after"], -v).otherwise(v)).alias("total"),
            v.alias("after"),
        ),
        lambda acc: acc["total"],
    )


def valence_d_count(c: Column) -> Column:
    """Electrons in the first d shell named by a configuration text; 0 when there is none."""
    after_d = F.regexp_extract(c, r"d([0-9.]+)", 1)
    return F.coalesce(F.nullif(after_d, F.lit("")).try_cast("double"), F.lit(0.0))


def parse_equations(df: DataFrame, column: str) -> DataFrame:
    """Adds moles, subscripts and product of ``"4Al + 3O2 -> 2Al2O3"`` style equations.

    A side is cut at its plus signs and each term read alone: a leading count, then the
    species. Oxygen is the term O2; of several cations on the left the first counts, of
    several products the first. What is absent gives 0, its count 1.
    """

    def terms(side: Column) -> Column:
        return F.transform(
            F.split(side, "[+]"),
            lambda t: F.struct(
                F.regexp_extract(F.trim(t), "^[0-9]*", 0).alias("count"),
                F.regexp_replace(F.trim(t), "^[0-9]*\\s*", "").alias("species"),
            ),
        )

    sides = F.split(F.col(column), "->")
    split = df.select("*", terms(F.get(sides, F.lit(0))).alias("_from"), terms(F.get(sides, F.lit(1))).alias("_to"))
    species = F.filter("_from", lambda t: t["species"] != "")
    oxygen = F.get(F.filter(species, lambda t: t["species"] == "O2"), F.lit(0))
    cation = F.get(F.filter(species, lambda t: t["species"] != "O2"), F.lit(0))
    named = split.select(*df.columns, cation.alias("_cation"), oxygen.alias("_oxygen"), F.get("_to", F.lit(0)).alias("_made"))

    def when_there(term: str, value: Column) -> Column:
        return F.when(F.col(term).isNull(), 0).otherwise(value)

    return named.select(
        *df.columns,
        when_there("_cation", _int_or(F.col("_cation.count"), 1)).alias("mols_cation"),
        when_there("_oxygen", _int_or(F.col("_oxygen.count"), 1)).alias("mols_oxygen"),
        when_there("_cation", _int_or(F.regexp_extract("_cation.species", "[0-9]*$", 0), 1)).alias("coef_cation"),
        when_there("_oxygen", F.lit(2)).alias("coef_oxygen"),
        F.coalesce("_made.species", F.lit("")).alias("product"),
        _int_or(F.col("_made.count"), 1).alias("mols_product"),
    )


def _int_or(text: Column, default: int) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(default))
