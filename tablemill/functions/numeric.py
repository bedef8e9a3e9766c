"""Numeric column helpers that keep "missing" as NULL and never throw under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as a number. Spark's own cast also takes '1d' and '1f', so the text is
# checked before it is cast.
NUMBER_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def text_to_double(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def bad_value_to_zero(c: Column) -> Column:
    """NULL, "nan", "infinity" and other non-numbers become 0 and stay in the statistics."""
    text = c.cast("string")
    bad = text.contains("nan") | text.contains("infinity")
    value = F.when(~bad, text_to_double(text))
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return F.coalesce(finite, F.lit(0.0))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def array_sum(values: Column) -> Column:
    """Sum of an array of doubles, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    """Mean of an array; NULL for an empty or NULL array."""
    as_double = F.transform(values, lambda x: x.cast("double"))
    return F.try_divide(array_sum(as_double), F.size(values).cast("double"))
