"""Rows that every operator has to take: nulls, empties, long texts, ties, repeats."""

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    same = "one two three four five six seven eight nine ten " * 8
    return [
        (1, same),
        (1, same),
        (2, same),
        (3, None),
        (4, ""),
        (5, " \t\n \x0b"),
        (None, "a null id, call +1 (988) 555-2485 now"),
        (None, None),
        (6, "x" * 40000),
        (7, "word " * 30000),
        (8, "é" * 60 + "\n" + "é" * 60),
        (9, "<|endoftext|> and 1.2.3.4 then a@b.co"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with further columns, some called as operators call theirs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, mark string, `a.b` int, kept string, score string"
    more = [("en", None if i % 3 else f"s{i % 2}", None, "r", None, i, "k", "s") for i in range(len(odd_rows))]
    return spark.createDataFrame([r + m for r, m in zip(odd_rows, more)], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
