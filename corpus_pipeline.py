"""A cleaning pipeline over ``documents``: rules, near copies, repeats, personal data, packing.

Every stage reads what the one before has written; all but the last give the columns of
``documents``. ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.jaccard import similar_documents
from tablemill.llm.packing import pack_documents
from tablemill.llm.pii import detect
from tablemill.llm.quality import apply_rules
from tablemill.llm.suffixes import remove_repeats
from tablemill.session import materialize


def _carried(docs: DataFrame) -> DataFrame:
    """What operators read, and all other columns as one, so that no name of theirs meets one of these."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "source", "text", F.struct(*others).alias("carried"))


def _with_text(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` out of the carried ones, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are boilerplate in their host."""
    kept = apply_rules(_carried(docs)).where("kept")
    return _with_text(kept, docs.columns, F.col("cleaned"))


def _same_row(docs: DataFrame, keys: DataFrame):
    return docs["id"].eqNullSafe(keys["_id"]) & (docs["hash"] == keys["_of"])


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys, _same_row(docs, keys), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles at 0.8 connect, the smallest id stays.

    Of repeated rows of that id one stays. Documents without words or without an id stay
    when nothing of a smaller id is linked with them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    groups = materialize(similar_documents(docs), "groups")
    # rows of one id may belong to several groups: the hash says which text is whose
    keys = groups.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), "component_id", "n_shingles")
    gone = materialize(
        keys.where("n_shingles > 0 AND component_id IS NOT NULL AND (_id IS NULL OR _id != component_id)")
        .select("_id", "_of")
        .distinct(),
        "gone",
    )
    repeated = materialize(keys.groupBy("_id", "_of").count().where("count > 1").select("_id", "_of"), "repeated")

    # only repeated rows, seldom any, have to meet to leave one of them
    # what goes grows with the documents: merged at every size, not broadcast while it is small
    once = _without(keyed, gone.hint("merge"))
    alone = _without(once, repeated)
    twins = once.join(repeated, _same_row(once, repeated), "left_semi").dropDuplicates(["id", "hash"])
    return alone.unionByName(twins).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside strings of 50 bytes that a smaller document has as well go.

    Cuts fall between bytes; what is left of a character that was cut goes too. A document
    that had text and has none left goes.
    """
    out = remove_repeats(_carried(docs))
    left = out.where((F.col("n_bytes") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return _with_text(left, docs.columns, F.col("kept_text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets."""
    return _with_text(detect(_carried(docs)), docs.columns, F.col("masked"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
