"""Each stage against a plain version of it, on the smallest table and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_jaccard import classes
from test_packing import check_packed
from test_quality import SQL

import corpus_pipeline
from tablemill.llm import pii

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def without_repeats(rows, length=50):
    """What 50-byte strings of smaller documents leave, as text; emptied documents go."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        if not b or sum(gone) < len(b):
            out.append((i, bytes(x for x, y in zip(b, gone) if not y).decode("utf-8", "ignore")))
    return sorted(out, key=str)


def one_of_each(rows):
    """The smallest id of every class, and of its equal rows one."""
    sets, group = classes([t for _, t in rows], 5, 80)
    least = {}
    for (i, _), s, g in zip(rows, sets, group):
        if s and i is not None:
            least[g] = min(i, least.get(g, i))
    out = {(i, t or "") for (i, t), s, g in zip(rows, sets, group) if not s or g not in least or i == least[g]}
    return sorted(out, key=str)


def test_stages_in_order(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == "quality_rules near_copies repeated_passages personal_data packing".split()
    ruled = STAGES["quality_rules"](spark, docs, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({SQL}) where kept").fetchall()}
    assert {r.doc_id for r in ruled.collect()} == kept
    single = STAGES["near_copies"](spark, ruled, SF)
    rows = pairs(single)
    assert rows == one_of_each(pairs(ruled))
    cut = STAGES["repeated_passages"](spark, single, SF)
    cut_rows = pairs(cut)
    assert cut_rows == without_repeats(rows)
    masked = STAGES["personal_data"](spark, cut, SF)
    weights = pii.train(cut)
    assert pairs(masked) == sorted(((i, pii._masked(t, pii.find_spans(t, weights)[1])) for i, t in cut_rows), key=str)
    for stage in (ruled, single, cut, masked):
        assert stage.schema.fieldNames() == docs.schema.fieldNames()
        assert stage.where(F.col("n_chars") != F.length("text")).count() == 0 or stage is ruled
    check_packed(STAGES["packing"](spark, masked, SF).collect(), pairs(masked))


def test_run_is_all_stages(spark, docs):
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).select(key).collect()) == sorted(df.select(key).collect())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_odd_rows(spark, odd, odd_rows, none, name):
    stage = STAGES[name]
    out = stage(spark, odd, SF)
    assert out.dtypes == odd.dtypes
    rows = pairs(out)
    if name == "near_copies":
        assert sorted(((i, t or "") for i, t in rows), key=str) == one_of_each(odd_rows)
    if name == "repeated_passages":
        assert rows == without_repeats(odd_rows)
    if name == "personal_data":
        assert len(rows) == len(odd_rows)
    if name == "quality_rules":
        assert rows == []  # all of them repeat themselves or are short
    assert stage(spark, none, SF).collect() == []


HELPERS = (
    "lost row_key boilerplate _words words n_words kept cleaned others carried host base_failed removed_words row id hash "
    "_hash _id _of text_hash component_id n_shingles mark kept_text ranges n_bytes base found masked text_2"
).split()


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_called_like_helpers(spark, docs, name):
    """They come out with their values and types, and the rest is what it is without them."""
    kinds = [F.col("doc_id").cast("string"), F.array("doc_id"), F.lit(None).cast("date"), F.col("doc_id") / 2]
    more = [kinds[i % 4].alias(c) for i, c in enumerate(HELPERS)]
    wide = docs.select("*", *more, F.col("doc_id").alias("a.b"))
    out = STAGES[name](spark, wide, SF)
    assert out.dtypes == wide.dtypes
    assert pairs(out) == pairs(STAGES[name](spark, docs, SF))
    wrong = [~F.col(c).eqNullSafe(kinds[i % 4]) for i, c in enumerate(HELPERS)]
    assert out.where(F.greatest(*wrong, F.col("`a.b`") != F.col("doc_id"))).count() == 0


def test_packing_of_odd_rows(spark, odd, odd_rows, none):
    check_packed(STAGES["packing"](spark, odd, SF).collect(), odd_rows)
    assert STAGES["packing"](spark, none, SF).collect() == []
