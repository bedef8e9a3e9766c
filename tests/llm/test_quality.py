import duckdb

from tablemill.llm import quality

SF = "/root/testdata/sf0.001"
SQL = quality.ORACLES["op4_line_frequency"]
COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed removed_words kept".split()


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?)", rows)
    found = con.execute(f"select {', '.join(COLUMNS)} from ({SQL})").fetchall()
    return sorted(found, key=str)


def ours(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in quality.apply_rules(df).collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert ours(odd) == by_sql(rows)
    assert ours(none) == []
    assert set(odd.columns) <= set(quality.apply_rules(odd).columns)


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{body(i)}\n Terms  of USE apply ", "a") for i in range(40)]
    rows += [(100, "terms of use apply\n" * 30 + "a b c", "a"), (101, body(101), "a"), (102, f"{body(1)}\nterms of use apply", "b")]
    # copies of one text count once
    rows += [(200 + i, body(200) + "\nonly here", "a") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert ours(df) == by_sql(rows)
    found = {r.doc_id: r for r in quality.apply_rules(df).collect()}
    assert found[3].kept and found[3].removed_words == 4 and found[3].cleaned == body(3)
    assert not found[100].kept
    assert found[101].kept and found[101].cleaned == body(101)
    assert found[102].removed_words == 0 and found[200].kept and found[200].removed_words == 0


def test_filters_keep_their_speed(spark):
    """A filter on the verdict is moved to the scan; words must not be split again for each window."""
    df = spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(30000)), "a")], "doc_id long, text string, source string")
    assert quality.apply_rules(df).where("kept").select("doc_id", "n_repeat_words").collect() == []


def test_whole_table_runs(spark):
    assert quality.op4_line_frequency(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_an_absolute_number_of_texts_is_enough(spark):
    """A line in 30 of 1000 texts of a host: under the share, over the number given."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + ("\nall rights reserved" if i < 30 else ""), "a") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = "sum(removed_words), sum(lines_by_share), sum(lines_by_number)".split(", ")
    count = lambda **limits: tuple(quality.apply_rules(df, **limits).selectExpr(*sums).first())
    assert count(most=None) == (0, 0, 0) and count(most=30) == (0, 0, 0)
    assert count(most=29) == (90, 0, 30)
    assert count(share=0.02, most=29) == (90, 30, 30)
