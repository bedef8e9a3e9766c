import os
import random

import duckdb
import numpy as np

from tablemill.llm import runs

SF = "/root/testdata/sf0.001"


def brute(words, least=runs.MIN_WORDS, repeats=runs.REPEATS):
    """Every period, word by word."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(draw):
    n, k = draw.choice([0, 1, 5, 30, 100, 400]), draw.choice([1, 2, 3, 50])
    words = [str(draw.randrange(k)) for _ in range(n)]
    if n and draw.random() < 0.6:
        a = draw.randrange(n)
        p = draw.randint(1, max(1, (n - a) // 4))
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return " ".join(words).encode()


def test_cover_reaches_every_difference():
    assert {(b - a) % runs.MOD for a in runs.COVER for b in runs.COVER} == set(range(runs.MOD))


def test_common_extensions_against_direct_comparison():
    draw = random.Random(3)
    for _ in range(40):
        size = draw.choice([1, 2, 40, 500])
        w = np.array([draw.randint(1, 2) for _ in range(size)] * draw.randint(1, 4) + [9])
        ends = runs.Extensions(w)
        pairs = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
        pairs = np.array(draw.sample(pairs, min(300, len(pairs)))).reshape(-1, 2)
        found = ends.common(pairs[:, 0], pairs[:, 1]).tolist() if len(pairs) else []
        for (i, j), n in zip(pairs.tolist(), found):
            assert (w[i : i + n] == w[j : j + n]).all() and w[i + n] != w[j + n]


def test_runs_of_random_texts():
    draw = random.Random(5)
    for _ in range(150):
        texts = [drawn(draw) for _ in range(draw.randint(1, 6))]
        least = draw.choice([24, 6])
        for text, (n, found, left) in zip(texts, runs.search(texts, least, 3)):
            words = text.split()
            expected = brute(words, least)
            assert n == len(words) and [tuple(r) for r in found.tolist()] == expected
            assert left == collapsed(words, expected)


def test_odd_rows(odd, odd_rows, none):
    out = runs.find_runs(odd)
    assert {*out.columns} == ({*odd.columns} - {"text"}) | {"n_words", "runs", "collapsed"}
    given = sorted((r.doc_id or -1, r["a.b"], r.row, r.kept, r.n_chars or -1) for r in odd.collect())
    found = out.collect()
    assert sorted((r.doc_id or -1, r["a.b"], r.row, r.kept, r.n_chars or -1) for r in found) == given
    texts = [t or "" for _, t in odd_rows]
    for r in found:
        words = texts[r["a.b"]].encode().split()
        expected = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(words)
        assert r.collapsed.encode() == collapsed(words, expected)
    assert runs.find_runs(none).collect() == []


def test_helper_names_stay_the_users(spark):
    df = spark.createDataFrame([(1, "a " * 30, 7, "x")], "doc_id long, text string, `_` int, row string")
    (r,) = runs.find_runs(df).select("doc_id", "_", "row", "runs").collect()
    assert r["_"] == 7 and r.row == "x" and [tuple(x) for x in r.runs] == [(0, 30, 1)]


def test_long_text_of_one_word(spark):
    """Groups are cut by words; a text above their size is searched alone."""
    text = "la la " * 200_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    found = {r.doc_id: r for r in runs.find_runs(df).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 400_000, 1)] and found[1].collapsed == "la"


def test_query_against_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    sql = con.execute(runs.ORACLES["op11_periodic_runs"])
    names = [c[0] for c in sql.description]
    df = runs.op11_periodic_runs(spark, SF)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(sql.fetchall())
    assert df.where("n_runs > 0").count() > 5
    rows = [(None, "x " * 40), (20, None), (20, ""), (7, "a b " * 20), (8, "w " * 3)]
    os.mkdir(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t/documents.parquet")
    found = runs.op11_periodic_runs(spark, f"{tmp_path}/t").collect()
    con.execute(f"create or replace view documents as from '{tmp_path}/t/documents.parquet/*.parquet'")
    assert sorted((tuple(r[c] for c in names) for r in found if r.doc_id is not None), key=str) == sorted(
        (r for r in con.execute(runs.ORACLES["op11_periodic_runs"]).fetchall() if r[0] is not None), key=str
    )
    assert [r.n_runs for r in found if r.doc_id is None] == [1]
