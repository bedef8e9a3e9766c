import random
import re

import duckdb

from tablemill.llm import decontamination as d

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items):
    """(n_words, spans, items) of each text, window by window."""
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wanted:
                    hit |= set(range(i, i + n))
                    ids |= wanted[k]
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
        out.append((len(w), [tuple(s) for s in spans], sorted(x for x in ids if x is not None)))
    return out


def ours(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(d.decontaminate(docs, bench, **more).collect(), key=lambda r: r.doc_id)
    return [(r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in found]


def test_random_texts_with_short_and_shared_items(spark):
    draw = random.Random(2)
    letters = ["a", "B", "c9", "É", "ß"]
    sentence = lambda n: draw.choice([" ", "-", "\n\t"]).join(draw.choice(letters) for _ in range(n))
    items = [(i, sentence(draw.choice([1, 2, 3, 4, 5, 9, 10, 11, 14]))) for i in range(3, 12)]
    items += [(0, None), (1, ""), (2, " .,"), (None, sentence(3)), (12, items[5][1]), (12, items[6][1] + " a")]
    texts = [sentence(draw.choice([1, 5, 40, 200])) for _ in range(40)]
    texts += [f"{sentence(5)} {t} {sentence(5)}" for _, t in items[:6] if t] + [items[5][1] or "", None, "", ". ,"]
    assert ours(spark, texts, items) == brute(texts, items)


def test_windows_at_both_ends_and_across_each_other(spark):
    ten = [f"w{i}" for i in range(12)]
    items = [(5, " ".join(ten)), (6, "Only four words here")]
    texts = [
        " ".join(ten[:10]),
        " ".join(ten[2:]),
        " ".join(ten[:9]),
        "x " + " ".join(ten) + " y",
        " ".join(ten[1:11] + ten[1:11]),
        "only FOUR words, here only four words here",
        "w0 " * 50,
    ]
    found = ours(spark, texts, items)
    assert found == brute(texts, items)
    assert [f[1] for f in found] == [[(0, 9)], [(0, 9)], [], [(1, 12)], [(0, 19)], [(0, 7)], []]


def test_blocks_give_the_same(spark, monkeypatch):
    draw = random.Random(4)
    letters = "abcdefgh"
    sentence = lambda n: " ".join(draw.choice(letters) for _ in range(n))
    items = [(i, sentence(12)) for i in range(20)]
    texts = [f"{sentence(20)} {draw.choice(items)[1]} {sentence(9)}" for _ in range(10)]
    monkeypatch.setattr(d, "BLOCK_ROWS", 30)
    assert ours(spark, texts, items) == brute(texts, items)


def test_odd_rows_keep_their_columns(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "a null id"), (3, "word " * 10)], "item_id long, text string")
    out = d.decontaminate(odd, items)
    assert {*out.columns} == ({*odd.columns} - {"text"}) | {"n_words", "spans", "items"}
    kinds = dict(out.dtypes)
    assert all(kinds[c] == k for c, k in odd.dtypes if c != "text")
    expected = brute([t for _, t in odd_rows], [(r.item_id, r.text) for r in items.collect()])
    rows = {r["a.b"]: r for r in out.collect()}
    assert sorted(rows) == list(range(len(odd_rows)))
    for i, (n, spans, ids) in enumerate(expected):
        assert (rows[i].n_words, [tuple(s) for s in rows[i].spans], list(rows[i]["items"])) == (n, spans, ids)
        assert (rows[i].row, rows[i].mark, rows[i].kept, rows[i].doc_id) == ("r", None, "k", odd_rows[i][0])
    assert d.decontaminate(none, items).collect() == []
    clean = d.decontaminate(odd, items.where("false")).collect()
    assert len(clean) == len(odd_rows) and all(r.spans == [] and r["items"] == [] for r in clean)


def test_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as from '{SF}/{name}.parquet'")
    sql = con.execute(d.ORACLES["op12_prefix_containment"])
    names = [c[0] for c in sql.description]
    df = d.op12_prefix_containment(spark, SF)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(sql.fetchall())
    assert df.where("contaminated").count() > 0
