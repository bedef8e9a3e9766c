import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tablemill.llm import collocations as c

SF = "/root/testdata/sf0.001"


def counts(rows, longest=5):
    """(occurrences by language and phrase, words by language)."""
    found, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[lang, tuple(words[i : i + n])] += 1
    return found, total


def brute(rows, least, report, longest=5):
    found, total = counts(rows, longest)
    found = {k: n for k, n in found.items() if n >= least}
    out = {}
    for (lang, p), a in found.items():
        longer = [q for (g, q) in found if g == lang and len(q) > len(p) and found[g, q] >= a]
        if len(p) < 2 or any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        best = min((1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
        sides = found[lang, p[: best[1]]], found[lang, p[best[1] :]]
        out.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), a, *sides, total[lang], best[0]))
    return [(lang, i, x[2].decode(), *x[3:]) for lang in sorted(out) for i, x in enumerate(sorted(out[lang])[:report], 1)]


def ours(df, **more):
    return sorted(tuple(r) for r in c.collocations(df, **more).collect())


def drawn(seed, rows=60):
    draw = random.Random(seed)
    words = ["a", "B", "b", "the", "Éa", "éa", "日本", "x" * 90]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r"]
    text = lambda: "".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.choice([0, 1, 3, 80])))
    return [(draw.choice(["en", "fr", None, "und"]), draw.choice([text(), text(), text(), None, ""])) for _ in range(rows)]


def test_random_texts(spark):
    for seed, least, report in ((1, 3, 1000), (2, 12, 7)):
        rows = drawn(seed)
        df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
        assert ours(df, least=least, report=report) == sorted(brute(rows, least, report))


def test_summaries_keep_what_is_frequent_however_they_merge():
    draw = np.random.default_rng(3)
    for _ in range(30):
        streams = [draw.zipf(1.3, 400) % 500 for _ in range(20)]
        mass = sum(map(len, streams))
        summary = c.Summary(mass // 100 + 1)
        for s in streams:
            summary.merge(*c._counted(s.astype(np.int64)))
        codes, n = c._counted(np.concatenate(streams).astype(np.int64))
        assert {*codes[n >= 100].tolist()} <= {*summary.reaching(100).tolist()}
        assert len(summary.codes) <= summary.capacity and summary.error < 100
        known = dict(zip(codes.tolist(), n.tolist()))
        assert all(known[k] - summary.error <= v <= known[k] for k, v in zip(summary.codes.tolist(), summary.counts.tolist()))


def test_exact_counts_of_several_parts_add_up():
    rows = [(lang or "und", (text or "").encode().translate(c._LOWER)) for lang, text in drawn(9)]
    everything = np.full(1, np.uint64(2**64 - 1))
    chunks = [c._exact(*zip(*rows[i : i + 7]), 40, everything, 5, 6) for i in range(0, len(rows), 7)]
    packed = pa.Table.from_batches(chunks).sort_by("part").to_batches(max_chunksize=3)
    found = [tuple(r.values()) for b in c._add_up(packed, 4) for r in b.to_pylist()]
    expected, total = counts([(lang, text.decode()) for lang, text in rows])
    want = [(g, " ".join(p), len(p), n) for (g, p), n in expected.items() if n >= 4] + [(g, "", 0, n) for g, n in total.items()]
    assert sorted(found) == sorted(want)


def test_survivors_of_several_parts(spark):
    rows = [(lang or "und", (text or "").encode()) for lang, text in drawn(4)]
    df = spark.createDataFrame(rows, "lang string, text binary").repartition(6)
    one, many = ({r.code for r in c.surviving_codes(df, 40, parts, least=5).collect()} for parts in (1, 7))
    chunk = c.Phrases([x for x, _ in rows], [t.translate(c._LOWER) for _, t in rows], 40)
    codes, n = c._counted(np.concatenate([x for _, x in chunk.codes(5)]))
    assert {*codes[n >= 5].tolist()} <= one and {*codes[n >= 5].tolist()} <= many


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 50)
    rows = [("en", "one two three. " * 40), ("en", "w " * 200), (None, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t.encode() for _, t in rows])], ["lang", "text"])
    found = Counter()
    for langs, texts in c._chunks([batch]):
        chunk = c.Phrases(langs, texts, 40)
        for n, (at, _) in enumerate(chunk.codes(5), 1):
            found.update(tuple(chunk.words[i].decode() for i in chunk.ids[a : a + n]) for a in at.tolist())
    assert found == Counter({p: n for (_, p), n in counts(rows)[0].items()})


def test_arithmetic_beyond_64_bits(spark):
    rows = [("en", "a", 1, 10**12 + 7), ("en", "b", 1, 10**12 + 9), ("en", "a b", 2, 10**11 + 3)]
    found = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 10**15 + 1)], "lang string, n long")
    (r,) = c.score_phrases(found, totals).collect()
    assert r.score == 1000 * (10**11 + 3) * (10**15 + 1) // ((10**12 + 7) * (10**12 + 9))


def test_odd_rows_and_empty_tables(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert ours(odd, least=100) == sorted(brute(rows, 100, 2000))
    assert c.collocations(none).collect() == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    sql = con.execute(c.ORACLES["op13_misra_gries_phrases"])
    names = [x[0] for x in sql.description]
    found = c.op13_misra_gries_phrases(spark, SF).collect()
    assert len(found) > 20 and sorted(tuple(r[x] for x in names) for r in found) == sorted(sql.fetchall())
