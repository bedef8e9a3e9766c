import collections
import random

import numpy as np
import pytest
import zstandard

from tablemill.llm import jaccard

SF = "/root/testdata/sf0.001"


def classes(texts, words, percent):
    """Sets and the class number of every text, by comparing all that share a shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        whole = [tuple(w[j : j + words]) for j in range(len(w) - words + 1)]
        sets.append(frozenset(whole if len(w) >= words else [("short", *w)] if w else []))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for a, s in enumerate(sets):
        for x in s:
            holders[x].append(a)
    for a, s in enumerate(sets):
        for b, shared in collections.Counter(b for x in s for b in holders[x] if b < a).items():
            if 100 * shared >= percent * (len(s) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    return sets, [root(a) for a in range(len(texts))]


def brute(rows, words, percent):
    sets, group = classes([t for _, t in rows], words, percent)
    least = {}
    for (i, _), s, g in zip(rows, sets, group):
        if i is not None and s:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group)), key=str)


def ours(df, words, percent):
    found = jaccard.similar_documents(df, words, percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


def test_whole_table(spark):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op6_pivot_jaccard(spark, SF).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(found, key=str) == brute(rows, 4, 85)


def test_odd_rows(odd, odd_rows, none):
    assert ours(odd, 4, 85) == brute(odd_rows, 4, 85)
    assert ours(none, 4, 85) == []


def crowd(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(20):
        text = [draw.choice(vocabulary) for _ in range(draw.choice([2, 3, 5, 8, 30, 80, 200]))]
        for _ in range(draw.choice([1, 2, 6, 40])):
            w = list(text)
            for _ in range(draw.randint(0, 4)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            rows.append((None if draw.random() < 0.03 else len(rows) * 7 % 1009, draw.choice([" ", "\n", "\t "]).join(w)))
    rows += [(5000, None), (5001, ""), (None, "  "), (5002, "W1 w2"), (5003, "w1 W2"), *rows[:5]]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent, region", [(4, 85, 2000), (3, 60, 9)])
def test_small_and_large_regions(spark, monkeypatch, words, percent, region):
    """With regions of nine nodes, the groups go through rings and blocks."""
    monkeypatch.setattr(jaccard.link_nodes, "__defaults__", (None, region))
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS size")
    assert ours(df, words, percent) == brute(rows, words, percent)


def test_region_links_keep_components():
    draw = np.random.default_rng(8)
    for _ in range(30):
        m = int(draw.integers(2, 40))
        core = draw.integers(0, 60, (4, 25))
        sets = [np.unique(np.r_[core[draw.integers(4)][draw.random(25) < 0.9], draw.integers(100, 130, 2)]).astype(np.uint64) for _ in range(m)]
        links = jaccard.link_region(np.arange(m), sets, 70)
        parent = list(range(m))
        want = list(range(m))

        def root(p, x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * shared >= 70 * (len(sets[a]) + len(sets[b]) - shared)
            parent[root(parent, a)] = root(parent, b)
        for a in range(m):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 70 * (len(sets[a]) + len(sets[b]) - shared):
                    want[root(want, a)] = root(want, b)
        same = lambda p: [[root(p, a) == root(p, b) for a in range(m)] for b in range(m)]
        assert same(parent) == same(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7)]
    found = dict(jaccard.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1050)}}


def link_counts(rows, words, percent):
    """(doc_id, links of its set with other sets) of every row, by comparing all pairs."""
    sets, _ = classes([t for _, t in rows], words, percent)
    kinds = list({s for s in sets if s})
    counts = collections.Counter()
    for k, a in enumerate(kinds):
        for b in kinds[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                counts.update([a, b])
    return sorted(((i, counts[s]) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("words, percent, region", [(4, 85, 2000), (3, 60, 9)])
def test_every_link_is_counted_once(spark, monkeypatch, words, percent, region):
    monkeypatch.setattr(jaccard.link_nodes, "__defaults__", (None, region))
    rows = crowd(6)
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    want = link_counts(rows, words, percent)
    assert sum(n for _, n in want) > 200
    assert sorted(((r.doc_id, r.n_links) for r in found), key=str) == want


@pytest.mark.parametrize("percent, size, off", [(85, 20, 3), (80, 10, 2)])
def test_links_at_the_edges_of_rings(spark, percent, size, off):
    """x at distance r of the pivot, y at 2 r, and r between them: all exact."""
    words = [f"w{i}" for i in range(size)]
    texts = {1: words[:-off], 2: words, 3: words[off:]}  # pivot, x, y
    placed = spark.createDataFrame(
        [(n, [(1, 3)], zstandard.compress(" ".join(w).encode())) for n, w in texts.items()],
        "node long, places array<struct<pivot: long, nodes: long>>, text binary",
    )
    found = jaccard._ring_links(placed, 1, percent, 2).collect()
    assert {frozenset((r.a, r.b)) for r in found if r.b is not None} == {frozenset((1, 2)), frozenset((2, 3))}
    counts = collections.Counter()
    for r in found:
        if r.b is None:
            counts[r.a] += r.n
    assert counts == {1: 1, 2: 2, 3: 1}


def test_overlaps_of_common_and_rare_elements():
    draw = np.random.default_rng(9)
    lists = [np.flatnonzero(draw.random(900) < np.where(np.arange(900) < 600, 0.9, 0.02)) for _ in range(150)]
    both = jaccard.Overlaps(lists)
    assert both.dense is not None and len(both.posting)
    for p in range(149):
        assert both.pop(p).tolist() == [len(np.intersect1d(lists[p], x)) for x in lists[p + 1 :]]


def keys_of(sets, percent):
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    size = np.array([len(x) for x in sets])
    doc, key, need = jaccard.class_keys(doc, np.concatenate(sets), size, percent)
    return [key[doc == k] for k in range(len(sets))], need


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_linked_sets_share_the_keys_they_need(percent):
    """Sets with as many differences as a link allows, dropped or added, in any mixture."""
    draw = np.random.default_rng(10)
    for size in [1, 2, 3, 7, 8, 15, 16, 31, 40, 63, 64, 70, 100, 127, 128, 150, 255, 256, 500, 1100]:
        for _ in range(6):
            a = draw.choice(1 << 30, size, replace=False).astype(np.uint64)
            most = int(jaccard.differences(np.array(size), percent))
            gone = int(draw.integers(0, most + 1))
            b = np.r_[a[gone:], draw.choice(1 << 30, most - gone, replace=False).astype(np.uint64) + np.uint64(1 << 30)]
            while 100 * (size - gone) < percent * (len(b) + gone):
                b = b[:-1] if len(b) > size - gone else np.r_[b, a[gone - 1]]
                gone = size - len(np.intersect1d(a, b))
            (x, y), need = keys_of([np.sort(a), np.sort(b)], percent)
            assert len(np.unique(x)) == len(x)
            assert len(np.intersect1d(x, y)) >= need.max() >= 1


def test_keys_are_as_many_as_differences_and_what_a_link_needs():
    draw = np.random.default_rng(11)
    sets = [draw.choice(1 << 40, n, replace=False).astype(np.uint64) for n in (620, 700, 800, 1800)]  # in one band each
    keys, need = keys_of(sets, 85)
    assert need.tolist() == [12, 12, 12, 23]
    assert [len(x) for x in keys] == [620 * 15 // 85 + 12, 700 * 15 // 85 + 12, 800 * 15 // 85 + 12, 1800 * 15 // 85 + 23]


def test_only_texts_that_may_link_are_sent_and_once(spark, monkeypatch):
    """Near copies form one region; texts that share a passage with each other form none."""
    draw, tables = random.Random(12), {}
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for _ in range(4):
        text = [word() for _ in range(320)]
        for _ in range(12):
            w = list(text)
            for _ in range(2):
                w[draw.randrange(320)] = word()
            rows.append((len(rows), " ".join(w)))
    passage = [word() for _ in range(30)]
    rows += [(i, " ".join([*passage, *(word() for _ in range(290))])) for i in range(100, 130)]
    kept = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, stem: tables.setdefault(stem, kept(df, stem)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, _, degrees = jaccard.link_nodes(docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "CAST(text AS binary) AS text"), 4, 85)
    near = {r.node for r in members.where("doc_id < 48").collect()}
    assert {r.node for r in degrees.collect()} == near and len(near) == 48
    regions = collections.Counter(r.node for r in tables["regions"].select("node").collect())
    assert set(regions) == near
    assert max(regions.values()) == 1
