import random

from tablemill.llm import topk


def brute(rows, every, k):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            usable.append((i, [int(float(x) * 1024 // 1) for x in v]))
    out = []
    for q, a in usable:
        if q % every == 0:
            cut = lambda s: max(-(2**63), min(2**63 - 1, s))
            scored = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def ours(df, every, k, **more):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every, k, **more).collect())


def test_ties_repeats_lengths_and_odd_values(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-0.5, 0.25, 0.0, 0.3]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [(400, rows[0][1]), (401, None), (402, [0.1] * 5 + [None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(600, [3e38] * 6), (601, [-3e38] * 6), (602, [1e9] * 6), (500, []), (501, []), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS far", "3 AS dims")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert ours(df, 100, 10) == brute(exact, 100, 10)
    assert ours(df, 50, 3, pivots=2) == brute(exact, 50, 3)
    assert ours(df, 50, 400) == brute(exact, 50, 400)


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    draw = random.Random(5)
    rows = [(i, [round(draw.gauss(0, 1), 3) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ours(df, 5, 4) == brute(rows, 5, 4)


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert ours(df, 100, 10) == [] and ours(df.where("false"), 1, 10) == []
