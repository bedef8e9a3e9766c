import random

import numpy as np
from pyspark.sql import functions as F

from tablemill.llm import voting

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_apart(spark):
    found = {r.doc_id: r for r in voting.op7_neighbour_vote(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert sum(found[r.doc_id].predicted == r.quality for r in labels) > 0.95 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    results = []
    for k, given in enumerate((labels, labels.withColumn("quality", F.when(rest == 1, 1 - F.col("quality")).otherwise(F.col("quality"))))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        given.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        results.append(sorted(voting.op7_neighbour_vote(spark, f"{tmp_path}/{k}").collect()))
    assert results[0] == results[1]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (None, 1), (2, None), (3, 5)], "doc_id long, quality int")
    model = voting.learn(odd, labels)
    rows = voting.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert set(voting.score_quality(odd, model).columns) == ({*odd.columns} - {"text"}) | {"score", "predicted"}
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert voting.score_quality(none, model).collect() == []
    assert voting.learn(odd, labels.where("false")) is None and voting.learn(none, labels) is None
    assert {r.score for r in voting.score_quality(odd, None).collect()} == {0.5}


def test_votes_are_those_of_all_cosines():
    draw = random.Random(3)
    texts = [" ".join(draw.choice("a b c dd EE !! 9".split()) for _ in range(draw.randint(0, 30))).encode() for _ in range(80)]
    import numpy as np

    rows = voting.term_rows(texts)
    labels = np.array([t.count(b"!") % 2 for t in texts])
    model = voting.Latent(rows[:60], labels[:60])
    for row, vote in zip(rows[60:], model.vote(rows[60:])):
        z = model.project(row[None])[0]
        cosines = sorted(((float(z @ v), int(y)) for v, y in zip(model.vectors, labels)), reverse=True)[: voting.NEIGHBOURS]
        weights = [max(c, 0) ** voting.SHARPNESS for c, _ in cosines]
        want = sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights)
        assert abs(want - vote) < 1e-3


def test_long_runs_are_read_to_their_end():
    """Unbroken texts with one beginning differ by what follows, and share its pieces."""
    start, tail = "数据处理" * 10, "操作符测试完成"
    a, b, c = voting.term_rows([x.encode() for x in (start, start + tail, start + "另外一个结尾呢")])
    words = slice(0, voting.WORDS)
    assert not np.allclose(b[words], c[words]) and not np.allclose(a[words], b[words])
    extra = voting._pieces((start + tail).encode()) - voting._pieces(start.encode())
    assert extra[words].sum() == len(tail)
    d, e = voting.term_rows([b"a1-" * 50 + b"Q" * 3, b"a1-" * 50 + b"." * 3])
    shapes = slice(voting.WORDS, voting.WORDS + voting.SHAPES)
    assert not np.allclose(d[shapes], e[shapes])
