import hashlib
import random

import pytest

from tablemill.llm import suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None and first.get(b[p : p + length], i) >= i:
                first[b[p : p + length]] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(df, length=50):
    rows = suffixes.remove_repeats(df, length).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str
    )


def test_whole_table(spark):
    rows = [tuple(r) for r in suffixes.op10_suffix_buckets(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(rows, key=str) == brute([tuple(r) for r in docs], 50)


def test_odd_rows(odd, odd_rows, none):
    assert ours(odd) == brute(odd_rows, 50)
    assert ours(none) == []
    out = suffixes.remove_repeats(odd)
    assert {"a.b", "row", "mark", "lang"} <= set(out.columns) and "text" not in out.columns
    for r in out.collect():
        assert r.kept_text == bytes(r.kept).decode("utf-8", "ignore")


@pytest.mark.parametrize("span, parts", [(suffixes.SPAN, 1 << 23), (400, 1 << 10)])
def test_overlaps_periods_and_edges(spark, monkeypatch, span, parts):
    """Small spans and parts cut texts and buckets everywhere."""
    monkeypatch.setattr(suffixes, "SPAN", span)
    monkeypatch.setattr(suffixes, "PART_BYTES", parts)
    draw = random.Random(3)
    pieces = ["".join(draw.choice("ab ") for _ in range(draw.randint(40, 160))) for _ in range(6)]
    pieces += ["a" * 120, "ab" * 70, "é" * 60, "abc" * 40]
    rows = []
    for _ in range(120):
        parts_ = [
            draw.choice(pieces)[draw.randint(0, 30) : draw.randint(60, 160)]
            if draw.random() < 0.7
            else "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 60)))
            for _ in range(draw.randint(0, 5))
        ]
        rows.append((draw.choice([None, *range(90)]), "".join(parts_)))
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)
