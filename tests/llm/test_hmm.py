import collections
import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablemill.llm import hmm

SF = "/root/testdata/sf0.001"


def base(rows, train):
    """(n_tokens, n_known, train_tokens, base score) of every row by plain counting."""
    counts = collections.Counter()
    for i, t in rows:
        if train(i):
            counts.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, score))
    return out


def compare(found, want):
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 3))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    want = sorted(want, key=key)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert np.allclose([f[4] for f in found], [w[4] for w in want], rtol=1e-9, atol=1e-6)


def test_whole_table(spark):
    found = hmm.op3_hidden_markov(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    compare(found, base(rows, learned))
    assert all(r.held_out != learned(r.doc_id) for r in found)
    held_out = [r for r in found if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_odd_rows(odd, odd_rows, none):
    found = hmm.score_documents(odd, F.col("doc_id") != 2, rounds=1).collect()
    compare(found, base(odd_rows, lambda i: i is not None and i != 2))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert len({(r.score, r.base_score) for r in found if r.doc_id == 1}) == 1
    assert hmm.score_documents(none, F.lit(True), rounds=1).collect() == []
    untrained = hmm.score_documents(odd, F.lit(False), rounds=1).collect()
    compare(untrained, base(odd_rows, lambda i: False))


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(2)
    model = hmm.Model(draw.dirichlet([1] * 3), draw.dirichlet([1] * 3, 3), draw.dirichlet([1] * 5, 3).T)
    seqs = [draw.integers(0, 5, n) for n in (1, 4, 6, 6, 2)]
    order = next(iter(hmm._batches(seqs)))
    logs = hmm.forward(model, *hmm._by_time([seqs[i] for i in order]))[0]
    for log, i in zip(logs, order):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seqs[i])):
            p = model.start[path[0]] * model.emit[seqs[i][0], path[0]]
            for a, b, s in zip(path, path[1:], seqs[i][1:]):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        assert math.isclose(log, math.log(total), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_paths():
    draw = np.random.default_rng(3)
    model = hmm.Model(draw.dirichlet([1] * 2), draw.dirichlet([1] * 2, 2), draw.dirichlet([1] * 3, 2).T)
    seqs = [draw.integers(0, 3, n) for n in (1, 3, 5)]
    found = hmm.Expected(3, 2)
    found.add(model, seqs)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for seq in seqs:
        ways = []
        for path in itertools.product(range(2), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= model.move[a, b] * model.emit[s, b]
            ways.append((p, path))
        total = sum(p for p, _ in ways)
        for p, path in ways:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for s, k in zip(seq, path):
                emit[s, k] += p / total
    assert np.allclose(found.start, start) and np.allclose(found.move, move) and np.allclose(found.emit, emit)


def test_each_round_fits_better():
    draw = np.random.default_rng(4)
    seqs = [np.r_[draw.integers(0, 4, 20), 8] if k % 2 else np.r_[draw.integers(4, 8, 15), 8] for k in range(60)]
    plain = np.bincount(np.concatenate(seqs), minlength=9).astype(float) * 1000
    model, logs = hmm.Model.first_guess(plain, 2), []
    for _ in range(6):
        e = hmm.Expected(9, 2)
        e.add(model, seqs)
        logs.append(e.log)
        model = hmm.Model.from_counts(e.start, e.move, e.emit * 1000, plain)
    assert logs[-1] > logs[0] + 100


def test_a_model_is_a_distribution_over_words(spark):
    """All words of a symbol, unseen ones as one, share its probability."""
    tail_n, tail_v = np.arange(hmm.TAIL), np.ones(hmm.TAIL)
    s = hmm.Symbols(np.zeros(0, np.uint64), np.zeros(0, np.int64), tail_n, tail_v, int(tail_n.sum()), hmm.TAIL, 1)
    shares = (tail_n + 1 + 1) / 10**s.share
    assert np.allclose(shares, 1)


def test_every_round_reads_all_training_documents(spark, monkeypatch):
    """The model is that of rounds over all rows, more than any sample."""
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in draw.integers(0, 9, 6) + 10 * (i % 2))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models, first = [], hmm.likelihoods
    monkeypatch.setattr(hmm, "likelihoods", lambda coded, model: models.append((coded, model)) or first(coded, model))
    hmm.score_documents(df, F.lit(True), rounds=3)
    coded, model = models[0]
    seqs = hmm._open([bytes(r.symbols) for r in coded.select("symbols").collect()])
    plain = np.bincount(np.concatenate(seqs), minlength=len(model.emit)).astype(float)
    want = hmm.Model.first_guess(plain, hmm.STATES)
    for _ in range(3):
        e = hmm.Expected(len(plain), hmm.STATES)
        e.add(want, seqs)
        want = hmm.Model.from_counts(e.start, e.move, e.emit, plain)
    assert len(seqs) == 1500
    assert np.allclose(model.move, want.move, atol=1e-9) and np.allclose(model.emit, want.emit, atol=1e-9)
