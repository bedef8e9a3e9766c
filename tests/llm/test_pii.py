import collections
import hashlib
import random
import re

import numpy as np

from tablemill.llm import pii

SF = "/root/testdata/sf0.001"


def brute(text):
    """(kind, start, end) of the base kinds by the plain patterns."""
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def named(spans):
    return [(pii.KINDS[k], a, b) for k, a, b in spans]


def test_base_spans_follow_the_patterns():
    draw = random.Random(2)
    bits = ["a@b", "@", ".", "1", "23", "555", "+1", "4111111111111111", " ", "-", "(", ")", "x", "é", "255", "0", "a.b@c.d", "9" * 40]
    for _ in range(5000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        assert named(pii.base_spans(text)) == brute(text), text
    long = "1." * 20000 + "@" * 2000 + "7" * 30000
    assert named(pii.base_spans(long)) == brute(long) if len(long) < 4000 else pii.base_spans(long) is not None


def test_whole_table(spark):
    found = {r.doc_id: r for r in pii.op9_weak_labels(spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = brute(text or "")
        r = found[doc_id]
        joined = ",".join("%s:%d:%d" % s for s in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        kinds = collections.Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.BASE)


def test_odd_rows(odd, none):
    out = pii.detect(odd)
    assert set(out.columns) == {*odd.columns, "base", "found", "masked"}
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert [tuple(s) for s in r.base] == brute(r.text or "")
    assert {r.masked for r in rows if r.doc_id is None} == {"", "a null id, call [PHONE] now"}
    assert {r.masked for r in rows if r.doc_id == 9} == {"<|endoftext|> and [IP] then [EMAIL]"}
    assert pii.detect(none).collect() == []


def test_secrets_are_learned_and_words_left_alone(spark):
    draw = random.Random(9)
    code = lambda n, signs: "".join(draw.choice(signs) for _ in range(n))
    rows = []
    for i in range(200):
        filler = " ".join(draw.choice(["plain", "words", "of", "text"]) for _ in range(12))
        secret = draw.choice([f'token = "{code(40, "0123456789abcdef")}"', f"password={code(18, '0123456789abcdef')}", "AKIA" + code(16, "ABCDEFGH234567")])
        rows.append((i, f"{filler} {secret} {filler}" if i % 2 else f"{filler} chapter one: antidisestablishment {filler}"))
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        # digits inside a token may pass as a card; then the base span stands for it
        assert bool(r.found) == bool(r.doc_id % 2) and {s.kind for s in r.found} <= {"secret", "card"}, r.text


def test_reliabilities_follow_planted_ones():
    draw = np.random.default_rng(11)
    truth = draw.random(20000) < 0.4
    right = (0.9, 0.75, 0.7, 0.65)
    cast = np.stack([np.where(draw.random(20000) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    patterns, inverse, counts = np.unique(np.c_[np.full(20000, 4), cast], axis=0, return_inverse=True, return_counts=True)
    p = pii.fit_reliabilities(patterns, counts.astype(float))[inverse.ravel()]
    assert abs(p.mean() - 0.4) < 0.05
    assert ((p > 0.5) == truth).mean() > 0.88
