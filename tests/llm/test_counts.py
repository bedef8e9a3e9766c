import random

from tablemill.llm import counts

SF = "/root/testdata/sf0.001"


def brute(model, word):
    word, best = counts.START + word, [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + n * model.byte, best[end - 1][1] - n)]
        ways += [(best[s][0] + model.scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - model.longest), end) if word[s:end] in model.scores]
        best.append(max(ways))
    return best[-1][0], -best[-1][1]


def expected(model, text):
    words = [w.decode() for w in (text or "").encode().split()]
    known = {w: brute(model, w) for w in set(words)}
    return len(words), sum(known[w][1] for w in words), sum(known[w][0] for w in words)


def test_whole_table_and_odd_rows(spark, odd, odd_rows, none):
    model = counts.Unigram(counts.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = counts.op5_trie_counts(spark, SF).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, *expected(model, t)) for i, t in docs)
    out = counts.count_tokens(odd, batch_bytes=100)
    assert set(out.columns) == ({*odd.columns} - {"text"}) | {"n_words", "n_tokens", "log_score"}
    rows = sorted(((r.doc_id, r.n_words, r.n_tokens, r.log_score) for r in out.collect()), key=str)
    assert rows == sorted(((i, *expected(model, t)) for i, t in odd_rows), key=str)
    assert counts.count_tokens(none).collect() == []


def test_shared_prefixes():
    model = counts.Unigram(counts.default_path())
    draw = random.Random(6)
    words = sorted({"".join(draw.choice("abéthe日😀") for _ in range(draw.randint(0, 12))) for _ in range(500)})
    given = sorted(counts.START + w for w in words)
    assert model.count_sorted(given) == [brute(model, w[1:]) for w in given]
