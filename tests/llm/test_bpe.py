import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablemill.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_whole_table_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *wanted(library, r.text)) for r in docs), key=str)
    assert got(bpe.op2_bpe_tree(spark, SF)) == want


@pytest.mark.parametrize("long_run", [bpe.LONG_RUN, 300])
def test_odd_rows(odd, odd_rows, none, library, long_run):
    want = sorted(((i, *wanted(library, t)) for i, t in odd_rows), key=str)
    assert got(bpe.encode_digests(odd, long_run=long_run)) == want
    assert got(bpe.encode_digests(none, long_run=long_run)) == []


def test_tree_joins_equal_the_library(library):
    """Small leaves, so that every word is joined from halves."""
    coder = bpe.WordEncoder(bpe.default_path(), leaf=4)
    draw = random.Random(1)
    signs = ["a", "aa", "ab", "the", "in", "é", "Σ", "ß", "İ", " ", "\xa0", "'s", "'", "1", "!", "!!", "<|endoftext|>", "<|", "日本", "\x1c", "́", "\t", "Z", "hello", "😀", "\x85"]
    for size in [20] * 600 + [400] * 60:
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, size)))
        assert np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for _ in range(100):
        text = "".join(draw.choice("abeinth") for _ in range(draw.randint(50, 900)))
        assert np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_and_decoded_texts_beside_other_columns(odd, library):
    out = bpe.encode_texts(odd)
    assert set(out.columns) == {*odd.columns, "ids", "decoded"}
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
