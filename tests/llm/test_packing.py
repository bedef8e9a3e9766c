import collections
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tablemill.llm import bpe, packing

SF = "/root/testdata/sf0.001"


def check_packed(rows, texts):
    """Every piece of every text once, right tokens, no gaps, nothing overfull."""
    library = Tokenizer.from_file(bpe.default_path())
    want = collections.Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def best_fit(lengths, capacity):
    """Plain best fit, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_whole_table(spark):
    rows = packing.op8_pattern_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    used = check_packed(rows, docs)
    assert used <= best_fit([r.length for r in rows], 4096)


def test_odd_rows(odd, odd_rows, none):
    check_packed(packing.pack_documents(odd).collect(), odd_rows)
    assert packing.pack_documents(none).collect() == []


def test_tokens_come_along(odd):
    for r in packing.pack_documents(odd, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_plans_are_whole_and_near_the_least():
    draw = random.Random(3)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        for _ in range(draw.randint(0, 40)):
            counts[draw.randint(1, 100)] += draw.choice([1, 2, 50, 1000])
        rows = packing.plan(counts, 100)
        fill = collections.Counter()
        ranks = collections.defaultdict(list)
        for length, first, end, sequence, offset in rows.tolist():
            ranks[length].append((first, end))
            for k in range(end - first):
                fill[sequence + k] += length
                assert offset + length <= 100
        for length, spans in ranks.items():
            at = 0
            for first, end in sorted(spans):
                assert first == at
                at = end
            assert at == counts[length]
        assert not fill or max(fill.values()) <= 100
        assert sum(fill.values()) == (counts * np.arange(101)).sum()
        lengths = np.repeat(np.arange(101), counts).tolist()
        assert len(fill) <= best_fit(lengths, 100) * 1.02 + 1
