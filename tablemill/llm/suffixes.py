"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every byte offset starts in a bucket named by its q-gram; the name of a longer string is
made from the name of its first half and the name found at a later offset, and names once
made are reused for the next length (1, 2, 4, 8, 16, 32, then the full length). What equal
strings need is equal names, so no suffix is ever compared byte by byte.

To keep most offsets out of the shuffle, a string of ``LENGTH`` bytes is looked up in one
bucket only: the smallest q-gram name inside it. Neighbouring strings with one smallest name
form a run, and a run is one record. Then:

1. Inside a chunk of documents, a run that a smaller document of the chunk holds as well is
   covered at once. What is left goes to the bucket's part, packed.
2. In a part, records are sorted by bucket, run and document. Runs that a smaller document
   holds are covered. A bucket with one run is done. Runs of a bucket that differ but agree
   in the names next to the q-gram, on one side at least, may share strings: undecided.
3. Undecided runs are refined to their single strings, which meet by full name.

Documents then lose what is covered. Names are 64-bit; a run is known by 88 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import (
    ONE,
    TWO,
    each_part,
    map_rows,
    mix,
    opened,
    pack,
    squeezed,
    stored,
    table,
    text_bytes,
    unpack,
    with_columns,
)

LENGTH = 50
GRAM = 16
NEXT_TO = (LENGTH - GRAM) // 2
"""Bytes that a string with a given q-gram has beyond it on one side at least."""
CHUNK_BYTES = 1 << 21
"""Text whose records are packed together."""
SPAN = 1 << 16
"""Strings that are named at a time: their names fit in a processor's cache."""
PART_BYTES = 1 << 23
"""Bytes of text whose records one part holds."""
WILD = 1

_PARTS = "part long, blob binary"


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _pair(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Name of a string from the names at its start and at a later offset."""
    x = first * ONE
    x += later
    x ^= x >> np.uint64(32)
    x *= TWO
    x ^= x >> np.uint64(31)
    return x


class Names:
    """Names of the strings of several lengths at every offset of ``data``."""

    def __init__(self, data: np.ndarray):
        names = {1: _BYTE[data]}
        for n in (1, 2, 4, 8, 16):
            a = names[n]
            names[2 * n] = _pair(a[:-n], a[n:]) if len(a) > n else a[:0]
        self.of = names

    def length(self, n: int) -> np.ndarray:
        """Names of length ``n`` by the binary parts of ``n``."""
        at, out = 0, None
        size = max(len(self.of[1]) - n + 1, 0)
        for part in (32, 16, 8, 4, 2, 1):
            while n - at >= part:
                piece = self.of[part][at : at + size]
                out = piece if out is None else _pair(out, piece)
                at += part
        return out


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def _spans(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, list, list]]:
    """(ids, marks, first offsets, bytes) of texts, for up to about SPAN bytes at a time.

    A text longer than that is cut into pieces that overlap by one string less a byte.
    """
    ids, marks, firsts, parts, held = [], [], [], [], 0
    most = SPAN - length
    for batch in batches:
        for doc_id, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if doc_id is None or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, most - length):
                piece = text[at : at + most - 1]
                if held and held + len(piece) > most:
                    yield ids, marks, firsts, parts
                    ids, marks, firsts, parts, held = [], [], [], [], 0
                ids.append(doc_id)
                marks.append(mark)
                firsts.append(at)
                parts.append(piece)
                held += len(piece)
    if held:
        yield ids, marks, firsts, parts


_FOUND = "kind int, doc_id long, mark long, ranges binary"
"""Ranges of one document as pairs (first, last) of 32 bits. kind 0: the strings that start
there are covered; 1: undecided."""


def _found(kind: int, doc, mark, first, last) -> pa.RecordBatch:
    order = np.lexsort((first, mark, doc))
    doc, mark, first, last = doc[order], mark[order], first[order], last[order]
    at = np.flatnonzero(_groups(doc, mark))
    pairs = np.stack([first, last], 1).astype("<i4")
    ranges = [pairs[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(doc[at]), pa.array(mark[at]), pa.array(ranges, pa.binary())],
        ["kind", "doc_id", "mark", "ranges"],
    )


def _all_ranges(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64)


def _merged(doc, mark, first, last):
    """Ranges of one document that touch, as one; sorted."""
    if not len(doc):
        return doc, mark, first, last
    order = np.lexsort((first, mark, doc))
    doc, mark, first, last = doc[order], mark[order], first[order], last[order]
    other = _groups(doc, mark)
    # a running maximum inside each document: a step for each keeps them apart
    step = np.cumsum(other) * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + step) - step
    at = np.flatnonzero(other | np.r_[True, first[1:] > reach[:-1] + 1])
    ends = np.r_[at[1:], len(doc)] - 1
    return doc[at], mark[at], first[at], reach[ends]


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new group starts."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _covered(doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Whether the group's first (smallest) document is smaller."""
    at = np.flatnonzero(new)
    return doc > doc[at][np.cumsum(new) - 1]


def _smaller_inside(group_keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Which records have their group also in a smaller document; any order."""
    order = np.lexsort((doc, *group_keys))
    new = _groups(*(k[order] for k in group_keys))
    out = np.empty(len(doc), bool)
    out[order] = _covered(doc[order], new)
    return out


def _runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, gram: int):
    """(piece, first, last, bucket, code) of the runs of every piece of ``data``.

    ``bucket``: 48 bits of the smallest q-gram name. ``code``: 40 bits of the names of all
    strings of the run, then ten bits of the name before and ten of the name after the q-gram.
    """
    names = Names(data)
    grams, whole, side = names.length(gram), names.length(length), names.of[16]
    width = length - gram + 1
    # the place of a q-gram travels in the low bits: the leftmost and the rightmost smallest
    place = np.arange(len(grams), dtype=np.uint64)
    grams >>= np.uint64(16)
    grams <<= np.uint64(16)
    left = _lowest(grams | place, width)
    right = _lowest(grams | (np.uint64(0xFFFF) - place), width)
    lowest = left >> np.uint64(16)
    n = len(lowest)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = np.r_[True, lowest[1:] != lowest[:-1]]
    new[start] = True
    new |= ~inside
    at = np.flatnonzero(new)
    end = np.r_[at[1:], n] - 1
    real = inside[at]
    at, end = at[real], end[real]
    piece = np.searchsorted(start, at, side="right") - 1
    total = np.r_[np.uint64(0), np.cumsum(whole)]
    code = mix(total[end + 1] - total[at] + (end - at).astype(np.uint64) * TWO)
    a = (left[at] & np.uint64(0xFFFF)).astype(np.int64)
    tie = a != (np.uint64(0xFFFF) - (right[end] & np.uint64(0xFFFF))).astype(np.int64)
    low, high = start[piece], start[piece] + size[piece]
    code >>= np.uint64(24)
    for where in (a - NEXT_TO, a + gram + NEXT_TO - 16):
        there = (where >= low) & (where + 16 <= high)
        name = np.where(there, side[np.where(there, where, 0)] % np.uint64(1022) + np.uint64(2), np.uint64(0))
        code = (code << np.uint64(10)) | np.where(tie, np.uint64(WILD), name)
    return piece, at - low, end - low, lowest[at], code


def _gather(batches, parts: int, length: int, gram: int):
    """Packed records (bucket, code, doc, mark, first, strings after the first)."""
    held, size = [], 0
    for ids, marks, firsts, texts in _spans(batches, length):
        sizes = np.array([len(t) for t in texts], np.int64)
        start = np.r_[0, np.cumsum(sizes)[:-1]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        piece, first, last, bucket, code = _runs(data, start, sizes, length, gram)
        more, first = last - first, first + np.array(firsts, np.int64)[piece]
        held.append((bucket, code, np.array(ids, np.int64)[piece], np.array(marks, np.int64)[piece], first, more))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield from _pack_runs(held, parts)
            held, size = [], 0
    if held:
        yield from _pack_runs(held, parts)


def _pack_runs(held: list, parts: int):
    bucket, code, doc, mark, first, more = (np.concatenate(x) for x in zip(*held))
    done = _smaller_inside((code >> np.uint64(20), bucket), doc)
    if done.any():
        # covered already: needs no meeting, so any part will do; bucket and code are zero
        d, m, f, t = _merged(doc[done], mark[done], first[done], first[done] + more[done])
        none = np.zeros(len(d), np.int64)
        yield pack(d % parts, [none, none, d, m, f, t - f])
    go = ~done
    bucket = bucket[go].astype(np.int64)
    yield pack(bucket % parts, [bucket, *(x[go] for x in (code.view(np.int64), doc, mark, first, more))])


def _settle(columns) -> Iterator[pa.RecordBatch]:
    bucket, code, doc, mark, first, more = columns
    code = code.view(np.uint64)
    ready = (bucket == 0) & (code == 0)
    run = code >> np.uint64(20)
    order = np.lexsort((doc, run, bucket))
    bucket, run, code, doc, mark, first, more, ready = (
        x[order] for x in (bucket, run, code, doc, mark, first, more, ready)
    )
    done = ready | _covered(doc, _groups(bucket, run))
    if done.any():
        yield _found(0, *_merged(doc[done], mark[done], first[done], first[done] + more[done]))
    go = ~done
    bucket, run, code, doc, mark, first, more = (x[go] for x in (bucket, run, code, doc, mark, first, more))
    if not len(bucket):
        return
    group = np.cumsum(_groups(bucket)) - 1
    several = np.zeros(group[-1] + 1, bool)
    several[group[np.r_[False, (bucket[1:] == bucket[:-1]) & (run[1:] != run[:-1])]]] = True
    wild = np.zeros_like(several)
    wild[group[(code & np.uint64(0x3FF)) == WILD]] = True
    undecided = several[group] & wild[group]
    for shift in (0, 10):
        side = (code >> np.uint64(shift)) & np.uint64(0x3FF)
        rows = np.flatnonzero(several[group] & (side > WILD))
        if not len(rows):
            continue
        o = rows[np.lexsort((run[rows], side[rows], group[rows]))]
        new = _groups(group[o], side[o])
        cell = np.cumsum(new) - 1
        mixed = np.zeros(cell[-1] + 1, bool)
        mixed[cell[1:][~new[1:] & (run[o][1:] != run[o][:-1])]] = True
        undecided[o[mixed[cell]]] = True
    if undecided.any():
        u = undecided
        yield _found(1, doc[u], mark[u], first[u], first[u] + more[u])


def _undecided_bytes(batches, length: int, gram: int, parts: int):
    """The bytes of undecided runs, sent to the part of their bucket.

    A packed row: (doc, mark, first, strings, q-gram bucket) of each run, and all their bytes.
    """
    for batch in batches:
        held, texts, size = [], [], 0
        columns = [c.to_pylist() for c in batch.columns]
        for doc_id, mark, text, ranges in zip(*columns[:2], opened(columns[2]), columns[3]):
            for first, last in _all_ranges(ranges).tolist():
                for at in range(first, last + 1, SPAN // 2):
                    strings = min(last + 1 - at, SPAN // 2)
                    held.append((doc_id, mark, at, strings))
                    texts.append(text[at : at + strings + length - 1])
                    size += strings
            if size >= CHUNK_BYTES:
                yield _pack_bytes(held, texts, gram, parts)
                held, texts, size = [], [], 0
        if held:
            yield _pack_bytes(held, texts, gram, parts)


def _pack_bytes(held: list, texts: list[bytes], gram: int, parts: int) -> pa.RecordBatch:
    doc, mark, first, strings = (np.array(x, np.int64) for x in zip(*held))
    bucket = np.empty(len(held), np.int64)
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    grams = Names(np.frombuffer(b"".join(texts), np.uint8)).length(gram) >> np.uint64(16)
    # every string of a run has one smallest q-gram, which is the smallest of its first string
    width = int(lens[0] - strings[0] + 1) - gram + 1
    at = (ends - lens)[:, None] + np.arange(width)
    for a in range(0, len(held), 1 << 14):
        bucket[a : a + (1 << 14)] = grams[at[a : a + (1 << 14)]].min(1).astype(np.int64)
    out = pack(bucket % parts, [doc, mark, first, strings])
    order = np.argsort(bucket % parts, kind="stable")
    part = (bucket % parts)[order]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    bodies = []
    for p in out.column(0).to_pylist():
        a, b = np.searchsorted(part, [p, p + 1])
        bodies.append(squeeze(b"".join([texts[i] for i in order[a:b].tolist()])))
    return out.append_column("body", pa.array(bodies, pa.binary()))


def _meet(columns, bodies: list[bytes], length: int):
    """Single strings of undecided runs, by full name."""
    doc, mark, first, strings = columns
    data = np.frombuffer(b"".join(bodies), np.uint8)
    names = Names(data).length(length)
    starts = np.r_[0, np.cumsum(strings + length - 1)[:-1]]
    which = np.repeat(np.arange(len(doc)), strings)
    inner = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(strings)[:-1]], strings)
    name = names[starts[which] + inner]
    done = _smaller_inside((name,), doc[which])
    if done.any():
        w, at = which[done], first[which[done]] + inner[done]
        yield _found(0, *_merged(doc[w], mark[w], at, at))


def covered_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, parts: int | None = None) -> DataFrame:
    """(doc_id, mark, ranges): strings that also start in a document of smaller id.

    ``docs``: (doc_id long, mark long, text binary), ``mark`` telling rows of one id apart.
    Null ids take no part. A document may have several rows, and a string may come twice.
    """
    if parts is None:
        conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(conf, -(-total // PART_BYTES))

    def gather(batches):
        return _gather(batches, parts, length, gram)

    def settle(batches):
        for blobs, _ in each_part(batches):
            yield from _settle(unpack(blobs, 6))

    def undecided_bytes(batches):
        return _undecided_bytes(batches, length, gram, parts)

    def meet(batches):
        for blobs, bodies in each_part(batches):
            yield from _meet(unpack(blobs, 4), [zstandard.ZstdDecompressor().decompress(b) for b in bodies], length)

    def to_parts(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    found = stored(to_parts(docs.mapInArrow(gather, _PARTS)).mapInArrow(settle, _FOUND), "runs")
    undecided = (
        found.where("kind = 1")
        .groupBy("doc_id", "mark")
        .agg(F.collect_list("ranges").alias("ranges"))
    )
    texts = squeezed(docs).join(undecided, ["doc_id", "mark"]).select("doc_id", "mark", "text", "ranges")
    single = stored(
        to_parts(texts.mapInArrow(undecided_bytes, f"{_PARTS}, body binary")).mapInArrow(meet, _FOUND), "strings"
    )
    return found.where("kind = 0").unionByName(single).select("doc_id", "mark", "ranges")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without ``text``, with ``kept``, ``kept_text``, ``n_bytes``, ``n_removed``, ``n_spans``.

    ``kept`` are the bytes left, ``kept_text`` the same without what is left of characters
    that were cut.

    A byte goes if it is inside a string of ``length`` bytes that also starts in a document
    of smaller id; matches never cross documents and are judged on the input. Null text:
    empty. Null id: neither removes nor loses anything. Rows of one id do not remove each
    other's bytes. Empty table: no rows. Other columns stay; columns of those names are
    replaced.
    """
    made = ("kept", "kept_text", "n_bytes", "n_removed", "n_spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]).alias("row")
    # 32 bits of the text tell rows of one id apart
    mark = (F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))).alias("mark")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark, text_bytes(), row)
    ranges = (
        covered_strings(keyed.drop("row"), length)
        .groupBy("doc_id", "mark")
        .agg(F.collect_list("ranges").alias("ranges"))
    )
    joined = squeezed(keyed).join(ranges, ["doc_id", "mark"], "left").select("row", "text", "ranges")

    def work(batch):
        out = []
        for text, ranges in zip(opened(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
            if not ranges:
                out.append((text, text.decode("utf-8", "ignore"), len(text), 0, 0))
                continue
            spans = _all_ranges(ranges) + (0, length)
            spans = spans[spans[:, 0].argsort(kind="stable")]
            reach = np.maximum.accumulate(spans[:, 1])
            at = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
            begins, ends = spans[at, 0], reach[np.r_[at[1:], len(spans)] - 1]
            kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))
            out.append((kept, kept.decode("utf-8", "ignore"), len(text), int((ends - begins).sum()), len(at)))
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], ["row", *made]
        )

    out = map_rows(joined, with_columns(joined, "kept binary, kept_text string, n_bytes long, n_removed long, n_spans long"), work)
    return out.select("row.*", *made)


def op10_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op10_suffix_buckets": op10_suffix_buckets}
