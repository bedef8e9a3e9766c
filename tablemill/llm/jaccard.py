"""N-gram Jaccard join in metric space: pivots, regions, rings, windows; exact.

The Jaccard distance d = 1 - J is a metric, and two sets link when d <= r. Work is done on
the distinct shingle sets ("nodes"), so copies cost nothing.

1. Pivots and regions. Linked sets differ in at most d = (1 - t) n / t shingles, n being the
   smaller size. All shingles are dealt by hash into more than d classes (more for larger
   sets, in bands of sizes), so linked sets agree in all shingles of some class. Nodes that
   agree in a class, with sizes that allow a link, have the smallest of them as pivot. The
   region of a pivot holds all nodes that have it as a pivot, so a node near several pivots
   is replicated to each, and every linked pair meets in some region. That a class has
   several shingles keeps common phrases from bringing strangers together. Only the first
   classes of a set are sent, as many as linked sets need to agree in several of them; a node
   that agrees with others in fewer has no link. A region within another one is left out.
2. Windows. A region that is small is joined at once. In a larger one the distances to the
   pivot are computed first, by parts of the region with the pivot in each. The ball of
   radius r is ring 0, and rings of width r lie around it. By the triangle inequality linked
   nodes lie in one ring or in neighbouring ones: each ring is a region of its own, with the
   inner ring's nodes replicated to it where the window reaches them. Rings too large for a
   task are cut into blocks by hash, and all pairs of blocks are joined.
3. Joining. All pairs that a region owns are compared by shared shingles, and each node's
   links are counted: a pair is owned by the smallest pivot that both nodes have, there by
   the outer one's ring, there by its pair of blocks. Of the links themselves only those
   that connect the region's components are given out.
4. Links join nodes to components by repeated smallest-neighbour steps.

Shingles and nodes are named by 64-bit hashes; link tests use whole sets and integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import (
    ONE,
    TWO,
    each_part,
    mix,
    opened,
    pack,
    squeezed,
    stored,
    table,
    text_bytes,
    unpack,
)

CHUNK_BYTES = 1 << 18
REGION = 2000
"""Nodes of a region or block that one task joins at once."""

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# -- shingle sets of a chunk ---------------------------------------------------------------
def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) without repeats, sorted; A-Z counts as a-z.

    A text with fewer words than a shingle gives one shingle of all its words; one without
    words gives none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    if not len(data):
        return none
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]]
    space = _SPACE[data]
    at = np.flatnonzero(~space)
    if not len(at):
        return none
    new = np.r_[True, at[1:] != at[:-1] + 1]
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    power = np.cumprod(np.full(int(place.max()) + 1, TWO, np.uint64))
    word = mix(np.add.reduceat(_BYTE[data[at]] * power[place], first))
    doc = np.searchsorted(begins, at[first], side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    size = len(word) - words + 1
    found_doc, found = [], []
    if size > 0:
        name = word[:size]
        for k in range(1, words):
            name = mix(name * ONE + word[k : k + size])
        whole = doc[:size] == doc[words - 1 :]
        found_doc.append(doc[:size][whole])
        found.append(name[whole])
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():
        a = np.searchsorted(doc, d)
        name = word[a : a + 1]
        for k in range(a + 1, a + int(count[d])):
            name = mix(name * ONE + word[k : k + 1])
        found_doc.append(np.array([d]))
        found.append(mix(name + np.uint64(count[d])))
    doc, name = np.concatenate(found_doc), np.concatenate(found)
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]
    return doc[keep], name[keep]


def _nodes(doc: np.ndarray, name: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, node) of every text; a node is the name of its set, 63 bits."""
    size = np.bincount(doc, minlength=n_texts)
    total = np.zeros(n_texts, np.uint64)
    np.add.at(total, doc, mix(name + np.uint64(1)))
    return size, (mix(total + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _chunks(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about CHUNK_BYTES of text."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


# -- pass 1: nodes of documents ---------------------------------------------------------------
_FIRST = "doc_id long, text_hash long, size long, node long"


def _first_pass(batches, words: int):
    for piece, texts in _chunks(batches, 2):
        size, node = _nodes(*shingle_sets(texts, words), len(texts))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array(size), pa.array(node, mask=size == 0)],
            ["doc_id", "text_hash", "size", "node"],
        )


# -- pass 2: regions -----------------------------------------------------------------------
def differences(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets can differ in, the smaller one having ``size``."""
    return (100 - percent) * size // percent


def least_agreeing(top: np.ndarray, percent: int) -> np.ndarray:
    """Keys that linked sets of a band with sizes up to ``top`` share, where they have them to spare."""
    return 1 + differences(top, percent) // 16


def class_keys(
    doc: np.ndarray, name: np.ndarray, size: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key) for classes of shingles of each text; (keys that a link needs) of each text.

    Band b is for pairs whose smaller set has 2^b to 2^(b+1) - 1 shingles; a text is in its
    own band, and in the one below if a linked set may be there. If a text's shingles fall
    into more classes than it can have differences, the surplus of them are the same in any
    linked set; else (rare, small sets) its empty classes get keys too, which meet those of
    other such sets, because a band has more classes than differences.

    Say that k = ``least_agreeing`` and that the surplus of one of two linked sets is k or
    more, so that k classes agree. After the k-th of these, in the order of class numbers,
    either set has so many more agreeing classes that it is among the first (differences + k)
    of the set's classes: only those get keys. A set with less than k to spare gives all its
    keys. So a text that has k to spare in every band shares k keys with each linked set.
    """
    docs, keys = [], []
    need = np.full(len(size), np.iinfo(np.int64).max)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    for below in (0, 1):
        band = own - below
        top = (1 << np.maximum(band + 1, 0)) - 1
        meets = (size > 0) & (band >= 0) & (-(-size * percent // 100) <= top)
        classes = np.where(meets, differences(top, percent) * 6 // 5 + 2, 0)
        use = meets[doc]
        d, n = doc[use], name[use]
        if not len(d):
            continue
        number = (mix(n ^ TWO) % classes[d].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((number, d))
        d, n, number = d[order], n[order], number[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (number[1:] != number[:-1])])
        total = np.add.reduceat(mix(n), first)
        d, number = d[first], number[first]
        filled = np.bincount(d, minlength=len(size))
        most, least = differences(np.minimum(size, top), percent), least_agreeing(top, percent)
        spare = filled - most >= least
        need = np.where(meets, np.minimum(need, np.where(spare, least, 1)), need)
        rank = np.arange(len(d)) - (np.cumsum(filled) - filled)[d]
        sent = rank < np.where(spare, most + least, filled)[d]
        docs.append(d[sent])
        keys.append(mix(total + mix((number * 64 + band[d]).astype(np.uint64)))[sent])
        short = np.flatnonzero(meets & (filled <= most))
        for k in short.tolist():
            a, b = np.searchsorted(d, [k, k + 1])
            empty = np.setdiff1d(np.arange(classes[k]), number[a:b])
            docs.append(np.full(len(empty), k))
            keys.append(mix(mix((empty * 64 + band[k]).astype(np.uint64)) + ONE))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), need
    return np.concatenate(docs), np.concatenate(keys), need


def _all_keys(batches, words: int, percent: int, parts: int):
    held, bytes_held = [], 0
    for _, texts in _chunks(batches, 0):
        doc, name = shingle_sets(texts, words)
        size, node = _nodes(doc, name, len(texts))
        doc, key, need = class_keys(doc, name, size, percent)
        order = np.argsort(doc, kind="stable")  # a text's keys stand together
        doc, key = doc[order], key[order]
        # 48 bits of a key: a chance meeting costs a comparison, no more
        held.append(((key >> np.uint64(16)).astype(np.int64), node[doc], size[doc], need[doc]))
        bytes_held += sum(map(len, texts))
        if bytes_held >= 16 * CHUNK_BYTES:
            yield _pack_keys(held, parts)
            held, bytes_held = [], 0
    if held:
        yield _pack_keys(held, parts)


def _pack_keys(held, parts: int) -> pa.RecordBatch:
    """Per part the keys, node by node, and beside them each node once, with its number of keys."""
    key, node, size, need = (np.concatenate(x) for x in zip(*held))
    one = np.sort(_distinct(key, node))  # copies in this chunk count once
    one = one[np.argsort(key[one] % parts, kind="stable")]
    key, node, size, need = key[one], node[one], size[one], need[one]
    part = key % parts
    at = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])][: len(part)])
    keys = pack(part, [key // parts])  # its part says the rest
    nodes = pack(part[at], [node[at], size[at], need[at], np.diff(np.r_[at, len(part)])])
    return pa.RecordBatch.from_arrays([*keys.columns, nodes.column(1)], ["part", "blob", "nodes"])


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]]


def _to_pivots(name: np.ndarray, nodes: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """(pivot, node, shared keys, keys needed) from the nodes that share each of a part's keys."""
    node, size, need, times = nodes
    node, size, need = (np.repeat(x, times) for x in (node, size, need))
    one = _distinct(name, node)
    name, node, size, need = name[one], node[one], size[one], need[one]
    order = np.lexsort((node, size, name))
    name, node, size, need = name[order], node[order], size[order], need[order]
    # a gap in sizes that no link can bridge parts a group
    new = np.r_[True, (name[1:] != name[:-1]) | (100 * size[:-1] < percent * size[1:])][: len(name)]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    many = np.diff(np.r_[at, len(name)]) > 1
    pivot = np.minimum.reduceat(node, at)[group] if len(at) else node
    keep = many[group]
    pivot, node, need = pivot[keep], node[keep], need[keep]
    order = np.lexsort((node, pivot))
    pivot, node, need = pivot[order], node[order], need[order]
    at = np.flatnonzero(np.r_[True, (pivot[1:] != pivot[:-1]) | (node[1:] != node[:-1])][: len(pivot)])
    columns = (pivot[at], node[at], np.diff(np.r_[at, len(pivot)]), need[at])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["pivot", "node", "shared", "need"])


def _worth_joining(met: DataFrame) -> DataFrame:
    """(pivot, node) of regions to join, from (pivot, node, shared, need).

    Nodes that share fewer keys than any link of theirs needs are left out, the smallest node
    that stays is the pivot, and regions of one pivot become one.
    """
    able = met.groupBy("node").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    left = met.select("pivot", "node").join(able.select("node"), "node")
    pivots = left.groupBy("pivot").agg(F.min("node").alias("least"), F.count("*").alias("nodes")).where("nodes > 1")
    return left.join(pivots, "pivot").select(F.col("least").alias("pivot"), "node").distinct()


def _outermost(regions: DataFrame) -> DataFrame:
    """The regions of (pivot, node) without those that lie within another one.

    The pivot is a region's smallest node, so a region around another has a smaller pivot,
    which all nodes of the inner one have too; the outermost of such a chain stays.
    """
    pivots = regions.groupBy("node").agg(F.collect_list("pivot").alias("pivots"))
    around = (
        pivots.select(F.explode("pivots").alias("pivot"), "pivots")
        .select("pivot", F.explode(F.filter("pivots", lambda x: x < F.col("pivot"))).alias("outer"))
        .groupBy("pivot", "outer")
        .agg(F.count("*").alias("nodes"))
    )
    sizes = regions.groupBy("pivot").agg(F.count("*").alias("nodes"))
    inner = around.join(sizes, ["pivot", "nodes"]).select("pivot").distinct()
    return regions.join(inner, "pivot", "left_anti")


# -- joining the nodes of one region ---------------------------------------------------------
class Overlaps:
    """How many elements each list has in common with every later one, list by list.

    Elements that many lists hold are counted by matrix products, the others by postings.
    """

    def __init__(self, lists: list[np.ndarray]):
        self.m = m = len(lists)
        sizes = np.array([len(x) for x in lists])
        member = np.repeat(np.arange(m), sizes)
        _, number, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        self.everywhere = bool((held == m).any())
        heavy = held > max(m // 5, 64)
        self.dense = np.zeros((m, m), np.float32) if heavy.any() else None
        column = np.cumsum(heavy) - 1
        for k in range(0, int(heavy.sum()), 512):
            at = heavy[number] & (column[number] >= k) & (column[number] < k + 512)
            x = np.zeros((m, 512), np.float32)
            x[member[at], column[number[at]] - k] = 1
            self.dense += x @ x.T
        light = (held > 1)[number] & ~heavy[number]
        member, number = member[light], number[light]
        self.mine, self.starts = number, np.searchsorted(member, np.arange(m + 1))
        order = np.argsort(number, kind="stable")
        self.posting = member[order]
        self.begin, self.end = (np.searchsorted(number[order], np.arange(len(held)), side=x) for x in ("left", "right"))

    def pop(self, p: int, wanted: bool = True) -> np.ndarray | None:
        """Counts with the lists after ``p``; to be called for 0, 1, 2 and so on."""
        mine = self.mine[self.starts[p] : self.starts[p + 1]]
        self.begin[mine] += 1  # p is the first that is left in each
        if not wanted:
            return None
        begin, n = self.begin[mine], self.end[mine] - self.begin[mine]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.bincount(self.posting[at], minlength=self.m)[p + 1 :]
        return found if self.dense is None else found + self.dense[p, p + 1 :].astype(np.int64)


def link_region(
    node: np.ndarray,
    sets: list[np.ndarray],
    percent: int,
    done: np.ndarray | None = None,
    home: np.ndarray | None = None,
    side: np.ndarray | None = None,
    lower: list[np.ndarray] | None = None,
    counts: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that join the region's nodes to the components that all its links give.

    ``counts``: the number of all links of each node is added to it. Every pair that the
    region owns is compared. It does not own pairs of nodes that are both not at ``home``,
    that are of one ``side`` (0 or more), or that meet in a region with a pivot in both
    ``lower``. ``done``: nodes known to be in one component already; their links are counted
    and not given.
    """
    m = len(node)
    if m < 2:
        return []
    theirs = Overlaps(lower) if lower is not None and sum(map(len, lower)) else None
    if theirs is not None and theirs.everywhere:
        return []
    sizes = np.array([len(s) for s in sets])
    shingles = Overlaps(sets)
    label = np.arange(m)
    if done is not None and done.any():
        label[done] = np.flatnonzero(done)[0]
    out = []
    for p in range(m - 1):
        owned = np.ones(m - 1 - p, bool)
        if home is not None and not home[p]:
            owned &= home[p + 1 :]
        if side is not None and side[p] >= 0:
            owned &= side[p + 1 :] != side[p]
        if theirs is not None:
            owned &= theirs.pop(p) == 0
        shared = shingles.pop(p, bool(owned.any()))
        if shared is None:
            continue
        linked = np.flatnonzero(owned & (100 * shared >= percent * (sizes[p] + sizes[p + 1 :] - shared))) + p + 1
        if not len(linked):
            continue
        if counts is not None:
            counts[p] += len(linked)
            counts[linked] += 1
        labels, fresh = np.unique(label[linked], return_index=True)
        other = labels != label[p]
        if other.any():
            out += [(int(node[p]), int(node[x])) for x in linked[fresh[other]].tolist()]
            label[np.isin(label, labels)] = label[p]
    return out


_LINK = "a long, b long, n long"
"""A link of ``a`` and ``b``; or, ``b`` being null, ``n`` links of ``a`` counted."""


def _links(pairs: list[tuple[int, int]], node: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    some = counts > 0
    rows = (
        [*a, *node[some].tolist()],
        [*b, *[None] * int(some.sum())],
        [*[0] * len(a), *counts[some].tolist()],
    )
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["a", "b", "n"])


def _with_sets(batches, names: list[str], words: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values of ``names``, shingles) of every row; texts travel compressed."""
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in names)))
        packed, start = batch.column("text").to_pylist(), 0
        texts, held = [], 0
        for i, text in enumerate(opened(packed)):
            texts.append(text)
            held += len(text)
            if held >= CHUNK_BYTES or i + 1 == len(packed):
                doc, name = shingle_sets(texts, words)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    yield rows[start + k], name[ends[k] : ends[k + 1]]
                texts, held, start = [], 0, i + 1


def _join_regions(batches, words: int, percent: int):
    """Rows (pivot, ring, node, done, home, side, lower, text) sorted by region: a region at a time.

    Rings hold home nodes and visitors from the ring inside; blocks have a ring number each,
    and in a pair of blocks each node has its block as ``side``.
    """
    now, region = None, {}
    names = ["pivot", "ring", "node", "done", "home", "side", "lower"]
    for (pivot, ring, node, *more), shingles in _with_sets(batches, names, words):
        if (pivot, ring) != now:
            if len(region) > 1:
                yield _join_region(region, percent)
            now, region = (pivot, ring), {}
        region[node] = (shingles.copy(), *more)
    if len(region) > 1:
        yield _join_region(region, percent)


def _join_region(region: dict, percent: int) -> pa.RecordBatch:
    sets, done, home, side, lower = zip(*region.values())
    node, counts = np.array(list(region), np.int64), np.zeros(len(region), np.int64)
    lower = [np.array(x, np.int64) for x in lower]
    pairs = link_region(node, list(sets), percent, np.array(done), np.array(home), np.array(side), lower, counts)
    return _links(pairs, node, counts)


def _pivot_distances(batches, words: int):
    """Rows (pivot, salt, node, text), the pivot first in each: shared shingles with it."""
    now, hub, out = None, np.zeros(0, np.uint64), []
    for (pivot, salt, node), mine in _with_sets(batches, ["pivot", "salt", "node"], words):
        if (pivot, salt) != now:
            now, hub = (pivot, salt), mine.copy()
        out.append((pivot, node, len(hub), len(mine), len(np.intersect1d(hub, mine, assume_unique=True))))
        if len(out) >= 4096:
            yield _met(out)
            out = []
    if out:
        yield _met(out)


def _met(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.int64()) for c in zip(*rows)], ["pivot", "node", "pivot_size", "size", "shared"]
    )


# -- the join --------------------------------------------------------------------------------
def link_nodes(docs: DataFrame, words: int, percent: int, parts: int | None = None, region: int = REGION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, text_hash, size, node), (a, b), (node, n_links)) of (doc_id long, text_hash long, text binary).

    Nodes of documents; links that connect the nodes; how many other nodes each node links
    with, all pairs counted once: by the region of the smallest pivot that both have.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = stored(docs.mapInArrow(lambda b: _first_pass(b, words), _FIRST), "nodes")

    def keys(batches):
        return _all_keys(batches, words, percent, parts)

    def pivots(batches):
        for blobs, nodes in each_part(batches):
            yield _to_pivots(unpack(blobs, 1)[0], unpack(nodes, 4), percent)

    # passed on without a name, so that its shuffle can be freed once it is stored
    met = stored(
        docs.select("text")
        .mapInArrow(keys, "part long, blob binary, nodes binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(pivots, "pivot long, node long, shared long, need long")
        .groupBy("pivot", "node")
        .agg(F.sum("shared").alias("shared"), F.max("need").alias("need")),
        "met",
    )
    regions = stored(_outermost(stored(_worth_joining(met), "reduced")), "regions")
    # one text for each node; equal texts under one id are equal rows
    chosen = members.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("of"))
    sizes = regions.groupBy("pivot").agg(F.count("*").alias("nodes"))
    places = (
        regions.join(sizes, "pivot")
        .groupBy("node")
        .agg(F.collect_list(F.struct("pivot", "nodes")).alias("places"))
        .join(chosen, "node")
        .select("node", "places", F.col("of.text_hash").alias("text_hash"), F.col("of.doc_id").alias("of_doc"))
    )
    texts = squeezed(docs)
    same = (texts["text_hash"] == places["text_hash"]) & texts["doc_id"].eqNullSafe(places["of_doc"])

    def placed() -> DataFrame:
        return places.join(texts, same).select("node", "places", "text")

    if sizes.where(F.col("nodes") > region).isEmpty():
        found = stored(_summed(_region_links(_small_regions(placed(), region), words, percent)), "links")
    else:
        kept = stored(placed(), "placed")
        small = _region_links(_small_regions(kept, region), words, percent)
        found = stored(_summed(small.unionByName(_ring_links(kept, words, percent, region))), "links")
    degrees = found.where("b IS NULL").select(F.col("a").alias("node"), F.col("n").alias("n_links"))
    return members, found.where("b IS NOT NULL").select("a", "b"), degrees


def _summed(found: DataFrame) -> DataFrame:
    """Each link once, and the sum of each node's counts."""
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _lower() -> Column:
    """The pivots of a node before this region's: a pair that shares one is counted there."""
    return F.filter(F.col("places.pivot"), lambda x: x < F.col("pivot")).alias("lower")


def _small_regions(placed: DataFrame, region: int) -> DataFrame:
    return (
        placed.select("node", "text", "places", F.inline("places"))
        .where(F.col("nodes") <= region)
        .select(
            "pivot",
            F.lit(0).cast("long").alias("ring"),
            "node",
            F.lit(False).alias("done"),
            F.lit(True).alias("home"),
            F.lit(-1).cast("long").alias("side"),
            _lower(),
            "text",
        )
    )


def _region_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    return (
        rows.repartition("pivot", "ring")
        .sortWithinPartitions("pivot", "ring", "node")
        .mapInArrow(lambda b: _join_regions(b, words, percent), _LINK)
    )


def _ring_links(placed: DataFrame, words: int, percent: int, region: int) -> DataFrame:
    """Links of large regions: by distance to the pivot, then ring by ring."""
    rows = placed.select("node", "text", F.inline("places")).where(F.col("nodes") > region)
    salts = F.ceil(F.col("nodes") / region)
    # the pivot stands first in every part of its region
    hubs = rows.where("node = pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    met = (
        rows.where("node != pivot")
        .withColumn("salt", F.pmod(F.xxhash64("node"), salts))
        .unionByName(hubs)
        .select("pivot", "salt", "node", "text", (F.col("node") != F.col("pivot")).alias("late"))
        .repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "late")
        .select("pivot", "salt", "node", "text")
        .mapInArrow(
            lambda b: _pivot_distances(b, words), "pivot long, node long, pivot_size long, size long, shared long"
        )
        .distinct()
    )
    union = F.col("pivot_size") + F.col("size") - F.col("shared")
    met = stored(
        met.withColumn("d", 1 - F.col("shared") / union).withColumn("near", 100 * F.col("shared") >= percent * union),
        "distances",
    )
    ball = met.where("near AND node != pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("n")
    )
    r, slack = 1 - percent / 100, 1e-9
    # ring k holds distances over k r up to and with (k + 1) r, as the ball, ring 0, does; in
    # integers, so that no rounding moves a node
    over = F.expr(f"(100 * (pivot_size + size - 2 * shared) - 1) div ({max(1, 100 - percent)} * (pivot_size + size - shared))")
    homes = met.select("pivot", "node", "d", "near", F.greatest(F.lit(0), over).cast("long").alias("ring"))
    nearest = homes.where("ring > 0").groupBy("pivot", "ring").agg(F.min("d").alias("from"))
    # visitors: nodes of the ring inside that the window of this ring's nearest node reaches
    visitors = (
        homes.withColumn("ring", F.col("ring") + 1)
        .join(nearest, ["pivot", "ring"])
        .where(F.col("d") >= F.col("from") - r - slack)
        .select("pivot", "node", "near", "ring", F.lit(False).alias("home"))
    )
    within = homes.select("pivot", "node", "near", "ring", F.lit(True).alias("home")).unionByName(visitors)
    counts = within.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    blocks = F.when(F.col("n") <= region, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / region)).cast("long")
    within = (
        within.join(counts, ["pivot", "ring"])
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    )
    # a pair of blocks is a region of its own: each node goes to the pairs that hold its block;
    # pairs of nodes inside one block are compared where the block is paired with itself
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(
            (F.least(k, F.col("block")) * F.col("blocks") + F.greatest(k, F.col("block"))).alias("pair"),
            F.when(k == F.col("block"), F.lit(-1)).otherwise(F.col("block")).cast("long").alias("side"),
        ),
    )
    split = within.select("pivot", "node", F.col("near").alias("done"), "home", "ring", F.inline(pair))
    split = split.withColumn("ring", F.xxhash64("ring", "pair")).join(placed.select("node", "text", "places"), "node")
    found = _region_links(split.select("pivot", "ring", "node", "done", "home", "side", _lower(), "text"), words, percent)
    return ball.unionByName(found)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for nodes that have links.

    Alternating steps: every node's larger neighbours move to its smallest neighbour, then
    its smaller ones do; edges become stars around the smallest in a few rounds.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        # settled when every node hangs on one root and no root hangs on another
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, n_links, component_id) per row of (doc_id, text).

    Sets of shingles of ``words`` words; link when 100 * shared >= ``percent`` * union.
    ``n_links`` counts the other sets that the document's set links with; documents of one
    set have the same number. ``component_id`` is the smallest doc_id that links reach. Null text or no words: no
    shingles, linked with nothing. Null id: takes part; its component has the smallest id
    there is, null if there is none. Repeated rows: each gets its row. Empty table: no rows.
    Other columns are not read.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_bytes()
    )
    members, links, degrees = link_nodes(source, words, percent)
    linked = degrees.join(components(links), "node", "left")
    with_class = members.join(linked, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = with_class.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    return with_class.join(smallest, "class", "left").select(
        "doc_id",
        "text_hash",
        F.col("size").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def op6_pivot_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85).drop("text_hash")


QUERIES = {"op6_pivot_jaccard": op6_pivot_jaccard}
