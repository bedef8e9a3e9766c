"""Hidden Markov language model, trained by Baum-Welch over all training documents.

Words are read as 64-bit names and counted over the whole corpus. A word with at least one
in 32,768 of all tokens has a symbol of its own (there can't be more than 32,768 of them);
the others share 512 symbols by name, and inside its symbol each has a share by its count,
with one more share for all unseen words. So the model is a proper distribution over texts
of words, and the tables that tasks get are bounded whatever the vocabulary. The counts of
rare words reach the documents that hold them by a join on the name.

Training starts from the corpus counts of the symbols with seeded noise, and every round is
a pass over all training documents: expected counts are added up per task, then by slices of symbols across tasks. The scaled forward
recursion gives each document's exact likelihood under the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import ONE, TWO, each_part, mix, pack, stored, table, text_bytes, unpack

HEAVY = 1 << 15
TAIL = 512
STATES = 8
ROUNDS = 5
"""Baum-Welch passes, each over all training documents."""
SLICES = 16
CHUNK_BYTES = 1 << 18
PACK_BYTES = 1 << 21
RARE_BYTES = 1 << 19
ANSWERS = 2_000_000
"""Answers about rare words that are summed by document at a time."""
BATCH_TOKENS = 300_000
"""Tokens whose forward scores are kept at once."""
SMOOTH = 200.0
"""Tokens' worth of the plain symbol shares added to each state's emissions."""

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, name) of every word in order; A-Z counts as a-z."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    power = np.cumprod(np.full(int(place.max()) + 1, TWO, np.uint64))
    name = mix(np.add.reduceat(_BYTE[data[at]] * power[place], first))
    return np.searchsorted(begins, at[first], side="right") - 1, name


def _chunks(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts, start, held = batch.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


# -- counts over the corpus ------------------------------------------------------------------
def count_words(docs: DataFrame, parts: int) -> DataFrame:
    """(part, n, v, blob): training counts of every word, packed by part of the vocabulary."""

    def count(batches):
        held, size = [], 0
        for _, texts in _chunks(batches, 0):
            held.append(word_names(texts)[1])
            size += sum(map(len, texts))
            if size >= 4 * PACK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        name, n = np.unique(np.concatenate(held), return_counts=True)
        return pack((name % np.uint64(parts)).astype(np.int64), [name.view(np.int64), n])

    def add_up(batches):
        for blobs, _ in each_part(batches):
            name, n = _summed(unpack(blobs, 2))
            out = pack(np.zeros(len(name), np.int64), [name.view(np.int64), n])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(name[0] % np.uint64(parts))]),
                    pa.array([int(n.sum())]),
                    pa.array([len(n)]),
                    out.column(1),
                ],
                ["part", "n", "v", "blob"],
            )

    return (
        docs.select("text")
        .mapInArrow(count, "part long, blob binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(add_up, "part long, n long, v long, blob binary")
    )


def _summed(columns) -> tuple[np.ndarray, np.ndarray]:
    name, n = columns[0].view(np.uint64), columns[1]
    order = np.argsort(name, kind="stable")
    name, n = name[order], n[order]
    at = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
    return name[at], np.add.reduceat(n, at) if len(at) else n


class Symbols:
    """Bounded tables: names and counts of heavy words, totals of the shared symbols."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, tail_n: np.ndarray, tail_v: np.ndarray, words: int, kinds: int, ends: int):
        self.heavy, self.counts = heavy, counts
        self.total = words + ends
        self.kinds = kinds + (ends > 0)
        self.ends = ends
        # symbols: heavy words, shared ones, the end
        self.size = len(heavy) + TAIL + 1
        self.plain = np.r_[counts, tail_n, ends].astype(float)
        self.share = np.log10(tail_n + tail_v + 1.0)
        self.base = math.log10(self.total + self.kinds + 1)
        self.heavy_log = np.log10(counts + 1.0)

    def of(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, whether it is the word's own)."""
        at = np.searchsorted(self.heavy, name)
        own = np.zeros(len(name), bool)
        inside = at < len(self.heavy)
        own[inside] = self.heavy[at[inside]] == name[inside]
        return np.where(own, at, len(self.heavy) + (name % np.uint64(TAIL)).astype(np.int64)), own


def read_symbols(counts: DataFrame, ends: int) -> Symbols:
    n, v = counts.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    total = n + ends

    def split(batches):
        for batch in batches:
            name, c = unpack(batch.column(3).to_pylist(), 2)
            heavy = c * HEAVY >= total
            tail = (name.view(np.uint64)[~heavy] % np.uint64(TAIL)).astype(np.int64)
            tail_n, tail_v = np.bincount(tail, c[~heavy], TAIL), np.bincount(tail, minlength=TAIL)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.ones(heavy.sum()), np.zeros(TAIL)].astype(np.int64)),
                    pa.array(np.r_[name[heavy], np.arange(TAIL)]),
                    pa.array(np.r_[c[heavy], tail_n.astype(np.int64)]),
                    pa.array(np.r_[np.zeros(heavy.sum(), np.int64), tail_v]),
                ],
                ["heavy", "name", "n", "v"],
            )

    rows = (
        counts.mapInArrow(split, "heavy long, name long, n long, v long")
        .groupBy("heavy", "name")
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        .collect()  # at most HEAVY + TAIL rows
    )
    heavy = sorted((np.int64(r.name).view(np.uint64), r.n) for r in rows if r.heavy)
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in rows:
        if not r.heavy:
            tail_n[r.name], tail_v[r.name] = r.n, r.v
    return Symbols(
        np.array([h for h, _ in heavy], np.uint64), np.array([c for _, c in heavy], np.int64), tail_n, tail_v, n, v, ends
    )


# -- the model ---------------------------------------------------------------------------------
class Model:
    """start (K), move (K, K), emit (symbols, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first_guess(cls, plain: np.ndarray, states: int, seed: int = 1) -> Model:
        noise = np.random.default_rng(seed).uniform(0.2, 1.8, (len(plain), states))
        emit = (plain[:, None] + 0.5) * noise
        move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, plain: np.ndarray) -> Model:
        share = (plain + 0.5) / (plain + 0.5).sum()
        emit = emit + SMOOTH * share[:, None]
        start, move = start + 1.0, move + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences, longest first, in groups of about BATCH_TOKENS tokens."""
    order, held, size = sorted(range(len(seqs)), key=lambda i: -len(seqs[i])), [], 0
    for i in order:
        held.append(i)
        size += len(seqs[i])
        if size >= BATCH_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by time, how many sequences go on at each time); longest first."""
    lens = np.array([len(s) for s in seqs])
    active = len(seqs) - np.searchsorted(np.sort(lens), np.arange(lens[0]), side="right")
    time = np.concatenate([np.arange(n) for n in lens])
    order = np.argsort(time, kind="stable")
    return np.concatenate(seqs)[order], active


def forward(model: Model, symbols: np.ndarray, active: np.ndarray, keep: bool = False):
    """(natural log likelihood of each sequence, scaled forward scores, scales)."""
    total = np.zeros(active[0])
    ends = np.cumsum(active)
    seen = model.emit[symbols] if keep else None
    scores, scales, a = [], [], None
    for t, n in enumerate(active.tolist()):
        at = ends[t] - n
        now = seen[at : at + n] if keep else model.emit[symbols[at : at + n]]
        a = now * model.start if a is None else (a[:n] @ model.move) * now
        c = a.sum(1)
        a /= c[:, None]
        total[:n] += np.log(c)
        if keep:
            scores.append(a)
            scales.append(c)
    return total, scores, scales


class Expected:
    """Expected counts of a Baum-Welch step."""

    def __init__(self, size: int, states: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        self.log = 0.0

    def add(self, model: Model, seqs: list[np.ndarray]) -> None:
        for group in _batches(seqs):
            symbols, active = _by_time([seqs[i] for i in group])
            total, scores, scales = forward(model, symbols, active, keep=True)
            self.log += float(total.sum())
            seen = model.emit[symbols]
            gamma = np.empty_like(seen)
            moves = np.zeros_like(self.move)
            ends = np.cumsum(active)
            b = np.ones((0, seen.shape[1]))
            for t in range(len(active) - 1, -1, -1):
                n = int(active[t])
                if len(b) < n:
                    b = np.concatenate([b, np.ones((n - len(b), seen.shape[1]))])
                at = ends[t] - n
                gamma[at : at + n] = scores[t] * b
                if t:
                    w = seen[at : at + n] * b
                    w /= scales[t][:, None]
                    moves += scores[t - 1][:n].T @ w
                    b = w @ model.move.T
            self.start += gamma[: active[0]].sum(0)
            self.move += moves * model.move
            for k in range(gamma.shape[1]):
                self.emit[:, k] += np.bincount(symbols, gamma[:, k], len(self.emit))


def _open(blobs: list[bytes]) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(b), "<u2") for b in blobs]


def full_pass(coded: DataFrame, model: Model, plain: np.ndarray) -> Model:
    """One Baum-Welch step over all training rows; expected counts are added by slices."""
    given = coded.sparkSession.sparkContext.broadcast(model)
    size, states = model.emit.shape
    width = -(-size // SLICES)

    def expect(batches):
        e, any_rows = Expected(size, states), False
        for batch in batches:
            any_rows = True
            e.add(given.value, _open(batch.column(0).to_pylist()))
        if any_rows:
            press = zstandard.ZstdCompressor(level=1).compress
            parts = [e.emit[s * width : (s + 1) * width] for s in range(SLICES)] + [np.r_[e.start, e.move.ravel()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES + 1), pa.int64()), pa.array([press(p.tobytes()) for p in parts], pa.binary())],
                ["part", "blob"],
            )

    def add_up(batches):
        press = zstandard.ZstdDecompressor()
        now, total = None, None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(press.decompress(blob))
                if part != now and now is not None:
                    yield one(now, total)
                total = total + counts if part == now else counts
                now = part
        if now is not None:
            yield one(now, total)

    def one(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()], pa.binary())], ["part", "blob"])

    rows = (
        coded.where("train")
        .select("symbols")
        .mapInArrow(expect, "part long, blob binary")
        .repartition(SLICES, "part")
        .sortWithinPartitions("part")
        .mapInArrow(add_up, "part long, blob binary")
        .collect()  # the model's own size
    )
    if not rows:
        return model
    found = {r.part: np.frombuffer(r.blob) for r in rows}
    emit = np.concatenate([found[s] for s in range(SLICES)]).reshape(-1, states)
    start, move = found[SLICES][:states], found[SLICES][states:].reshape(states, states)
    return Model.from_counts(start, move, emit, plain)


# -- the jobs ------------------------------------------------------------------------------------
def encode(docs: DataFrame, symbols) -> DataFrame:
    """(doc_id, mark, train, n_tokens, known, own_log, share_log, symbols, rare) of every document.

    ``rare``: names of the words without own symbol, sorted, eight bytes each.
    """

    def work(batches):
        s, press = symbols.value, zstandard.ZstdCompressor(level=1).compress
        end = s.size - 1
        for piece, texts in _chunks(batches, 3):
            doc, name = word_names(texts)
            symbol, own = s.of(name)
            m = len(texts)
            n = np.bincount(doc, minlength=m)
            known = np.bincount(doc, own, m).astype(np.int64) + (s.ends > 0)
            own_log = np.bincount(doc[own], s.heavy_log[symbol[own]], m) + math.log10(s.ends + 1)
            # of no words at all, bincount makes integers
            share_log = np.bincount(doc[~own], s.share[symbol[~own] - len(s.heavy)], m).astype(float)
            rest = name[~own][np.lexsort((name[~own], doc[~own]))]
            cuts = np.r_[0, np.cumsum(np.bincount(doc[~own], minlength=m))].tolist()
            rare = [rest[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            starts = np.r_[0, np.cumsum(n)]
            coded = [
                press(np.r_[symbol[a:b], end].astype("<u2").tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:3], *(pa.array(x) for x in (n + 1, known, own_log, share_log)), *(pa.array(x, pa.binary()) for x in (coded, rare))],
                ["doc_id", "mark", "train", "n_tokens", "known", "own_log", "share_log", "symbols", "rare"],
            )

    return docs.select("doc_id", "mark", "train", "text").mapInArrow(
        work,
        "doc_id long, mark long, train boolean, n_tokens long, known long, own_log double, share_log double, symbols binary, rare binary",
    )


def rare_words(coded: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, mark, rare_known, rare_log): training counts of the words without own symbol."""

    def ask(batches):
        held, size = [], 0
        for piece, names in _chunks(batches, 2):
            name = np.frombuffer(b"".join(names), "<u8").astype(np.uint64)
            doc = np.repeat(np.arange(len(names)), [len(x) // 8 for x in names])
            at = _firsts(doc, name)
            times = np.diff(np.r_[at, len(doc)])
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            held.append((name[at].view(np.int64), ids[doc[at]], piece.column(1).to_numpy()[doc[at]], times))
            size += 8 * len(name)
            if size >= RARE_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        name, doc, mark, times = (np.concatenate(x) for x in zip(*held))
        out = pack((name.view(np.uint64) % np.uint64(parts)).astype(np.int64), [name, doc, mark, times])
        return out.append_column("kind", pa.array(np.ones(out.num_rows, np.int32)))

    def answer(batches):
        name, n, now, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, [], 0
        for batch in batches:
            for part, blob, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (part != now or size > ANSWERS):
                    yield _by_document(held, parts)
                    held, size = [], 0
                if part != now:
                    now, name, n = part, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == 0:
                    name, n = unpack([blob], 2)
                    name = name.view(np.uint64)
                    continue
                asked, doc, mark, times = unpack([blob], 4)
                asked = asked.view(np.uint64)
                at = np.minimum(np.searchsorted(name, asked), max(len(name) - 1, 0))
                c = np.where(name[at] == asked, n[at], 0) if len(name) else np.zeros(len(asked), np.int64)
                held.append((doc, mark, np.where(c > 0, times, 0), times * np.log10(c + 1.0)))
                size += len(doc)
        if held:
            yield _by_document(held, parts)

    def add_up(batches):
        for blobs, _ in each_part(batches):
            doc, mark, known, log = unpack(blobs, 4)
            order = np.lexsort((mark, doc))
            doc, mark, known, log = doc[order], mark[order], known[order], log.view(np.float64)[order]
            first = _firsts(doc, mark)
            if len(first):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[first]),
                        pa.array(mark[first]),
                        pa.array(np.add.reduceat(known, first)),
                        pa.array(np.add.reduceat(log, first)),
                    ],
                    ["doc_id", "mark", "rare_known", "rare_log"],
                )

    asked = coded.select("doc_id", "mark", "rare").mapInArrow(ask, "part long, blob binary, kind int")
    both = asked.unionByName(counts.select("part", "blob", F.lit(0).alias("kind")))
    return (
        both.repartition(parts, "part")
        .sortWithinPartitions("part", "kind")
        .mapInArrow(answer, "part long, blob binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(add_up, "doc_id long, mark long, rare_known long, rare_log double")
    )


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group starts."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _by_document(held: list, parts: int) -> pa.RecordBatch:
    """Sums of answers by document, packed by part of the documents."""
    doc, mark, known, log = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((mark, doc))
    doc, mark, known, log = doc[order], mark[order], known[order], log[order]
    first = _firsts(doc, mark)
    if len(first):
        known, log = np.add.reduceat(known, first), np.add.reduceat(log, first)
    doc, mark = doc[first], mark[first]
    return pack(doc % parts, [doc, mark, known, log.view(np.int64)])


def likelihoods(coded: DataFrame, model: Model) -> DataFrame:
    """``coded`` without its symbols, with ``model_log``: log10 of the symbols' probability."""
    given = coded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in coded.columns if c != "symbols"]
    at = coded.columns.index("symbols")

    def work(batches):
        for batch in batches:
            seqs = _open(batch.column(at).to_pylist())
            log = np.zeros(len(seqs))
            for group in _batches(seqs):
                log[group] = forward(given.value, *_by_time([seqs[i] for i in group]))[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(log / math.log(10))], [*kept, "model_log"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema if f.name != "symbols")
    return coded.mapInArrow(work, f"{schema}, model_log double")


def score_documents(docs: DataFrame, train, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    ``train``: condition that a row is learned from; null counts as no. ``base_score`` is the
    smoothed unigram log10 probability, ``score`` the model's. Null text: no words, the end
    alone. Null ids and repeated rows: a row each. No training rows: every probability is
    that of an untrained model. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark")
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), mark, F.coalesce(train, F.lit(False)).alias("train"), text_bytes()
    )
    learned = source.where("train")
    counts = stored(count_words(learned, parts), "counts")
    table_ = read_symbols(counts, learned.count())
    symbols = spark.sparkContext.broadcast(table_)
    coded = stored(encode(source, symbols), "coded")
    model = Model.first_guess(table_.plain, states)
    for _ in range(rounds):
        trained = full_pass(coded, model, table_.plain)
        if trained is model:  # nothing to learn from
            break
        model = trained
    # null ids meet as -1 does: the mark tells their texts apart
    key = F.coalesce("doc_id", F.lit(-1))
    rare = rare_words(coded.withColumn("doc_id", key), counts, parts).withColumnRenamed("doc_id", "key")
    # equal rows ask twice, so each has its own share of the answers
    rows = likelihoods(coded.drop("rare"), model).withColumn("key", key)
    twins = coded.groupBy(key.alias("key"), "mark").agg(F.count("*").alias("twins"))
    joined = rows.join(twins, ["key", "mark"]).join(rare, ["key", "mark"], "left")
    rare_log = F.coalesce(F.col("rare_log") / F.col("twins"), F.lit(0.0))
    rare_known = F.coalesce((F.col("rare_known") / F.col("twins")).cast("long"), F.lit(0))
    return joined.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known).alias("n_known"),
        F.lit(table_.total).cast("long").alias("train_tokens"),
        (F.col("own_log") + rare_log - F.col("n_tokens") * table_.base).alias("base_score"),
        (F.col("model_log") + rare_log - F.col("share_log")).alias("score"),
    )


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    return score_documents(table(spark, sf_dir, "documents"), train)


QUERIES = {"op3_hidden_markov": op3_hidden_markov}
