"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes weighted counts of hashed terms: its words, their shapes, the pieces of runs
too long for a word (text written without blanks), and coarse classes of its length and of how much it repeats. A truncated singular value decomposition of a
bounded sample of labelled texts gives the latent space. The sample's vectors go to every
task, which multiplies blocks of document vectors with all of them: exact cosines, the
nearest neighbours, and a vote that weights their labels by similarity.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import ONE, TwoGenerations, map_rows, mix, process_cache, table, text_bytes, with_columns

SAMPLE = 3000
"""Labelled rows that are learned from at most, the smallest by hash of the id."""
WORDS, SHAPES, CLASSES = 1024, 512, 64
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 4
"""Power of the cosine that weights a vote."""
BLOCK = 512
LONG = 64
"""A run without blanks of more bytes gives its pieces as terms too ..."""
GRAM, SHAPE_GRAM = 4, 12
"""... all windows of so many characters of its text and of its shape."""
TERMS = WORDS + SHAPES + CLASSES

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")
_MANY = re.compile(r"(.)\1+")


def _hash(s: str, size: int) -> int:
    value = 14695981039346656037  # fixed values: FNV-1a, 64 bits
    for b in s.encode("utf-8", "replace"):
        value = (value ^ b) * 1099511628211 % 2**64
    return (value ^ value >> 32) % size


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one letter each; signs stay, once."""
    kinds = _LOWER.sub("x", _UPPER.sub("X", re.sub(r"[0-9]", "9", word)))
    return _MANY.sub(r"\1", kinds)


def _terms(word: bytes) -> int:
    """Word and shape term in one number."""
    text = word.decode("utf-8", "replace")
    return _hash(text.lower(), WORDS) * SHAPES + _hash(shape(text), SHAPES)


def _windows(text: str, width: int, size: int) -> np.ndarray:
    """How often each term is the hash of a window of ``width`` characters."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    n = max(0, len(c) - width + 1)
    name = np.zeros(n, np.uint64)
    for k in range(width):
        name = mix(name * ONE + c[k : k + n])
    return np.bincount((name % np.uint64(size)).astype(np.int64), minlength=size)


def _pieces(word: bytes) -> np.ndarray:
    """Counts of word and shape terms of all pieces of a long run."""
    text = word.decode("utf-8", "replace")
    return np.r_[_windows(text.lower(), GRAM, WORDS), _windows(shape(text), SHAPE_GRAM, SHAPES)]


def _class(value: float, steps: int) -> int:
    return min(steps - 1, max(0, int(value * steps)))


def term_rows(texts: list[bytes]) -> np.ndarray:
    """Term weights of every text: damped counts, words and shapes each of unit length."""
    cache = process_cache("voting").setdefault("terms", TwoGenerations(250_000))
    get, missing = cache.young.get, cache.missing
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        # numbers are one higher in the cache, so that none is taken for absent
        codes = np.fromiter([get(w) or missing(w, lambda x: _terms(x) + 1) for w in words], np.int64, len(words)) - 1
        row = out[i]
        n = max(1, len(words))
        if words:
            row[:WORDS] = np.bincount(codes // SHAPES, minlength=WORDS)
            row[WORDS : WORDS + SHAPES] = np.bincount(codes % SHAPES, minlength=SHAPES)
            if max(map(len, words)) > LONG:
                for w in words:
                    if len(w) > LONG:
                        row[: WORDS + SHAPES] += _pieces(w)
            np.log1p(row, out=row)
            row[:WORDS] *= 0.5 / np.linalg.norm(row[:WORDS])
            row[WORDS : WORDS + SHAPES] *= 1.5 / np.linalg.norm(row[WORDS : WORDS + SHAPES])
        lines = [x for x in text.split(b"\n") if x.strip()]
        # distinct words against what a text of this length usually has
        fresh = len(set(words)) / n ** (1 - 0.03 * math.log(n + 1))
        for k, c in enumerate(
            (_class(fresh, 16), _class(len(set(lines)) / max(1, len(lines)), 8), _class(math.log2(n) / 16, 16))
        ):
            row[WORDS + SHAPES + (0, 16, 24)[k] + c] = (1.0, 0.6, 0.3)[k]
    return out


class Latent:
    """Term weights, latent directions, the labelled vectors and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.prior = float((labels.sum() + 1) / (len(labels) + 2))
        self.labels = labels.astype(np.float32)
        held = (rows > 0).sum(0)
        self.weight = np.log((len(rows) + 1) / (held + 1)).astype(np.float32) + 0.1
        x = rows * self.weight
        # subspace iteration: the leading right singular vectors
        basis = np.random.default_rng(7).standard_normal((TERMS, LATENT + 8)).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        small = x @ basis
        _, _, turn = np.linalg.svd(small, full_matrices=False)
        self.directions = (basis @ turn.T)[:, :LATENT].astype(np.float32)
        self.vectors = self.project(rows)

    def project(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.weight) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity."""
        cosine = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Latent | None:
    """From at most ``sample`` rows of ``labels`` (doc_id, quality) that have a text.

    Labels other than 0 and 1 and null ids take no part. None if nothing is left.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # bounded, so that the texts need not move to it
    texts = docs.select("doc_id", text_bytes()).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def work(batch):
        press = zstandard.ZstdCompressor(level=3).compress
        texts = batch.column(2).to_pylist()
        packed = [press(r.tobytes()) for a in range(0, len(texts), BLOCK) for r in term_rows(texts[a : a + BLOCK])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "quality", "terms"])

    rows = map_rows(texts, "doc_id long, quality int, terms binary", work).collect()  # ``sample`` rows
    if not rows:
        return None
    rows = sorted((r.doc_id, r.quality, bytes(r.terms)) for r in rows)
    press = zstandard.ZstdDecompressor()
    matrix = np.stack([np.frombuffer(press.decompress(t), np.float32) for _, _, t in rows])
    return Latent(matrix, np.array([q for _, q, _ in rows]))


def score_quality(docs: DataFrame, model: Latent | None) -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1) and ``predicted`` (1 from a half up).

    Null or empty text: scored by its classes alone. No model (nothing labelled): a half.
    Null ids and repeated rows: a row each. Empty table: no rows. Columns of those two names
    are replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "score", "predicted")]).alias("row")
    source = docs.select(row, text_bytes())
    given = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        texts = batch.column(1).to_pylist()
        if given.value is None:
            scores = np.full(len(texts), 0.5)
        else:
            scores = np.concatenate([given.value.vote(term_rows(texts[a : a + BLOCK])) for a in range(0, len(texts), BLOCK)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64))], ["row", "score"])

    scored = map_rows(source, with_columns(source, "score double"), work)
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder != 1)
    held_out = F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    return score_quality(docs, learn(docs, labels)).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op7_neighbour_vote": op7_neighbour_vote}
