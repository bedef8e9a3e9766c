"""Exact top-k search by inner product with a pivot table.

Distances of every vector to a set of pivots are computed once and stored beside it. For a
query q the triangle inequality bounds its distance to a vector x from below by the largest
|d(x, p) - d(q, p)| over the pivots p, and 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 then bounds the
score from above. Candidates are evaluated in the order of their bounds until the k-th best
score is above the next bound; what is left can't enter.

Queries are taken in blocks of bounded size; a block goes to all tasks, each of which walks
its share of the index and keeps k results per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.llm.common import stored, table

PIVOTS = 32
PIVOT_SAMPLE = 2048
"""Rows, the smallest by hash of the id, that pivots are chosen from. The index has all rows."""
QUERY_BLOCK = 1024
"""Queries of a block, on average; their hash decides the block."""
STEP = 128
"""Candidates evaluated at a time."""
_MOST = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, dims, vec): floor(scale * x) as doubles, which hold it exactly, packed.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    x = F.col("_v")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")
    ).where(usable)

    def work(batches):
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy()
            values = np.floor(scale * column.values.to_numpy(zero_copy_only=False))
            packed = [values[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(packed, pa.binary())],
                ["vec_id", "dims", "vec"],
            )

    return rows.mapInArrow(work, "vec_id long, dims int, vec binary")


def choose_pivots(vectors: np.ndarray, how_many: int) -> np.ndarray:
    """Farthest-first: each next pivot is far from all before."""
    chosen = [0]
    gap = np.full(len(vectors), np.inf)
    while len(chosen) < min(how_many, len(vectors)):
        gap = np.minimum(gap, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return vectors[chosen]


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dims)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    # differences, not the expanded square: no cancellation
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def pivot_index(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the distances to the pivots of their dimension, packed."""

    def work(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                far = _distances(_matrix(part.column(2), d), pivots[d]).astype("<f8")
                yield part.append_column("far", pa.array([f.tobytes() for f in far], pa.binary()))

    return vectors.mapInArrow(work, "vec_id long, dims int, vec binary, far binary")


def _scores(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products, cut to a long: by doubles where their sums stay exact, else by integers."""
    if np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1).max()) < 2.0**52:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(c) for c in q.tolist()]
    exact = (sum(a * int(b) for a, b in zip(whole, row)) for row in x.tolist())
    return [max(-_MOST - 1, min(_MOST, s)) for s in exact]


class Best:
    """The k best of one query so far: higher score first, then smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def enough(self) -> float:
        return float(self.rows[-1][0]) * -1 if len(self.rows) == self.k else -np.inf

    def add(self, scores: list[int], ids: list[int]) -> None:
        self.rows = sorted([*self.rows, *((-s, i) for s, i in zip(scores, ids))])[: self.k]


def search_block(index, queries: list[tuple[int, int, bytes, bytes]], k: int):
    """Batches of (query number, score, vec_id): k best per query of one task's share.

    ``queries``: (number, vec_id, vec, far) of one block.
    """
    by_dims: dict[int, list] = {}
    for number, vec_id, vec, far in queries:
        q = np.frombuffer(vec, "<f8")
        by_dims.setdefault(len(q), []).append((number, vec_id, q, np.frombuffer(far, "<f8"), Best(k)))
    for batch in index:
        dims = batch.column(1).to_numpy()
        for d in np.unique(dims).tolist():
            if d not in by_dims:
                continue
            part = batch.filter(pa.array(dims == d))
            ids, x = part.column(0).to_numpy(), _matrix(part.column(2), d)
            far = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f8").reshape(len(ids), -1)
            norm = (x * x).sum(1)
            for _, own, q, q_far, best in by_dims[d]:
                size = (q * q).sum()
                low = np.abs(far - q_far).max(1)
                # a little more than the bound, against rounding
                bound = (norm + size - low * low) / 2 + 1e-9 * (norm + size) + 1
                bound[ids == own] = -np.inf
                order = np.flatnonzero(bound >= best.enough())
                order = order[np.argsort(-bound[order], kind="stable")]
                for at in range(0, len(order), STEP):
                    rows = order[at : at + STEP]
                    if bound[rows[0]] < best.enough():
                        break
                    rows = rows[ids[rows] != own]
                    if len(rows):
                        best.add(_scores(q, x[rows]), ids[rows].tolist())
    found = [(n, -s, i) for group in by_dims.values() for n, _, _, _, best in group for s, i in best.rows]
    if found:
        number, score, ids = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in (number, score, ids)], ["number", "score", "vec_id"]
        )


def top_k(
    df: DataFrame, every: int, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries: rows whose id is divisible by ``every``; candidates: every row of another id.
    Ties go to the smaller id. Vectors meet only those of their own length; an empty vector
    scores 0. Scores beyond a long are cut to its range before they are compared. Rows with a null id, a null vector
    or a null or non-finite component take no part. Repeated rows are candidates each, and
    queries each. Empty table, or no queries: no rows. Other columns are not read.
    """
    vectors = stored(integer_vectors(df, id_col, vector, scale), "vectors")
    chosen = {}
    for (d,) in vectors.select("dims").distinct().collect():  # as many rows as lengths of vectors
        sample = (
            vectors.where(F.col("dims") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vec").collect()
        )
        chosen[d] = choose_pivots(np.frombuffer(b"".join(bytes(r.vec) for r in sample), "<f8").reshape(-1, d) if d else np.zeros((1, 0)), pivots)
    index = stored(pivot_index(vectors, chosen), "index")
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id", "vec").collect()
        given = df.sparkSession.sparkContext.broadcast(
            [(n, r.vec_id, bytes(r.vec), bytes(r.far)) for n, r in enumerate(rows)]
        )
        ids = df.sparkSession.createDataFrame([(n, r.vec_id) for n, r in enumerate(rows)] or [], "number long, query_id long")
        part = index.mapInArrow(
            lambda batches, given=given: search_block(batches, given.value, k), "number long, score long, vec_id long"
        )
        order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(ids, "number")
        part = stored(part.select("query_id", "rank", "vec_id", "score"), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


QUERIES = {"op1_pivot_topk": op1_pivot_topk}

ORACLES = {
    "op1_pivot_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 10
"""
}
