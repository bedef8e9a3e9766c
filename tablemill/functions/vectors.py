"""Expressions over class-probability and score arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix_of_lists(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists, without an object per row. Others: an error."""
    lengths = np.diff(lists.offsets.to_numpy())
    if (lengths != lengths[:1]).any():
        raise ValueError("lists of features differ in length or are NULL")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), -1)


def lists_of_matrix(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def one_hot(index: Column, k: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.when(i == index, 1.0).otherwise(0.0),
    )


def argmax_index(p: Column) -> Column:
    """Position of the largest entry; the lowest position wins a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def label_at(index: Column, classes: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def softmax(z: Column) -> Column:
    exps = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda e: e / total)


def normalised(p: Column) -> Column:
    """Scale to sum 1; an all-zero array becomes uniform."""
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    uniform = F.lit(1.0) / F.size(p)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(uniform))


def padded(p: Column, k: int) -> Column:
    """Array of exactly k probabilities; classes the model never saw get 0.

    ``p`` is outside the function over entries: inside it a model would run once for each."""
    there = F.coalesce(p, F.array().cast("array<double>"))
    return F.transform(
        F.slice(F.concat(there, F.array_repeat(F.lit(0.0), k)), 1, k), lambda x: F.coalesce(x, F.lit(0.0))
    )


def mean_of_arrays(arrays: list[Column]) -> Column:
    """Entry-wise mean of equally long arrays (the probability-averaging ensemble)."""
    total = arrays[0]
    for nxt in arrays[1:]:
        total = F.zip_with(total, nxt, lambda a, b: a + b)
    return F.transform(total, lambda x: x / float(len(arrays)))


def top_entries(p: Column, n: int) -> Column:
    """The n largest (value, index) structs, largest first, lower index first on ties."""
    indexed = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    return F.slice(F.array_sort(indexed), 1, n)


def activation(name: str, x: Column) -> Column:
    """Hidden-layer activation by name."""
    if name == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    if name == "relu":
        return F.greatest(x, F.lit(0.0))
    if name == "sin":
        return F.sin(x)
    if name == "tanh":
        return F.tanh(x)
    if name == "leaky_relu":
        return F.greatest(x, F.lit(0.0)) + F.lit(0.1) * F.least(x, F.lit(0.0))
    raise ValueError(f"unknown activation {name!r}")
