"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemill.session import materialize

# ASCII white space: what separates words everywhere in this subpackage.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"")).alias("text")


def with_columns(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``df``'s ``row`` column, whatever its fields are called, and more columns."""
    return StructType([df.schema["row"], *StructType.fromDDL(ddl).fields])


def map_rows(
    df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """``work`` on every Arrow batch; batches that come back as None are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written to the shared folder and read again; what led to it can be freed.

    Spark keeps the shuffle files of a finished job until the driver collects garbage, which
    a driver with little to do puts off. Asking for it keeps disk use from adding up. It
    works only on what nothing else refers to: pass ``df`` as an expression, not by a name.
    """
    out = materialize(df, stem)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def squeezed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a binary column compressed, for a shuffle; see :func:`opened`."""
    at = df.columns.index(column)

    def work(batch):
        press = zstandard.ZstdCompressor(level=1).compress
        small = pa.array([press(x) for x in batch.column(at).to_pylist()], pa.binary())
        return batch.set_column(at, column, small)

    return map_rows(df, df.schema, work)


def opened(values: list[bytes]) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, values)


def process_cache(name: str) -> dict:
    """A dict that stays with the Python worker, so that its next task finds it filled."""
    return sys.modules["__main__"].__dict__.setdefault(f"_tablemill_{name}", {})


class TwoGenerations:
    """A bounded cache: when the young half is full it becomes the old half.

    What is asked for again moves to the young half, so frequent keys stay.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, key, make):
        value = self.old.get(key)
        if value is None:
            value = make(key)
            if len(key) > 64:
                return value  # long keys rarely come again
        if len(self.young) >= self.limit:
            # emptied in place: callers hold a reference to the young half
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value
        return value


# Odd multipliers for hashing.
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * ONE
    x ^= x >> np.uint64(32)
    x *= TWO
    x ^= x >> np.uint64(29)
    return x


def pack(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per part, its records column by column, compressed."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    ends = np.r_[at[1:], len(part)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blobs = []
    for a, b in zip(at.tolist(), ends.tolist()):
        # bytes of one significance stand together, so that their sameness shows
        planes = [np.ascontiguousarray(c[a:b].astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
        blobs.append(squeeze((b - a).to_bytes(4, "little") + b"".join(planes)))
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "blob"])


def unpack(blobs: list[bytes], width: int) -> list[np.ndarray]:
    open_, found = zstandard.ZstdDecompressor().decompress, [[] for _ in range(width)]
    for blob in blobs:
        raw = open_(blob)
        n = int.from_bytes(raw[:4], "little")
        for i in range(width):
            plane = np.frombuffer(raw, np.uint8, 8 * n, 4 + 8 * n * i).reshape(8, n)
            found[i].append(np.ascontiguousarray(plane.T).view("<i8").reshape(-1))
    return [np.concatenate(f) for f in found]


def _by_part(df: DataFrame, parts: int, schema: str, width: int, work) -> DataFrame:
    """``work`` on all records of each part, a part at a time."""

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and blobs:
                    yield from work(unpack(blobs, width))
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield from work(unpack(blobs, width))

    return df.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def each_part(batches):
    """(blobs, bodies) of one part after the other, from rows sorted by part."""
    now, blobs, bodies = None, [], []
    for batch in batches:
        body = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for part, blob, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), body):
            if part != now and blobs:
                yield blobs, bodies
                blobs, bodies = [], []
            now = part
            blobs.append(blob)
            bodies.append(b)
    if blobs:
        yield blobs, bodies
