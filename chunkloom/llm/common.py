"""Helpers that several operators share: Arrow buffers, scratch tables, row filters, components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.session import scratch_path

#: Bytes of one Arrow batch that goes to Python, so that long texts don't add up to gigabytes.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, rows outlive executors and
    its exact size is known to the planner."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once nothing that is still to be computed reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each string or binary value; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return [b""] * n
    at = np.frombuffer(offsets, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).tolist()
    view = memoryview(data)
    out = [bytes(view[a:b]) for a, b in zip(at, at[1:], strict=False)]
    if column.null_count:
        out = [x if ok else b"" for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)]
    return out


def grouped_by_bytes(texts: list[bytes], most: int) -> Iterator[slice]:
    """Runs of texts of at most ``most`` bytes together, or one longer text alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser known as splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of byte ranges from prefix sums, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


@functools.cache
def rolling_hash() -> RollingHash:
    """One for each worker: its tables of powers are kept."""
    return RollingHash()


def keep_rows(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` whose keys (null equals null) are in ``kept``.

    ``kept`` has its size known (a written table), so the planner broadcasts it only if it is small.
    """
    right = kept.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = None
    for k in keys:
        same = docs[k].eqNullSafe(right[f"__{k}"])
        on = same if on is None else on & same
    return docs.join(right, on, "left_semi")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component being
    the smallest node of it. Nodes without an edge are absent.

    Large and small stars alternate until nothing changes: a logarithmic number of rounds of
    equi-joins on narrow rows, each written to the shared folder. The minima are written before they
    are joined, so both join sides come from plain shuffles and hot nodes can be split at run time.
    """
    state = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    state = written(state.distinct(), label)
    seen = None
    while True:
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            state.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.distinct(), label)
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), label)
        small = (
            large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo")))
        )
        state = written(small.distinct(), label)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = now
