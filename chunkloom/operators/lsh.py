"""Approximate nearest neighbours by random hyperplanes in several tables, with probes of near buckets.

A plane's components are +1 or -1, told by a hash of (table, bit, place), so planes are the same everywhere and nothing
is stored for them. Vectors are scaled to ``MICRO`` whole steps: projections are whole numbers and signatures exact. A query looks
into its own bucket of each table and into those that differ in one of the bits with the smallest projections, the ones that a near vector is
most likely to have on the other side.

The index holds (table, bucket, id) only, vectors stay in a table of their own. Candidates come from an equi-join of postings and probes, both of known
size, are made distinct before the shuffle, and are scored exactly.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.vectors import as_matrix, unit_rows
from chunkloom.model import TOP_K
from chunkloom.operators.knn import Hits
from chunkloom.session import scratch_path, write_through

TABLES, BITS, PROBES, MICRO = 24, 8, 4, 1_000_000


@functools.cache
def planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """(tables * bits, dim) of +1 and -1: the parity of the first 8 hex digits of the md5 of 'table:bit:place'."""
    signs = [
        1 - 2 * (int(hashlib.md5(f"{t}:{b}:{j}".encode()).hexdigest()[:8], 16) % 2)
        for t in range(tables) for b in range(bits) for j in range(dim)
    ]
    return np.array(signs, np.int64).reshape(tables * bits, dim)


def projections(vectors: pa.Array, tables: int, bits: int) -> np.ndarray:
    """(rows, tables, bits) whole numbers; the component's steps are rounded half away from zero."""
    m = as_matrix(vectors) * MICRO
    steps = (np.sign(m) * np.floor(np.abs(m) + 0.5)).astype(np.int64)
    return (steps @ planes(tables, bits, m.shape[1]).T).reshape(len(m), tables, bits)


def probe_codes(projected: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) buckets: the own one, then with one bit changed, smallest projection first (ties: the lower bit)."""
    bits = projected.shape[2]
    own = ((projected >= 0) << np.arange(bits)).sum(axis=2)
    near = np.argsort(np.abs(projected), axis=2, kind="stable")[:, :, :probes]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << near)], axis=2)


def _codes(tables: int, bits: int, probes: int):
    @F.arrow_udf("array<array<bigint>>")
    def codes(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.list_(pa.int64())))
        c = probe_codes(projections(v, tables, bits), min(probes, bits))
        inner = pa.ListArray.from_arrays(np.arange(len(v) * tables + 1, dtype=np.int32) * c.shape[2], pa.array(c.ravel()))
        return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * tables, inner)

    return codes


def _buckets(df: DataFrame, vec: str, tables: int, bits: int, probes: int) -> DataFrame:
    coded = df.withColumn("_codes", _codes(tables, bits, probes)(F.col(vec))).drop(vec)
    return coded.select("*", F.posexplode("_codes").alias("table", "_of")).withColumn("bucket", F.explode("_of")).drop("_codes", "_of")


@dataclass
class HashIndex:
    path: str
    tables: int
    bits: int
    row_id: str
    vec: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table}")


def build_hash_index(
    vectors: DataFrame, row_id: str = "id", vec: str = "embedding", keep: tuple[str, ...] = (), tables: int = TABLES, bits: int = BITS, path: str | None = None
) -> HashIndex:
    """Postings and vectors below ``path``. Rows without a vector are left out."""
    path = path or scratch_path(vectors.sparkSession, "hashes")
    vectors.filter(F.col(vec).isNotNull()).select(row_id, vec, *keep).write.parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    _buckets(stored.select(row_id, vec), vec, tables, bits, 0).write.parquet(f"{path}/postings")
    return HashIndex(path, tables, bits, row_id, vec)


@F.arrow_udf(T.DoubleType())
def _cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    product = (unit_rows(as_matrix(a)) * unit_rows(as_matrix(b))).sum(axis=1)
    return pa.array(np.floor((1.0 - product) * 1e6 + 0.5) / 1e6)


def search_hashes(
    index: HashIndex, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, query_id: str = "query_id", query_vec: str = "embedding", keep: tuple[str, ...] = ()
) -> Hits:
    """``query_id, rank, row_id, distance, *keep``: the k nearest by cosine among the candidates. Distances have 6 places, ties go to the smaller id."""
    spark = queries.sparkSession
    asked = write_through(queries.select(query_id, F.col(query_vec).alias("_query")), "asked")
    wanted = write_through(_buckets(asked, "_query", index.tables, index.bits, probes), "probes")
    met = index.read(spark, "postings").join(wanted, ["table", "bucket"]).select(query_id, index.row_id).distinct()
    met = write_through(met, "candidates")
    near = met.join(index.read(spark, "vectors"), index.row_id).join(asked, query_id)
    scored = near.select(query_id, index.row_id, *keep, _cosine_distance(F.col("_query"), F.col(index.vec).cast("array<double>")).alias("distance"))
    best = Window.partitionBy(query_id).orderBy("distance", index.row_id)
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return Hits(ranked.select(query_id, "rank", index.row_id, "distance", *keep), True)
