"""Approximate nearest neighbours over a cell layout.

Vectors are assigned to the nearest of a fixed number of centroids and stored partitioned
by that cell. A query reads only the cells of its nearest centroids (partition pruning) and
re-scores them exactly. With all cells probed the result equals the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.vectors import as_matrix, unit_rows
from chunkloom.model import TOP_K
from chunkloom.operators.knn import Hits, nearest, scored_groups
from chunkloom.session import scratch_path, write_through

ROWS_PER_FILE = 1_000_000   # rows of one cell per file
MAX_CELLS = 65_536          # bound of the centroid list that goes to every task


@dataclass
class CellIndex:
    path: str
    centroids: np.ndarray
    space: str
    row_id: str
    vec: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _nearest_cells(centroids: np.ndarray, count: int, space: str):
    """A function from a vector column to its ``count`` nearest cells, nearest first."""
    half = (centroids**2).sum(1) / 2

    @F.arrow_udf("array<int>")
    def cells(v: pa.Array) -> pa.Array:
        m = as_matrix(v)
        if not len(m):
            return pa.array([], pa.list_(pa.int32()))
        if space == "cosine":
            m = unit_rows(m)
        order = np.concatenate([_first_cells(half[None, :] - part @ centroids.T, count) for part in _row_blocks(m, len(half))])
        offsets = np.arange(len(m) + 1, dtype=np.int32) * order.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.astype(np.int32).ravel()))

    return cells


# Numbers of a block of row-to-centroid distances: 64 MB.
BLOCK_VALUES = 8 << 20


def _row_blocks(m: np.ndarray, cells: int) -> list[np.ndarray]:
    step = max(1, BLOCK_VALUES // max(1, cells))
    return [m[at : at + step] for at in range(0, len(m), step)]


def _first_cells(distance: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest cells of each row, nearest first; ties go to the smaller cell."""
    if count == 1:
        return distance.argmin(axis=1)[:, None]
    if count < distance.shape[1]:
        bound = np.partition(distance, count - 1, axis=1)[:, count - 1 : count]
        distance = np.where(distance <= bound, distance, np.inf)
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def build_index(
    vectors: DataFrame,
    cells: int,
    space: str = "cosine",
    row_id: str = "id",
    vec: str = "embedding",
    path: str | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    seed: int = 7,
    centroids: np.ndarray | None = None,
) -> CellIndex:
    """Train centroids on all rows (or take those given), assign every row once and write the table partitioned by cell."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must lie between 1 and {MAX_CELLS}")
    spark = vectors.sparkSession
    if centroids is None:
        centroids = _trained(vectors, cells, space, vec, seed)
    target = path or scratch_path(spark, "cells")
    assigned = (
        vectors.withColumn("_cells", _nearest_cells(centroids, 1, space)(F.col(vec)))
        .withColumn("cell", F.element_at("_cells", 1))
        .drop("_cells")
    )
    _write_cells(write_through(assigned, "assigned"), row_id, rows_per_file, target)
    return CellIndex(target, centroids, space, row_id, vec)


def _trained(vectors: DataFrame, cells: int, space: str, vec: str, seed: int) -> np.ndarray:
    train = vectors.select(F.col(vec).cast("array<double>").alias("v"))
    if space == "cosine":
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        train = train.filter(size > 0).select(F.transform("v", lambda x: x / size).alias("v"))
    # Written once and read in each iteration.
    train = write_through(train.select(array_to_vector("v").alias("features")), "train")
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(train)
    return np.array(model.clusterCenters(), dtype=np.float64)


def _write_cells(assigned: DataFrame, row_id: str, rows_per_file: int, target: str) -> None:
    """Write one file per ``rows_per_file`` rows of a cell: small cells give no swarm of
    files, and a cell holding a third of all rows is written by many tasks."""
    sizes = assigned.groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_file)).cast("int").alias("_parts")
    ).toArrow()  # one row per cell: bounded by MAX_CELLS
    parts = F.broadcast(assigned.sparkSession.createDataFrame(sizes))
    salt = F.pmod(F.xxhash64(row_id), F.col("_parts"))
    files = sum(sizes.column("_parts").to_pylist())
    (
        assigned.join(parts, "cell")
        .withColumn("_salt", salt)
        .repartition(max(1, files), "cell", "_salt")
        .drop("_parts", "_salt")
        .write.mode("overwrite").partitionBy("cell").parquet(target)
    )


def probe(
    index: CellIndex,
    queries: DataFrame,
    k: int = TOP_K,
    nprobe: int = 8,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    keep: tuple[str, ...] = (),
) -> Hits:
    """The k nearest rows among the ``nprobe`` nearest cells of each query."""
    spark = queries.sparkSession
    if nprobe >= len(index.centroids):
        return nearest(
            queries, index.read(spark), k, index.space, query_id, query_vec, index.row_id, index.vec, keep
        )
    wanted = queries.withColumn(
        "_cells", _nearest_cells(index.centroids, nprobe, index.space)(F.col(query_vec))
    )
    probes = wanted.select(query_id, F.explode_outer("_cells").alias("cell"))
    rows = index.read(spark)
    # At most one row per cell, so the list of cells to read is bounded by MAX_CELLS.
    cells = [r.cell for r in probes.select("cell").distinct().collect()]
    rows = rows.filter(F.col("cell").isin(cells))
    return nearest(
        queries, rows, k, index.space, query_id, query_vec, index.row_id, index.vec, keep,
        probes=probes, cell="cell",
    )


def probe_join(
    index: CellIndex,
    queries: DataFrame,
    k: int = TOP_K,
    nprobe: int = 8,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    keep: tuple[str, ...] = (),
    group_rows: int = 200_000,
    group_queries: int = 65_536,
) -> Hits:
    """``probe`` for any number of queries: an equi-join on the cell instead of a broadcast or of every query to every shard.

    A query goes to its probed cells only. A cell of many rows is dealt to salts of ``group_rows`` rows, its queries go to each; a cell
    that very many queries probe is served in blocks of ``group_queries``. Groups are bounded however hot a cell is.
    """
    spark = queries.sparkSession
    wanted = queries.select(
        F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qvec"),
        F.explode(_nearest_cells(index.centroids, min(nprobe, len(index.centroids)), index.space)(F.col(query_vec))).alias("cell"),
    )
    wanted, rows = write_through(wanted, "probes"), index.read(spark).select(index.row_id, *keep, index.vec, "cell")
    # one row per cell each: bounded by MAX_CELLS
    blocks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("_blocks"))
    salts = rows.groupBy("cell").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("_salts"))
    cells = F.broadcast(write_through(blocks.join(salts, "cell"), "cells"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = wanted.join(cells, "cell").withColumn("_block", F.pmod(F.xxhash64("_qid"), "_blocks").cast("int")).withColumn("_salt", every("_salts"))
    right = rows.join(cells, "cell").withColumn("_salt", F.pmod(F.xxhash64(index.row_id), "_salts").cast("int")).withColumn("_block", every("_blocks"))
    keys = ["cell", "_salt", "_block"]
    left, right = left.select(*keys, "_qid", "_qvec"), right.select(*keys, index.row_id, *keep, index.vec)
    return scored_groups(left, right, keys, k, index.space, query_id, index.row_id, index.vec, keep)
