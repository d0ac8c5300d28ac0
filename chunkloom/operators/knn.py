"""Exact nearest neighbours of many queries at once.

Queries up to a checked count are broadcast: each task scores its vectors with one matrix
product per batch and keeps k candidates per query, so nothing but those is shuffled. More
queries than that are not broadcast: both sides go to hash shards of a bounded size and are
scored shard by shard. Either way the result is whole and independent of key skew, because
rows are spread by scan split or by id hash, never by a data key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.functions.vectors import NearestKeeper, as_matrix, distance_block, unit_rows
from chunkloom.model import SPACES, TOP_K

MAX_BROADCAST_QUERIES = 4096   # times the dimension times 8 bytes: 2 MiB at 64 dimensions
MAX_BROADCAST_PROBES = 1_000_000   # query and cell pairs that may be broadcast
SHARD_ROWS = 200_000           # vectors per shard when queries are too many to broadcast
SHARD_QUERIES = 65_536         # queries per group of that form: vectors are copied once per so many
QUERY_BLOCK = 256              # queries per matrix product
MERGE_GROUPS = 64              # first-level groups when partial results are merged


@dataclass
class Hits:
    """Ranked neighbours; ``bounded`` tells that the query count was small enough to broadcast."""

    rows: DataFrame
    bounded: bool


def _score(batches, ids, queries: np.ndarray, probes, k: int, space: str, vec: str, keep: list[str], cell):
    """Candidates of one task. ``probes`` limits each query to some cells."""
    best = NearestKeeper(len(ids), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch]).sort_by([(keep[0], "ascending")])
        matrix = as_matrix(batch.column(vec))
        if space == "cosine":
            matrix = unit_rows(matrix)
        if probes is None:
            groups = [(np.arange(len(matrix)), np.arange(len(ids)))]
        else:
            cells = batch.column(cell).to_numpy()
            groups = [(np.flatnonzero(cells == c), probes.get(int(c))) for c in np.unique(cells)]
        for members, who in groups:
            if who is None:
                continue
            part = batch.select(keep).take(pa.array(members))

            def payload(positions, part=part):
                return list(zip(*(c.to_pylist() for c in part.take(pa.array(positions)).columns)))

            for at in range(0, len(who), QUERY_BLOCK):
                block = who[at:at + QUERY_BLOCK]
                best.offer(block, distance_block(queries[block], matrix[members], space), payload)
    return best


def _to_batch(best: NearestKeeper, ids, schema: pa.Schema) -> pa.RecordBatch:
    found = list(best.results())
    columns = [[ids[q] for q, _, _ in found], [d for _, d, _ in found]]
    columns += [[row[i] for _, _, row in found] for i in range(len(schema) - 2)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _query_arrays(table: pa.Table, query_id: str, vec: str, space: str):
    ids = table.column(query_id).to_pylist()
    if not ids:
        return ids, np.zeros((0, 0))
    matrix = as_matrix(table.column(vec))
    return ids, unit_rows(matrix) if space == "cosine" else matrix


def _rank(candidates: DataFrame, query_id: str, tie: str, k: int) -> DataFrame:
    """Two-level top k, so that few queries over many tasks do not meet in one task."""
    order = [F.col("distance"), F.col(tie)]
    grouped = candidates.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    first = Window.partitionBy(query_id, "_group").orderBy(*order)
    final = Window.partitionBy(query_id).orderBy(*order)
    return (
        grouped.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= k)
        .drop("_group", "_rank")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    space: str = "cosine",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    row_id: str = "id",
    vec: str = "embedding",
    keep: tuple[str, ...] = (),
    probes: DataFrame | None = None,
    cell: str = "cell",
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    shard_rows: int = SHARD_ROWS,
) -> Hits:
    """``query_id, rank, row_id, distance, *keep`` of the k nearest rows per query.

    Distances are rounded to 6 places and ties go to the smaller row id. ``probes``
    (``query_id, cell``) limits each query to the rows of some cells.
    """
    if space not in SPACES:
        raise ValueError(f"unknown space: {space}")
    if k < 1:
        raise ValueError("k must be at least 1")
    kept = [row_id, *keep]
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qvec"))
    schema = T.StructType(
        [T.StructField(query_id, q.schema["_qid"].dataType), T.StructField("distance", T.DoubleType())]
        + [T.StructField(c, vectors.schema[c].dataType) for c in kept]
    )
    columns = [*kept, vec] + ([cell] if probes is not None else [])
    rows = vectors.select(*columns)
    # At most max_broadcast + 1 queries and MAX_BROADCAST_PROBES + 1 pairs come to the driver.
    head = q.limit(max_broadcast + 1).toArrow()
    pairs, few = None, head.num_rows <= max_broadcast
    if few and probes is not None:
        pairs = probes.select(query_id, cell).limit(MAX_BROADCAST_PROBES + 1).toArrow()
        few = pairs.num_rows <= MAX_BROADCAST_PROBES
    if few:
        candidates = _broadcast_form(rows, head, pairs, schema, k, space, vec, kept, cell)
    else:
        candidates = _sharded_form(rows, q, probes, schema, k, space, vec, kept, cell, query_id, shard_rows)
    ranked = _rank(candidates, query_id, row_id, k)
    return Hits(ranked.select(query_id, "rank", row_id, "distance", *keep), few)


def _probe_lists(pairs, ids) -> dict[int, np.ndarray]:
    place = {v: i for i, v in enumerate(ids)}
    lists: dict[int, list[int]] = {}
    for query, c in pairs:
        if query in place:
            lists.setdefault(int(c), []).append(place[query])
    return {c: np.array(sorted(v)) for c, v in lists.items()}


def _broadcast_form(rows, head, pairs, schema, k, space, vec, kept, cell):
    ids, matrix = _query_arrays(head, "_qid", "_qvec", space)
    lists = None
    if pairs is not None:
        lists = _probe_lists(zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist()), ids)
    sent = rows.sparkSession.sparkContext.broadcast((ids, matrix, lists))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, lists = sent.value
        best = _score(batches, ids, matrix, lists, k, space, vec, kept, cell)
        out = _to_batch(best, ids, pa_schema)
        if out.num_rows:
            yield out

    pa_schema = to_arrow_schema(schema)
    return rows.mapInArrow(scored, schema)


def _sharded_form(rows, q, probes, schema, k, space, vec, kept, cell, query_id, shard_rows):
    """Every vector goes to one hash shard, every query to all shards. A shard holds about
    ``shard_rows`` vectors, and query blocks are salted, so each group is bounded."""
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-q.count() // SHARD_QUERIES))
    if probes is not None:
        lists = probes.groupBy(F.col(query_id).alias("_qid")).agg(F.collect_set(cell).alias("_cells"))
        q = q.join(lists, "_qid")
    left = q.withColumn("_block", F.pmod(F.xxhash64("_qid"), F.lit(blocks)).cast("int")).withColumn(
        "_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    right = rows.withColumn("_shard", F.pmod(F.xxhash64(kept[0]), F.lit(shards)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    probed, pa_schema = probes is not None, to_arrow_schema(schema)

    def scored(block: pa.Table, shard: pa.Table) -> pa.Table:
        ids, matrix = _query_arrays(block, "_qid", "_qvec", space)
        lists = None
        if probed and ids:
            cells = block.column("_cells").to_pylist()
            lists = _probe_lists(((i, c) for i, cs in zip(ids, cells) for c in cs), ids)
        batches = shard.to_batches(max_chunksize=10_000) if ids else []
        best = _score(batches, ids, matrix, lists, k, space, vec, kept, cell)
        return pa.Table.from_batches([_to_batch(best, ids, pa_schema)])

    return (
        left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(scored, schema)
    )


def scored_groups(
    queries: DataFrame, rows: DataFrame, keys: list[str], k: int, space: str, query_id: str, row_id: str, vec: str, keep: tuple[str, ...]
) -> Hits:
    """The k nearest rows of each query (``_qid``, ``_qvec``) among the rows that share its ``keys`` in any group."""
    kept = [row_id, *keep]
    schema = T.StructType(
        [T.StructField(query_id, queries.schema["_qid"].dataType), T.StructField("distance", T.DoubleType())]
        + [T.StructField(c, rows.schema[c].dataType) for c in kept]
    )
    pa_schema = to_arrow_schema(schema)

    def scored(block: pa.Table, group: pa.Table) -> pa.Table:
        ids, matrix = _query_arrays(block, "_qid", "_qvec", space)
        batches = group.to_batches(max_chunksize=10_000) if ids else []
        return pa.Table.from_batches([_to_batch(_score(batches, ids, matrix, None, k, space, vec, kept, None), ids, pa_schema)])

    candidates = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scored, schema)
    ranked = _rank(candidates, query_id, row_id, k)
    return Hits(ranked.select(query_id, "rank", row_id, "distance", *keep), False)
