"""Vector column functions and the block scorer that runs inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, space: str) -> Column:
    """The distance as a column expression; the plain form of ``distance_block``."""
    if space == "ip":
        return F.lit(1.0) - dot(a, b)
    if space == "l2":
        gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / size)


def similarity(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - dist)


def resize(v: Column, dimensions: int) -> Column:
    """Cut or zero-pad to ``dimensions`` without rescaling."""
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.lit(dimensions) - F.size(v))
    return F.when(F.size(v) >= dimensions, F.slice(v, 1, dimensions)).otherwise(F.concat(v, pad))


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list column as a double matrix; an uneven or null vector is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector")
    lens = column.value_lengths().to_numpy()
    if len(lens) and (lens != lens[0]).any():
        raise ValueError("vectors of different dimensions")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lens), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def distance_block(queries: np.ndarray, vectors: np.ndarray, space: str) -> np.ndarray:
    """All distances of a query block and a vector block, rounded to 6 places.

    ``cosine`` expects rows of unit length (``unit_rows``).
    """
    product = queries @ vectors.T
    if space == "l2":
        d = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2.0 * product
        d = np.maximum(d, 0.0)
    else:
        d = 1.0 - product
    return np.floor(d * 1e6 + 0.5) / 1e6


class NearestKeeper:
    """The ``k`` nearest rows per query over the batches of one task, ties by row id.

    Holds at most ``k`` candidates per query, however many rows pass by.
    """

    def __init__(self, query_count: int, k: int):
        self.k = k
        self.dist = np.full((query_count, k), np.inf)
        self.rows = np.full((query_count, k), None, dtype=object)

    def offer(self, which: np.ndarray, d: np.ndarray, payload) -> None:
        """Offer rows with distances ``d[query, row]``; rows must be sorted by id.

        ``payload(positions)`` gives the tuples to keep, the id first.
        """
        k = self.k
        bound = self.dist[which, -1:]
        if d.shape[1] > k:
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1:k])
        ties = d == bound
        take = (d < bound) | (ties & (np.cumsum(ties, axis=1) <= k))
        qi, vi = np.nonzero(take)
        if not len(qi):
            return
        positions, place = np.unique(vi, return_inverse=True)
        kept = payload(positions)
        starts = np.searchsorted(qi, np.arange(len(which) + 1))
        for j in np.unique(qi):
            span = slice(starts[j], starts[j + 1])
            q = which[j]
            pool = [(x, r) for x, r in zip(self.dist[q], self.rows[q]) if r is not None]
            pool += [(d[j, v], kept[p]) for v, p in zip(vi[span], place[span])]
            pool.sort(key=lambda c: (c[0], c[1][0]))
            for slot, (x, r) in enumerate(pool[:k]):
                self.dist[q, slot] = x
                self.rows[q, slot] = r

    def results(self):
        """``(query position, distance, kept tuple)`` of every candidate."""
        for q, s in zip(*np.nonzero(self.rows != None)):  # noqa: E711
            yield q, float(self.dist[q, s]), self.rows[q, s]
