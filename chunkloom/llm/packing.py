"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

No two documents of one source and no two of one duplicate cluster share a bin. Open bins stand in the order of what is
left in them, each with a bitmap of its sources and one of its clusters. A document goes to the tightest bin that takes it:
the search starts at the first bin with enough room and goes on to its successors, some at a time, until a bin has neither bit set.
If none has, a new bin opens. Documents come longest first, equal ones by id.

Documents longer than the capacity are cut into full pieces and a rest, all of which are placed; nothing is lost or padded.
Rows are dealt into shards of bounded size by a hash of id and piece, and shards are packed independently, so that a source
with a third of all rows is spread evenly.

Defined results: a null text is empty; an empty text is one piece of length 0; a null source or cluster conflicts with nothing. Rows
that repeat an id are placed each, and are told apart by nothing but their place. Bins, pieces and shards depend only on the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import bounded_batches, written
from chunkloom.llm.exact_dedup import text_digest

#: Tokens of a sequence. The default length is that of byte-level tokens.
CAPACITY = 8192
#: Rows of a shard on average.
SHARD_ROWS = 10_000

SCHEMA = "doc_id long, piece int, n_tokens int, bin_id long, start int"


class _Bins:
    """Open bins in the order of their residuals."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity = capacity
        self.residual = np.empty(64, np.int64)  # ascending
        self.number = np.empty(64, np.int64)  # the bin at each place of that order
        self.bits = [np.zeros((64, (n >> 6) + 1), np.uint64) for n in (sources, clusters)]
        self.count = 0

    def _room(self) -> None:
        if self.count == len(self.residual):
            self.residual, self.number = (np.concatenate([x, np.empty_like(x)]) for x in (self.residual, self.number))
            self.bits = [np.concatenate([x, np.zeros_like(x)]) for x in self.bits]

    def _taken(self, bins: np.ndarray, key: int, which: int) -> np.ndarray:
        return (self.bits[which][bins, key >> 6] >> np.uint64(key & 63) & np.uint64(1)).astype(bool)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start of the document; -1 stands for no source or no cluster."""
        at = int(np.searchsorted(self.residual[: self.count], size))
        step, found = 32, -1
        while at < self.count and found < 0:
            bins = self.number[at : min(self.count, at + step)]
            free = np.ones(len(bins), bool)
            for which, key in enumerate((source, cluster)):
                if key >= 0:
                    free &= ~self._taken(bins, key, which)
            hit = int(free.argmax())
            if free[hit]:
                found = at + hit
            at += step
            step *= 2
        if found < 0:
            self._room()
            number, left, found = self.count, self.capacity, self.count
            self.count += 1
        else:
            number, left = int(self.number[found]), int(self.residual[found])
        rest = left - size
        to = int(np.searchsorted(self.residual[:found], rest))
        self.residual[to + 1 : found + 1] = self.residual[to:found].copy()
        self.number[to + 1 : found + 1] = self.number[to:found].copy()
        self.residual[to], self.number[to] = rest, number
        for which, key in enumerate((source, cluster)):
            if key >= 0:
                self.bits[which][number, key >> 6] |= np.uint64(1) << np.uint64(key & 63)
        return number, self.capacity - left


def _dense(column: pa.ChunkedArray, repeated_only: bool) -> np.ndarray:
    """Numbers of the values of a shard from 0, -1 for null (and for values that only one row has)."""
    codes = column.combine_chunks().dictionary_encode()
    at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if repeated_only and len(at):
        count = np.bincount(at + 1)
        many = np.flatnonzero(count > 1)
        number = np.full(len(count), -1, np.int64)
        number[many[many > 0]] = np.arange((many > 0).sum())
        at = number[at + 1]
    return at


def _pack_shard(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        size = group["n_tokens"].to_numpy()
        source, cluster = _dense(group["source"], True), _dense(group["cluster"], True)
        bins = _Bins(capacity, int(source.max(initial=0)), int(cluster.max(initial=0)))
        placed = np.array([bins.place(*x) for x in zip(size.tolist(), source.tolist(), cluster.tolist(), strict=True)], np.int64).reshape(-1, 2)
        shard = group["shard"][0].as_py()
        return pa.Table.from_pydict(
            {
                "doc_id": group["doc_id"], "piece": group["piece"], "n_tokens": group["n_tokens"],
                "bin_id": placed[:, 0] + (shard << 32), "start": placed[:, 1].astype(np.int32),
            }
        )

    return pack


def pack(
    docs: DataFrame, length: F.Column, cluster: F.Column, source: F.Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Rows (doc_id, piece, n_tokens, bin_id, start): where each piece of each document stands."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        source.cast("string").alias("source"), cluster.cast("binary").alias("cluster"),
    )
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)).cast("int"))))
    rows = written(
        rows.select("doc_id", "piece", F.least(F.lit(capacity), F.col("length") - F.col("piece").cast("long") * capacity).cast("int").alias("n_tokens"), "source", "cluster"),
        "pieces",
    )
    shards = rows.count() // shard_rows + 1
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack_shard(capacity), SCHEMA)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents packed by their byte-level tokens; copies but for the case of A-Z are a cluster."""
    return pack(docs, F.octet_length("text"), text_digest("text"), F.col("source"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
