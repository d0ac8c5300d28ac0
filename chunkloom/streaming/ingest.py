"""Streaming ingest: new or changed documents flow into a folder of chunks by epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.model import VECTOR_CHUNK
from chunkloom.operators.chunking import chunk_corpus
from chunkloom.operators.embedding import embed
from chunkloom.streaming.runs import run_batches, written_rows

INGESTED = T.StructType([*VECTOR_CHUNK.fields, T.StructField("epoch", T.LongType())])


def ingest(docs: DataFrame, path: str, state: str, template=None, model=None, created_at=None) -> None:
    """Write the chunks of every micro-batch of ``docs(path, text)`` to a folder of its epoch. A repeated epoch overwrites itself.

    A path that arrives twice in a micro-batch is kept once: the row with the largest ``version``
    column (a time or offset), if ``docs`` has it; of equal ones that with the largest text.
    """
    def store(rows: DataFrame, epoch: int) -> None:
        order = [c for c in ("version",) if c in rows.columns]
        newest = rows.groupBy("path").agg(F.max(F.struct(*order, "text")).alias("_row"))
        chunks = chunk_corpus(newest.select("path", "_row.text"), template, created_at=created_at)
        embed(chunks, model).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    run_batches(docs, store, state)


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the newest epoch of each source."""
    rows = written_rows(spark, path, INGESTED)
    newest = rows.groupBy(F.col("source").alias("_source")).agg(F.max("epoch").alias("_epoch"))
    latest = (F.col("source") == F.col("_source")) & (F.col("epoch") == F.col("_epoch"))
    return rows.join(newest, latest).select(*VECTOR_CHUNK.fieldNames())
