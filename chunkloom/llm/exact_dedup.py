"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with as many buckets as its first batch asks for. New data is reduced to
one row per digest and anti-joined with the index by a sort-merge join on the index's buckets; digests that are new are
appended with the id that stays, and of known ones only how often they came. A batch adds a file to each bucket, sorted by itself.

Texts are equal when identical after lower-casing A-Z only. Null counts as the empty text. Of equal
texts of one batch the row with the largest id stays (null ids are smallest). Rows that repeat with the largest id are all marked as such by
``exact_groups``; ``exact_dedup`` returns one of them. Against earlier batches the text that is indexed already stays, and
group sizes count the rows of all batches so far (a batch that is added twice counts twice). Empty tables give
empty results. Columns other than id and text aren't read and are passed on as they are.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, keep_rows, utf8, written
from chunkloom.session import scratch_path

DIGEST = "__digest"


@F.arrow_udf(T.BinaryType())
def _digest(texts: pa.Array) -> pa.Array:
    # bytes.lower() changes A-Z and nothing else
    return pa.array([hashlib.sha256(t.lower()).digest() for t in utf8(texts)], pa.binary())


def text_digest(text: str) -> F.Column:
    """SHA-256 of the text with A-Z lower-cased."""
    return _digest(F.coalesce(F.col(text), F.lit("")))


#: Rows of the first batch for each bucket of an index.
BUCKET_ROWS = 4_000_000


class DigestIndex:
    """Digests seen so far, bucketed and sorted by digest: a row with ``first`` for each, and one for each later batch that has it."""

    COLUMNS = "digest binary, keep_id long, group_size long, first boolean"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()

    def _opened(self, rows: DataFrame) -> DataFrame:
        """The table, made for a first batch like ``rows`` if there is none."""
        if not self.spark.catalog.tableExists(self.table):
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = self.buckets or max(least, -(-rows.count() // BUCKET_ROWS))
            self.spark.sql(
                f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet OPTIONS (path '{self.path}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )
        told = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
        self.buckets = int(told["data_type"])
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size) of each digest, over all batches."""
        if not self.spark.catalog.tableExists(self.table):
            return self.spark.createDataFrame([], self.COLUMNS).drop("first")
        rows = self.spark.read.schema(self.COLUMNS).parquet(self.path)
        return rows.groupBy("digest").agg(F.max(F.struct("first", "keep_id"))["keep_id"].alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, rows: DataFrame) -> None:
        """Append what ``rows`` (doc_id, digest) bring."""
        known = self._opened(rows).where("first").select("digest")
        # written first, or the optimizer moves the join below the aggregation, where all copies of a text meet in one task
        batch = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-batch").hint("merge")
        new = batch.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
        if not known.isEmpty():
            new = new.unionByName(batch.join(known, "digest", "left_semi").withColumn("first", F.lit(False)))
        (
            new.repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, scratch_path(spark, f"digest-index-{uuid.uuid4().hex}"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size. Adds to ``index``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = index or new_index(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"))
    rows = written(rows, "digests")
    index.add(rows)
    # Entries as a written table: both sides come from plain shuffles, so a hot digest can be split.
    return rows.join(written(index.read(), "digest-entries"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    index = index or new_index(docs.sparkSession)
    groups = exact_groups(docs, id_col, text_col, index)
    stay = written(
        groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "doc_id").agg(F.count("*").alias("n")),
        "kept",
    ).select(F.col("digest").alias(DIGEST), F.col("doc_id").alias("__id"), "n")
    rows = docs.withColumns({DIGEST: text_digest(text_col), "__id": F.col(id_col).cast("long")})
    kept = keep_rows(rows, stay, [DIGEST, "__id"])
    repeated = stay.where("n > 1")
    if not repeated.isEmpty():
        single = keep_rows(rows, stay.where("n = 1"), [DIGEST, "__id"])
        kept = single.unionByName(keep_rows(rows, repeated, [DIGEST, "__id"]).dropDuplicates([DIGEST, "__id"]))
    return kept.drop(DIGEST, "__id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays in its stead."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: DuckDB's lower() changes other letters too, hence translate().
OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
