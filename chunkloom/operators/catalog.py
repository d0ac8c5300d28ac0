"""What a collection holds: per-document rows, counts, lookups, filters.

Per-source results are aggregations with map-side combine, so a source that holds a large
share of all chunks is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import base_name, content_hash, in_scope, is_web_path, md5_short, source_class
from chunkloom.model import PAGE_SIZE
from chunkloom.operators.containment import containing
from chunkloom.operators.sync import delete_sources
from chunkloom.session import write_through

FIRST = ["source_name", "source_type", "content_hash", "created_at"]


def list_documents(chunks: DataFrame) -> DataFrame:
    """One row per source: the values of its first chunk and its chunk count."""
    return (
        chunks.filter(F.col("source") != "")
        .groupBy("source")
        .agg(F.min_by(F.struct(*FIRST), "chunk_index").alias("_first"), F.count("*").alias("chunks"))
        .select("source", *[F.col(f"_first.{c}").alias(c) for c in FIRST], "chunks")
    )


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct()


def source_hashes(chunks: DataFrame) -> DataFrame:
    """The stored hash of each source, from its first chunk."""
    return chunks.groupBy("source").agg(F.min_by("content_hash", "chunk_index").alias("content_hash"))


def exists_in(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``wanted(source)`` with a flag that tells whether the collection has it."""
    stored = list_sources(chunks).withColumn("_found", F.lit(True))
    return wanted.join(stored, "source", "left").select(
        *wanted.columns, F.coalesce("_found", F.lit(False)).alias("stored")
    )


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def filter_source(chunks: DataFrame, source: str) -> DataFrame:
    """Equality on a stored column; reaches the parquet scan as a pushed filter."""
    return chunks.filter(F.col("source") == source)


def filter_scope(rows: DataFrame, scope: str, path: str = "source") -> DataFrame:
    return rows.filter(in_scope(scope, path, "source_type"))


def document_catalog(local: DataFrame, stored: DataFrame, scope: str = "all") -> DataFrame:
    """Local files (``path``) and stored documents side by side.

    ``imported`` is both, ``local`` only a file, ``orphan`` only a stored local file.
    """
    keep_web = {"all": None, "docs": False, "web": True}[scope]
    files = local.select("path")
    if keep_web is not None:
        files = files.filter(is_web_path("path") == F.lit(keep_web))
    joined = files.withColumn("_local", F.lit(True)).join(
        stored.withColumnRenamed("source", "path"), "path", "full_outer"
    )
    has_file, has_rows = F.col("_local").isNotNull(), F.col("chunks").isNotNull()
    status = F.when(has_file & has_rows, "imported").when(has_file, "local").otherwise("orphan")
    kind = F.when(source_class("path") == "web", "web").otherwise("local")
    rows = joined.filter(has_file | (F.col("source_type") == "local_file")).select(
        "path",
        F.when(has_file, base_name("path")).otherwise(F.col("source_name")).alias("name"),
        kind.alias("source_type"),
        status.alias("status"),
        F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
    )
    if keep_web is not None:
        rows = rows.filter(F.col("source_type") == ("web" if keep_web else "local"))
    return rows


def page_of(rows: DataFrame, page: int, *order: str, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a sorted listing; Spark keeps only the first ``page * size`` rows per task."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def orphans(stored: DataFrame, local: DataFrame) -> DataFrame:
    """Stored local files that no longer have a file."""
    files = local.select(F.col("path").alias("source"))
    return stored.filter(F.col("source_type") == "local_file").join(files, "source", "left_anti")


def status_counts(catalog: DataFrame) -> DataFrame:
    def n(s: str) -> Column:
        return F.count_if(F.col("status") == s).alias(s)

    return catalog.agg(n("imported"), n("local"), n("orphan"))


def corpus_stats(local: DataFrame, stored: DataFrame) -> DataFrame:
    """Files by class, stored documents and their chunks, in one row."""
    web = is_web_path("path")
    rows = local.select(web.alias("web"), F.lit(None).cast("bigint").alias("chunks")).unionByName(
        stored.select(F.lit(None).cast("boolean").alias("web"), F.col("chunks").cast("bigint"))
    )
    return rows.agg(
        F.count_if(~F.col("web")).alias("docs_count"), F.count_if("web").alias("web_count"),
        F.count_if(F.col("web").isNull()).alias("vector_docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
    )


def collection_stats(stored: DataFrame, name: str) -> DataFrame:
    return stored.agg(
        F.lit(name).alias("collection"),
        F.count("*").alias("documents"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks"),
    )


def delete_totals(stored: DataFrame, scope: str = "all") -> DataFrame:
    return filter_scope(stored, scope).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks")
    )


def find_by_name(stored: DataFrame, name: str) -> DataFrame:
    """The document with exactly this name, else the first that contains it in any case."""
    hit = F.when(F.col("source_name") == name, 0).when(
        F.contains(F.lower("source_name"), F.lit(name.lower())), 1
    )
    ranked = stored.withColumn("match_rank", hit).filter(F.col("match_rank").isNotNull())
    return ranked.orderBy("match_rank", "source").limit(1)


def match_names(stored: DataFrame, names: DataFrame) -> DataFrame:
    """Documents whose name contains one of ``names(name)`` in any case, each once. The documents, one short row each, are
    written first: they are read several times and may stand for a whole corpus that is cut."""
    stored = write_through(stored, "stored-documents")
    wanted = names.select(F.lower("name").alias("needle")).distinct()
    hits = containing(stored.select("source", F.lower("source_name").alias("text")), "source", wanted)
    return stored.join(hits.select("source").distinct(), "source", "left_semi")


def file_tables(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a file store: files (``file_id, file_name, file_hash, chunk_count``) and chunks (``chunk_id, file_id, chunk_index``)."""
    rows = chunks.select(F.col("id").alias("chunk_id"), md5_short("source").alias("file_id"), "chunk_index")
    per = rows.groupBy("file_id").agg(F.count("*").alias("_n"))
    named = files.select(md5_short("path").alias("file_id"), base_name("path").alias("file_name"), content_hash("text").alias("file_hash"))
    stored = named.join(per, "file_id", "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")
    return stored, rows


def cascade_delete(files: DataFrame, chunks: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and chunks that are left after the files in ``removed(file_id)`` are deleted; the list is written once and read by both."""
    gone = write_through(removed.select("file_id").distinct(), "removed-files")
    return files.join(gone, "file_id", "left_anti"), chunks.join(gone, "file_id", "left_anti")


def dedup_by_hash(files: DataFrame, digest: str = "file_hash", first_by: str = "path") -> DataFrame:
    """The first file of every content; reduced before the shuffle."""
    rest = [c for c in files.columns if c != digest]
    return files.groupBy(digest).agg(
        F.min_by(F.struct(*rest), first_by).alias("_row"), F.count("*").alias("copies")
    ).select(digest, *[F.col(f"_row.{c}").alias(c) for c in rest], "copies")


def files_rollup(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file (``path``) with its chunk count, characters and status: ``done`` once it has
    chunks, else ``pending``."""
    per = chunks.groupBy(F.col("source").alias("path")).agg(
        F.count("*").alias("_n"), F.sum(F.length("text")).cast("bigint").alias("_chars")
    )
    zero = F.lit(0).cast("bigint")
    return files.select("path").join(per, "path", "left").select(
        "path",
        F.coalesce("_n", zero).alias("chunk_count"),
        F.coalesce("_chars", zero).alias("chars"),
        F.when(F.col("_n") > 0, "done").otherwise("pending").alias("status"),
    )
