"""Chunk collections as snapshots.

A run reads one snapshot, works out what changes (a join of short per-source rows), and writes the next one to a new folder: kept chunks
as they are, and only added or changed documents cut and embedded again. The run returns the folder; earlier snapshots stay
readable until their owner removes them. Which snapshot is current, concurrent writers and their conflicts are left to the
table format or catalog of the user; a lost job leaves a folder that nobody was given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.text import is_supported
from chunkloom.model import VECTOR_CHUNK, VECTOR_CHUNK_COLUMNS, Template, get_template
from chunkloom.operators.catalog import delete_totals, filter_scope, list_documents, orphans
from chunkloom.operators.chunking import chunk_corpus
from chunkloom.operators.embedding import HASH_DIM, embed
from chunkloom.operators.imports import import_status
from chunkloom.operators.sync import chunks_to_add, current_state, delete_sources, plan_sync, sources_to_drop, with_paths
from chunkloom.session import scratch_path, write_through
from chunkloom.sources.tables import load_corpus

HEADER = ["source", "source_name", "source_type", "content_hash", "created_at", "chunk_index"]


@dataclass(frozen=True)
class Snapshot:
    """A written collection: its folder and the template its chunks were cut with."""

    path: str
    template: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(VECTOR_CHUNK).parquet(f"{self.path}/chunks")

    def documents(self, spark: SparkSession) -> DataFrame:
        """Stored documents with chunk counts; texts and vectors are not read."""
        return list_documents(self.read(spark).select(*HEADER))


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(path, spark.read.parquet(f"{path}/info").first()["template"])


def snapshot_checks(chunks: DataFrame) -> DataFrame:
    """One row of checks: count, unique ids, a single dimension, no null vector."""
    size = F.size("embedding")
    return chunks.agg(
        F.count("*").alias("chunks"),
        (F.count("*") == F.count_distinct("id")).alias("unique_ids"),
        F.coalesce(F.min(size) == F.max(size), F.lit(True)).alias("single_dim"),
        F.count_if(F.col("embedding").isNull()).alias("null_vectors"),
    ).withColumn("valid", F.col("unique_ids") & F.col("single_dim") & (F.col("null_vectors") == 0))


def write_snapshot(rows: DataFrame, template: Template | str | None = None, path: str | None = None) -> Snapshot:
    """Write ``rows`` to a new folder and check what was written; an invalid one is an error."""
    spark, path = rows.sparkSession, path or scratch_path(rows.sparkSession, "snapshot")
    snapshot = Snapshot(path, get_template(template).name)
    rows.select(*VECTOR_CHUNK_COLUMNS).write.parquet(f"{path}/chunks")
    checks = snapshot_checks(snapshot.read(spark)).first()
    if not checks.valid:
        raise ValueError(f"snapshot is not valid: {checks.asDict()}")
    spark.createDataFrame([(snapshot.template,)], "template string").write.parquet(f"{path}/info")
    return snapshot


def build(docs: DataFrame, template: Template | str | None = None, path: str | None = None, model=None, source_type: str = "local_file", created_at: str | None = None) -> Snapshot:
    """All chunks of ``docs(path, text)``."""
    t = get_template(template)
    return write_snapshot(embed(chunk_corpus(docs, t, source_type, created_at), model), t, path)


def upsert(old: Snapshot, docs: DataFrame, path: str | None = None, model=None, template: Template | str | None = None, source_type: str = "local_file", created_at: str | None = None) -> Snapshot:
    """Add documents; chunks already stored for the same sources go. The template is the stored one; another is an error."""
    t = _stored_template(old, template)
    kept = delete_sources(old.read(docs.sparkSession), docs.select(F.col("path").alias("source")))
    fresh = embed(chunk_corpus(docs, t, source_type, created_at), model)
    return write_snapshot(kept.unionByName(fresh), t, path)


def _stored_template(old: Snapshot, template: Template | str | None) -> Template:
    t = get_template(template or old.template)
    if t.name != old.template:
        raise ValueError(f"the snapshot holds chunks of template {old.template}: build one with {t.name} instead")
    return t


def delete(old: Snapshot, sources: DataFrame, path: str | None = None) -> Snapshot:
    return write_snapshot(delete_sources(old.read(sources.sparkSession), sources), old.template, path)


def delete_scope(spark: SparkSession, old: Snapshot, scope: str = "all", path: str | None = None) -> tuple[Snapshot, DataFrame]:
    """Without the documents of a scope, and how many documents and chunks those were."""
    inside = write_through(filter_scope(old.documents(spark), scope).select("source", "source_type", "chunks"), "scope")
    return delete(old, inside.select("source"), path), delete_totals(inside)


def sync(
    old: Snapshot, docs: DataFrame, template: Template | str | None = None, scope: str = "all", paths: DataFrame | None = None, path: str | None = None,
    model=None, created_at: str | None = None,
) -> tuple[Snapshot, DataFrame]:
    """In step with ``docs``, and the plan that was applied.

    ``paths(path)`` lists all files that are there. A listed file without a document (blank, not decodable) keeps its stored chunks; without the
    list, sources that have no document are deleted. Another template than the stored one changes every chunk, so it builds anew.
    """
    spark, t = docs.sparkSession, get_template(template or old.template)
    current = current_state(docs)
    if paths is not None:
        current = with_paths(current, paths)
    plan = write_through(plan_sync(current, old.documents(spark), scope), "plan")
    if t.name != old.template:
        if scope != "all":
            raise ValueError("another template needs a rebuild of the whole collection")
        return build(docs, t, path, model, created_at=created_at), plan
    kept = delete_sources(old.read(spark), sources_to_drop(plan))
    fresh = embed(chunks_to_add(plan, docs, t, created_at), model)
    return write_snapshot(kept.unionByName(fresh), t, path), plan


def clean_orphans(old: Snapshot, local: DataFrame, path: str | None = None) -> Snapshot:
    """Without stored local files that have no file among ``local(path)``."""
    return delete(old, orphans(old.documents(local.sparkSession), local), path)


def reembed(spark: SparkSession, old: Snapshot, path: str | None = None, model=None, dim: int = HASH_DIM) -> Snapshot:
    """The stored texts embedded again; ``dim`` is that of the default embedding."""
    return write_snapshot(embed(old.read(spark).drop("embedding"), model, dim=dim), old.template, path)


def import_files(
    old: Snapshot, requests: DataFrame, files: DataFrame, path: str | None = None, model=None, created_at: str | None = None
) -> tuple[Snapshot, DataFrame]:
    """Store the requested ``file``s that can be, and tell of each request how it went (``file, status, chunks, message``).

    ``files`` has ``path, text``. A file that is requested several times is stored once and reported each time; one that can't be
    imported leaves what is stored of it.
    """
    asked = requests.select(F.col("file").alias("path")).distinct()
    docs = load_corpus(files.filter(is_supported("path")).join(asked, "path", "left_semi"))
    # cut once: counted for the report, then embedded and stored
    cut = write_through(chunk_corpus(docs, old.template, created_at=created_at), "cut")
    report = write_through(import_status(requests, files, old.template, cut), "import-report")
    kept = delete_sources(old.read(docs.sparkSession), cut.select("source"))
    return write_snapshot(kept.unionByName(embed(cut, model)), old.template, path), report
