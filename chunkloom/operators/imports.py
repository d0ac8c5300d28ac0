"""Importing a list of requested files, with a status per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import extension, is_blank, is_supported, stem, with_name_prefix
from chunkloom.model import MSG_EMPTY, MSG_MISSING, MSG_UNSUPPORTED, Template
from chunkloom.operators.chunking import with_chunks


def import_status(requests: DataFrame, files: DataFrame, template: Template | str | None = None, cut: DataFrame | None = None) -> DataFrame:
    """``file, status, chunks, message`` for each requested ``file``.

    ``files`` has ``path, text``. Checks go in order: the file exists, its format is known,
    it has text. Chunks are counted in the scan of the files, so no text takes part in the join; where the requested files'
    chunks ``cut(source)`` are stored already, they are counted there.
    """
    if cut is not None:
        per = cut.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("_chunks"))
        counted = files.select(F.col("path").alias("file"), is_blank("text").alias("_blank"), F.lit(True).alias("_found")).join(per, "file", "left")
        return _reported(requests, counted)
    usable = is_supported("path") & ~is_blank("text")
    bodies = files.select(
        F.col("path").alias("file"), is_blank("text").alias("_blank"),
        F.when(usable, with_name_prefix(stem("path"), "text")).alias("_body"),
    )
    counted = with_chunks(bodies, template, text="_body").select(
        "file", "_blank", F.size("chunks").cast("bigint").alias("_chunks"), F.lit(True).alias("_found")
    )
    return _reported(requests, counted)


def _reported(requests: DataFrame, counted: DataFrame) -> DataFrame:
    found = requests.join(counted, "file", "left")
    message = (
        F.when(F.col("_found").isNull(), MSG_MISSING)
        .when(~is_supported("file"), F.concat(F.lit(f"{MSG_UNSUPPORTED}: ."), extension("file")))
        .when(F.col("_blank"), MSG_EMPTY)
    )
    rows = found.withColumn("message", message)
    ok = F.col("message").isNull()
    return rows.select(
        "file", F.when(ok, "success").otherwise("error").alias("status"), F.when(ok, F.col("_chunks")).alias("chunks"), "message"
    )


def import_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("status") == "success").alias("imported"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
        F.count("*").alias("total_files"),
    )
