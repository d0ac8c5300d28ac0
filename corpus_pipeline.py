"""The corpus pipeline: language ID, exact and near de-duplication, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import written
from chunkloom.llm.exact_dedup import exact_dedup
from chunkloom.llm.language_id import fit, held_out, keep_identified
from chunkloom.llm.minhash_dedup import near_dedup
from chunkloom.llm.packing import pack_documents
from chunkloom.llm.substring_dedup import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; null texts and such without one go. Texts in other languages and noise stay."""
    return keep_identified(docs, fit(docs.where(~held_out("doc_id"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the document with the smallest id."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what a document of smaller id has too; n_chars is that of the new text."""
    cut = without_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each piece of every document."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", substrings), ("packing", packing)]

#: MinHash, suffix sorting and packing aren't expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
