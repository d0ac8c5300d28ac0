"""Corpora, collections and message tables derived from the given tables.

Every input reads its whole tables. The "before" and "now" corpora differ the way the
labels say: a document labelled as poor quality is new, a toxic one has been taken down,
a reviewed good one has a changed text, and all others are as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.catalog import list_documents
from chunkloom.operators.chunking import chunk_corpus
from chunkloom.operators.embedding import hash_embed
from chunkloom.sources.pages import page_corpus
from chunkloom.sources.tables import document_files, load_corpus, read_table
from chunkloom.streaming.runs import as_instants

STAMP = "2026-01-01 00:00:00"


def files(spark: SparkSession, d: str) -> DataFrame:
    return document_files(read_table(spark, d, "documents", "doc_id"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return load_corpus(files(spark, d))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages", "page_id")


def web_corpus(spark: SparkSession, d: str) -> DataFrame:
    return page_corpus(pages(spark, d), STAMP)


def web_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the stored pages; the pages themselves are not read."""
    name = F.substring(F.md5("url"), 1, 12)
    return read_table(spark, d, "pages").select(F.concat(F.lit("/data/web/"), name, F.lit(".txt")).alias("path"))


def chunks(spark: SparkSession, d: str, template: str = "academic") -> DataFrame:
    return chunk_corpus(corpus(spark, d), template, created_at=STAMP)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The chunk vectors of the corpus, without texts."""
    embedded = hash_embed(chunks(spark, d))
    return embedded.select("id", "source", "chunk_index", "embedding")


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    return list_documents(chunks(spark, d))


def labelled_files(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return files(spark, d).join(labels, "doc_id", "left")


def corpus_before(spark: SparkSession, d: str) -> DataFrame:
    was = labelled_files(spark, d).filter(~F.col("quality").eqNullSafe(0))
    return load_corpus(was)


def corpus_now(spark: SparkSession, d: str) -> DataFrame:
    now = labelled_files(spark, d).filter(~F.col("toxic").eqNullSafe(1))
    reviewed = F.when(F.col("quality") == 1, F.concat("text", F.lit(" reviewed"))).otherwise(F.col("text"))
    return load_corpus(now.withColumn("text", reviewed))


def chunks_before(spark: SparkSession, d: str) -> DataFrame:
    return chunk_corpus(corpus_before(spark, d), created_at=STAMP)


def toxic_sources(spark: SparkSession, d: str) -> DataFrame:
    return labelled_files(spark, d).filter(F.col("toxic") == 1).select(F.col("path").alias("source"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with its lines as paragraphs."""
    return corpus(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with every third line as a header."""
    marked = F.transform(
        F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), x)).otherwise(x)
    )
    return corpus(spark, d).withColumn("text", F.array_join(marked, "\n"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def label_centres(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of every label as a query."""
    flat = read_table(spark, d, "embeddings").select("label", F.posexplode_outer("embedding").alias("pos", "v"))
    means = flat.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda e: e["m"]).alias("embedding")
    )


def import_files(spark: SparkSession, d: str) -> DataFrame:
    """Files on disk: all documents, an executable per label, a blank file per benchmark item."""
    exe = read_table(spark, d, "labels").select(
        F.concat(F.lit("/data/docs/tools/"), F.col("doc_id").cast("string"), F.lit(".EXE")).alias("path"),
        F.lit("MZ").alias("text"),
    )
    blank = read_table(spark, d, "benchmark").select(
        F.concat(F.lit("/data/docs/blank/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(" \n　").alias("text"),
    )
    return files(spark, d).select("path", "text").unionByName(exe).unionByName(blank)


def import_requests(spark: SparkSession, d: str) -> DataFrame:
    """All files on disk and the page files, which are not there."""
    here = import_files(spark, d).select(F.col("path").alias("file"))
    return here.unionByName(web_paths(spark, d).select(F.col("path").alias("file")))


def vector_text(v: str) -> Column:
    """A vector as text: millionths, comma separated."""
    return F.array_join(F.transform(v, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")


def event_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events as they arrive: the first half of the time, the second half with every tenth message twice, then every fiftieth message late
    and some of the others again. Times are instants."""
    rows = as_instants(read_table(spark, d, "events"))
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    middle = ends.select((F.unix_micros("a") / 2 + F.unix_micros("b") / 2).cast("bigint")).first()[0]
    first = F.unix_micros("ts") <= F.lit(middle or 0)
    late, again = F.col("event_id") % 50 == 0, F.col("event_id") % 10 == 3
    second = rows.filter(~first & ~late)
    return [rows.filter(first & ~late), second.unionByName(second.filter(again)), rows.filter(late | again)]


def user_messages(events: DataFrame) -> DataFrame:
    """Events as messages on a user's channel: a view asks and waits (k + 1) hours, a purchase answers."""
    ttl = (F.from_json("props", "k int")["k"] + 1) * 3600
    asks, answers = F.col("event_type") == "view", F.col("event_type") == "purchase"
    return events.filter(asks | answers).select(
        F.col("user_id").alias("channel"), F.col("event_id").alias("id"), "ts", F.when(asks, ttl).alias("ttl"), answers.alias("is_answer")
    )
