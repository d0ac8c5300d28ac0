"""Search over a chunk table: vector stage, optional rerank stage, result shaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.text import base_name, strip, tokens
from chunkloom.functions.vectors import similarity
from chunkloom.model import ANSWER_COUNT, ANSWER_FOUND, ANSWER_RANKED, ANSWER_SIMILARITY, ANSWER_SOURCE, FETCH_K, TOP_K
from chunkloom.operators.chunking import with_chunks
from chunkloom.operators.embedding import embed
from chunkloom.operators.knn import Hits, nearest
from chunkloom.session import write_through

PairScore = Callable[[Column, Column], Column]


def lexical_score(query: Column, text: Column) -> Column:
    """Shared distinct tokens over the root of the product of both token counts."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    size = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when(size == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / size)


def text_of_hits(hits: Hits, docs: DataFrame, template=None) -> DataFrame:
    """Add the chunk text of each hit by cutting its document again.

    Only documents with a hit are touched, and each is cut once however many queries hit it.
    The hits are written first: their size is then known, so the planner broadcasts them
    only if they are small, and the corpus is scanned and not shuffled.
    """
    found = write_through(hits.rows, "hits").withColumnRenamed("source", "path")
    touched = docs.select("path", "text").join(found.select("path").distinct(), "path", "left_semi")
    cut = with_chunks(touched, template).select("path", F.posexplode_outer("chunks").alias("chunk_index", "text"))
    return found.join(cut, ["path", "chunk_index"]).withColumnRenamed("path", "source")


def text_of_stored(hits: Hits, chunks: DataFrame) -> DataFrame:
    """Add the chunk text of each hit from a stored collection."""
    return chunks.select("id", "text").join(write_through(hits.rows, "hits"), "id")


def rerank(candidates: DataFrame, queries: DataFrame, k: int, score: PairScore = lexical_score) -> DataFrame:
    """The k best candidates per query by pair score; ties keep the vector order.

    A query with a single candidate is not scored.
    """
    scored = candidates.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    value = F.floor(score(F.col("_query"), F.col("text")) * 1e6 + 0.5) / 1e6
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return (
        scored.withColumn("rerank_score", F.when(several, value))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("_query")
    )


def shape_hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "rank",
        "id",
        strip("text").alias("text"),
        "source",
        base_name("source").alias("filename"),
        "chunk_index",
        "distance",
        similarity(F.col("distance")).alias("similarity"),
        (F.col("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")).alias("rerank_score"),
    )


def search(
    queries: DataFrame,
    vectors: DataFrame,
    texts: Callable[[Hits], DataFrame],
    k: int = TOP_K,
    fetch_k: int = FETCH_K,
    score: PairScore | None = None,
    space: str = "cosine",
    model=None,
) -> DataFrame:
    """Hits of ``queries(query_id, text)`` in ``vectors(id, source, chunk_index, embedding)``.

    With a pair score ``fetch_k`` candidates are fetched and the best ``k`` kept. ``texts``
    adds the chunk text to the ranked hits (``text_of_hits`` or ``text_of_stored``).
    """
    depth = fetch_k if score else k
    found = nearest(
        embed(queries, model), vectors, depth, space, keep=("source", "chunk_index")
    )
    hits = texts(found)
    if score:
        hits = rerank(hits, queries, k, score)
    return shape_hits(hits)


def search_totals(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per query; a query without any shows 0."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    return queries.select("query_id").join(n, "query_id", "left").select(
        "query_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("total")
    )


def similarity_band(sim: Column) -> Column:
    """Display class of a similarity in percent."""
    pct = sim * 100
    return F.when(pct >= 80, "success").when(pct >= 60, "warning").otherwise("info")


def _hundredths(value: Column) -> Column:
    """A value with 6 places as text with 2, by integer arithmetic."""
    n = F.floor((F.round(value * 1e6).cast("bigint") + 5_000) / 10_000).cast("bigint")
    return F.concat(F.floor(n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def answer_blocks(hits: DataFrame) -> DataFrame:
    """One text per query: a head line, then numbered source lines, each followed by its
    chunk. The head line of re-ranked hits lists the scores. At most k rows meet per query."""
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit(ANSWER_SOURCE), F.col("filename"),
        F.lit(ANSWER_SIMILARITY), _hundredths(F.col("similarity") * 100), F.lit("%\n"), F.col("text"),
    )
    score = F.col("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")
    row = F.struct("rank", block.alias("block"), _hundredths(score).alias("score"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    scores = F.array_join(F.transform("_rows", lambda r: r["score"]), ", ")
    ranked = F.when(
        F.get("_rows", F.lit(0))["score"].isNotNull(), F.concat(F.lit(ANSWER_RANKED), scores)
    ).otherwise("")
    head = F.concat(F.lit(ANSWER_FOUND), F.size("_rows").cast("string"), F.lit(ANSWER_COUNT), ranked, F.lit("\n\n\n"))
    body = F.array_join(F.transform("_rows", lambda r: r["block"]), "\n\n")
    return rows.select("query_id", F.concat(head, body).alias("answer"))
