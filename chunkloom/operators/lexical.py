"""Lexical search: a stored inverted index, BM25 scores, rank fusion and feedback.

The index is cut into segments of chunks, as the pass that counts meets them: a row holds the postings of a term in a segment,
that is the chunks' numbers inside of it with the count of the term and the length of the chunk, so scoring needs no look-up of chunks. No text, token or
posting is shuffled to build it. Rows are partitioned by bucket, a hash of the term, and sorted by term: a search reads only the buckets of its terms
(dynamic partition pruning).

A search touches the rows of the query terms and nothing else. They meet by segment, where all queries are scored and limited
to their k best: what follows has k rows for each query and segment, however many chunks hold a query's words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.functions.text import tokens
from chunkloom.model import BM25_B, BM25_K1, FUSION_CONSTANT, TOP_K
from chunkloom.operators.knn import Hits
from chunkloom.session import scratch_path, write_through

#: Postings of a bucket, rows of a file, and queries that are scored in one group.
BUCKET_ROWS, FILE_ROWS, MOST_BUCKETS, QUERY_BLOCK = 32_000_000, 2_000_000, 1024, 4096
#: Chunks of a segment, and bytes of their words.
SEGMENT_ROWS, SEGMENT_BYTES = 16_384, 48 << 20


@dataclass
class LexicalIndex:
    """Tables below ``path``: postings (bucket, term, segment, places, counts, lengths), terms (bucket, term, chunks),
    chunks (segment, place, id, length, *keep).

    ``chunks`` and ``length`` are the number of chunks and their mean length in tokens; ``unique`` tells that each has an id of its own.
    """

    spark: SparkSession
    path: str
    chunks: int
    length: float
    buckets: int
    keep: tuple[str, ...]
    unique: bool = True

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")


def counted_terms(words: str) -> Column:
    """``array<struct<term, n>>`` of the token array in column ``words``, by its runs after sorting."""
    order = F.array_sort(words)

    def runs(held: Column) -> Column:
        last = F.size(held) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        return F.flatten(
            F.transform(
                F.array(first),
                lambda at: F.transform(
                    at, lambda i, k: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(at, k + 1), last + 1) - i).alias("n"))
                ),
            )
        )

    # single-element transforms name the sorted list once
    return F.flatten(F.transform(F.array(order), runs))


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _inverted(schema: T.StructType) -> Callable:
    """Segments of chunks ``(id, *keep, _words)``: a row for each chunk, in the order of ids, and one for each term."""
    names = to_arrow_schema(schema)

    def table(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in names], schema=names)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= SEGMENT_ROWS or sum(x.nbytes for x in held) >= SEGMENT_BYTES:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, chunks in enumerate(gathered(batches)):
            chunks = chunks.combine_chunks()
            chunks = chunks.take(pc.sort_indices(chunks["id"])).combine_chunks()
            n, segment = len(chunks), (task << 32) + i
            if not n:
                continue
            words = chunks["_words"].chunk(0)
            lengths = words.value_lengths().to_numpy().astype(np.int32)
            coded = words.flatten().dictionary_encode()
            # (term, chunk) as one number each, in this order
            met, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
            term, place = met // n, (met % n).astype(np.int32)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            ends = pa.array(np.append(first, len(term)).astype(np.int32))
            kept = {c: chunks[c].chunk(0) for c in chunks.column_names if c != "_words"}
            yield table(n, segment=pa.array(np.full(n, segment)), place=pa.array(np.arange(n)), length=pa.array(lengths), **kept)
            yield table(
                len(first), segment=pa.array(np.full(len(first), segment)), term=coded.dictionary.take(pa.array(term[first])),
                places=pa.ListArray.from_arrays(ends, pa.array(place)), counts=pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
                lengths=pa.ListArray.from_arrays(ends, pa.array(lengths[place])),
            )

    return inverted


def build_lexical_index(chunks: DataFrame, keep: tuple[str, ...] = ("source", "chunk_index"), text: str = "text", path: str | None = None) -> LexicalIndex:
    """Index chunks ``(id, text, *keep)``. Ids should be unique (chunks that share one are scored as one, by a slower search); a chunk without a token counts
    as one of length 0."""
    spark = chunks.sparkSession
    path = path or scratch_path(spark, "lexical")
    words = chunks.select("id", *keep, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    fields = [("segment", T.LongType()), ("place", T.IntegerType()), ("length", T.IntegerType()), ("term", T.StringType())]
    fields += [(c, T.ArrayType(T.IntegerType())) for c in ("places", "counts", "lengths")]
    schema = T.StructType([*words.drop("_words").schema.fields, *[T.StructField(*f) for f in fields]])
    rows = write_through(words.mapInArrow(_inverted(schema), schema), "segments")
    rows.where("term is null").select("segment", "place", "id", "length", *keep).write.parquet(f"{path}/chunks")
    index = LexicalIndex(spark, path, 0, 0.0, 1, keep)
    whole = index.read("chunks").agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), (F.count("*") == F.count_distinct("id")).alias("unique")
    ).first()
    postings = rows.where("term is not null")
    n = postings.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    index.chunks, index.length, index.unique = whole["chunks"], whole["length"] / max(whole["chunks"], 1), whole["unique"]
    index.buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    dealt = postings.withColumn("bucket", bucket_of("term", index.buckets)).sortWithinPartitions("bucket", "term")
    dealt = dealt.select("term", "segment", "places", "counts", "lengths", "bucket")
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{path}/postings")
    _postings(index).groupBy("bucket", "term").agg(F.sum(F.size("places")).alias("chunks")).write.parquet(f"{path}/terms")
    return index


def _postings(index: LexicalIndex) -> DataFrame:
    # with a schema, so that an index without postings can be read
    schema = "term string, segment bigint, places array<int>, counts array<int>, lengths array<int>, bucket int"
    return index.spark.read.schema(schema).parquet(f"{index.path}/postings")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, weight): each distinct token of a query once."""
    words = F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))
    return queries.select("query_id", F.explode(words).alias("term"), F.lit(1.0).alias("weight"))


def inverse_frequency(chunks: int, holding: Column) -> Column:
    return F.log(1 + (F.lit(float(chunks)) - holding + 0.5) / (holding + 0.5))


def _micro(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def search_terms(terms: DataFrame, index: LexicalIndex, k: int = TOP_K, k1: float = BM25_K1, b: float = BM25_B) -> Hits:
    """``query_id, rank, id, score, *keep`` of the k chunks with the highest BM25 score per query, each term (query_id, term, weight) scaled by
    its weight. Scores are rounded to 6 places, ties go to the smaller id; chunks without a query term are no hits."""
    asked = write_through(terms.withColumn("bucket", bucket_of("term", index.buckets)), "query-terms")
    known = asked.join(index.read("terms").withColumnRenamed("chunks", "_holding"), ["bucket", "term"])
    known = write_through(known.withColumn("_idf", inverse_frequency(index.chunks, F.col("_holding"))), "known-terms")
    scored = _scored_by_segment(known, index, k, k1, b) if index.unique else _scored_by_id(known, index, k1, b)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    ranked = write_through(ranked, "lexical-hits")
    rows = index.read("chunks").select("id", *index.keep).join(ranked, "id")
    return Hits(rows.select("query_id", "rank", "id", "score", *index.keep), True)


def _scored_by_segment(known: DataFrame, index: LexicalIndex, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of the k best chunks of each segment and query; equal scores go by place, which is the order of ids."""
    schema = T.StructType([known.schema["query_id"], T.StructField("segment", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-known.select("query_id").distinct().count() // QUERY_BLOCK))
    asked = known.select("query_id", "term", (F.col("weight") * F.col("_idf")).alias("value"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.crossJoin(index.read("chunks").select("segment").distinct())
    met = _postings(index).join(known.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").drop("bucket")
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scorer = _segment_scorer(to_arrow_schema(schema), k, k1, b, index.length)
    # short rows whose work is long: as many tasks as there are cores, whatever the bytes
    groups = index.read("chunks").select("segment").distinct().count() * blocks
    tasks = max(1, min(groups, max(4 * index.spark.sparkContext.defaultParallelism, groups // 16)))
    asked, met = asked.repartition(tasks, "segment", "block"), met.repartition(tasks, "segment", "block")
    best = asked.groupBy("segment", "block").cogroup(met.groupBy("segment", "block")).applyInArrow(scorer, schema)
    # of the segments' best those that may be among the k of all, ties included; only they need their ids
    best = best.withColumn("_rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("_rank") <= k)
    best = write_through(best, "segment-hits")
    return index.read("chunks").select("segment", "place", "id").join(best, ["segment", "place"]).select("query_id", "id", "score")


def _segment_scorer(schema: pa.Schema, k: int, k1: float, b: float, mean: float) -> Callable:
    def scored(asked: pa.Table, met: pa.Table) -> pa.Table:
        if not len(asked) or not len(met):
            return schema.empty_table()
        segment, met = met["segment"][0], met.combine_chunks()
        ends = np.concatenate([[0], np.cumsum(met["places"].chunk(0).value_lengths().to_numpy())])
        place, n, length = (met[c].chunk(0).flatten().to_numpy() for c in ("places", "counts", "lengths"))
        part = n * (k1 + 1) / (n + k1 * ((1 - b) + b * length / mean))
        row = {t: i for i, t in enumerate(met["term"].to_pylist())}
        queries = asked["query_id"].combine_chunks().dictionary_encode()
        here = np.array([row.get(t, -1) for t in asked["term"].to_pylist()])
        value, of = asked["value"].to_numpy(), queries.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        order = order[here[order] >= 0]
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if not len(own):
                continue
            spans = [slice(ends[i], ends[i + 1]) for i in here[own]]
            at = np.concatenate([place[x] for x in spans])
            score = np.floor(np.bincount(at, np.concatenate([part[x] * v for x, v in zip(spans, value[own], strict=True)])) * 1e6 + 0.5) / 1e6
            hit = np.flatnonzero(np.bincount(at))
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
            hit = hit[np.lexsort((hit, -score[hit]))][:k]
            out.append((np.full(len(hit), of[own[0]]), hit, score[hit]))
        if not out:
            return schema.empty_table()
        of, hit, score = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [queries.dictionary.take(pa.array(of)), pa.repeat(segment, len(hit)), pa.array(hit), pa.array(score)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scored


def _scored_by_id(known: DataFrame, index: LexicalIndex, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of all chunks that hold a query term, summed by id: for chunks that share ids."""
    met = _postings(index).join(known, ["bucket", "term"])
    met = met.select("query_id", "weight", "_idf", "segment", F.inline(F.arrays_zip("places", "counts", "lengths")))
    # a chunk without an id is no hit, so it takes no rank either
    named = index.read("chunks").where("id is not null")
    met = met.join(named.select("segment", F.col("place").alias("places"), "id"), ["segment", "places"])
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("lengths") / F.lit(index.length))
    part = F.col("weight") * F.col("_idf") * F.col("counts") * F.lit(k1 + 1) / (F.col("counts") + norm)
    return met.groupBy("query_id", "id").agg(_micro(F.sum(part)).alias("score"))


def search_bm25(queries: DataFrame, index: LexicalIndex, k: int = TOP_K) -> Hits:
    """The k best chunks of each query ``(query_id, text)``."""
    return search_terms(query_terms(queries), index, k)


def fuse(lists: list[DataFrame], k: int = TOP_K, weights: tuple[float, ...] | None = None, constant: int = FUSION_CONSTANT, keep: tuple[str, ...] = ("source", "chunk_index")) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(query_id, rank, id, *keep)``: the k ids with the highest sum of weight / (constant + rank).

    Gives ``query_id, rank, id, score, ranks, *keep``; ``ranks`` has the place in each list, null where it isn't there. Ties go to the smaller id.
    """
    weights = weights or (1.0,) * len(lists)
    if len(weights) != len(lists) or not lists:
        raise ValueError("a weight for each list is needed")
    whole = None
    for i, one in enumerate(lists):
        side = one.select("query_id", "id", F.col("rank").alias(f"_r{i}"), F.struct(*keep).alias(f"_k{i}"))
        whole = side if whole is None else whole.join(side, ["query_id", "id"], "full")
    score = sum((F.coalesce(F.lit(w) / (F.lit(constant) + F.col(f"_r{i}")), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0))
    kept = F.coalesce(*[F.col(f"_k{i}") for i in range(len(lists))])
    whole = whole.select("query_id", "id", _micro(score).alias("score"), F.array(*[F.col(f"_r{i}") for i in range(len(lists))]).alias("ranks"), kept.alias("_kept"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = whole.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score", "ranks", "_kept.*")


def feedback_terms(
    queries: DataFrame, index: LexicalIndex, texts: Callable[[Hits], DataFrame], depth: int = 5, terms: int = 10, weight: float = 0.3
) -> DataFrame:
    """Queries rewritten by what their first hits say: (query_id, term, weight).

    The own terms of a query weigh 1. Of the other terms of its ``depth`` best chunks the ``terms`` with the highest sum of
    count times inverse frequency over length are added with ``weight`` (ties: the smaller term).
    """
    own = write_through(query_terms(queries), "own-terms")
    first = search_terms(own, index, depth)
    words = texts(first).select("query_id", tokens("text").alias("_words"))
    seen = words.select("query_id", F.size("_words").alias("_length"), F.inline(counted_terms("_words")))
    seen = seen.join(own.select("query_id", "term"), ["query_id", "term"], "left_anti").withColumn("bucket", bucket_of("term", index.buckets))
    met = index.read("terms").withColumnRenamed("chunks", "_holding").join(write_through(seen, "feedback"), ["bucket", "term"])
    value = F.col("n") * inverse_frequency(index.chunks, F.col("_holding")) / F.col("_length")
    ranked = met.groupBy("query_id", "term").agg(_micro(F.sum(value)).alias("_value"))
    best = Window.partitionBy("query_id").orderBy(F.col("_value").desc(), "term")
    added = ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= terms)
    return own.unionByName(added.select("query_id", "term", F.lit(weight).alias("weight")))


def search_feedback(queries: DataFrame, index: LexicalIndex, texts: Callable[[Hits], DataFrame], k: int = TOP_K, **kw) -> Hits:
    """BM25 with the rewritten queries."""
    return search_terms(feedback_terms(queries, index, texts, **kw), index, k)
