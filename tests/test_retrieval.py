from pyspark.sql import functions as F

from chunkloom.operators.chunking import chunk_corpus
from chunkloom.operators.embedding import dimension_check, hash_embed
from chunkloom.operators.retrieval import (
    answer_blocks, lexical_score, search, search_totals, similarity_band, text_of_hits, text_of_stored,
)

DOCS = {
    "/d/fox.txt": "the quick brown fox jumps over the lazy dog",
    "/d/fish.txt": "many fish swim in the deep blue sea",
    "/d/code.txt": "spark plans joins and shuffles data",
}


def run(spark, corpus, asked, **kw):
    docs = corpus(DOCS)
    vectors = hash_embed(chunk_corpus(docs, created_at="t")).select("id", "source", "chunk_index", "embedding")
    queries = spark.createDataFrame(asked, "query_id int, text string")
    return queries, search(queries, vectors, lambda h: text_of_hits(h, docs), **kw)


def test_best_hit_and_missing_score_without_rerank(spark, corpus):
    _, hits = run(spark, corpus, [(1, "brown fox"), (2, "deep sea fish")], k=1)
    got = {r.query_id: (r.filename, r.rerank_score) for r in hits.collect()}
    assert got == {1: ("fox.txt", None), 2: ("fish.txt", None)}


def test_rerank_orders_by_score(spark, corpus):
    _, hits = run(spark, corpus, [(1, "brown fox dog")], k=2, fetch_k=3, score=lexical_score)
    rows = hits.orderBy("rank").collect()
    assert rows[0].filename == "fox.txt" and rows[0].rerank_score >= rows[1].rerank_score
    assert len(rows) == 2


def test_a_single_candidate_is_not_scored(spark, corpus):
    _, hits = run(spark, corpus, [(1, "brown fox dog")], k=1, fetch_k=1, score=lexical_score)
    assert hits.first().rerank_score is None


def test_stored_texts_give_the_same_hits(spark, corpus):
    docs = corpus(DOCS)
    stored = hash_embed(chunk_corpus(docs, created_at="t"))
    queries = spark.createDataFrame([(1, "fish"), (2, "spark joins")], "query_id int, text string")
    a = search(queries, stored, lambda h: text_of_stored(h, stored), k=2)
    b = search(queries, stored, lambda h: text_of_hits(h, docs), k=2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_totals_include_queries_without_hits(spark, corpus):
    queries, hits = run(spark, corpus, [(1, "fox"), (2, "fish")], k=2)
    totals = search_totals(queries, hits.filter("query_id = 1"))
    assert {r.query_id: r.total for r in totals.collect()} == {1: 2, 2: 0}


def test_bands_and_blocks(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.txt", "first", 0.83456), (1, 2, "b.txt", "second", 0.6), (1, 3, "c.txt", "third", 0.05)],
        "query_id int, rank int, filename string, text string, similarity double")
    assert [r[0] for r in hits.select(similarity_band(F.col("similarity"))).collect()] == ["success", "warning", "info"]
    assert answer_blocks(hits).first().answer == (
        "找到 3 条相关文档\n\n\n[1] 来源: a.txt | 相似度: 83.46%\nfirst\n\n[2] 来源: b.txt | 相似度: 60.00%\nsecond"
        "\n\n[3] 来源: c.txt | 相似度: 5.00%\nthird")


def test_reranked_block_lists_the_scores(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b.txt", "second", 0.5, 0.125), (1, 1, "a.txt", "first", 1.0, 0.9)],
        "query_id int, rank int, filename string, text string, similarity double, rerank_score double")
    assert answer_blocks(hits).first().answer == (
        "找到 2 条相关文档（已重排）| 分数: 0.90, 0.13\n\n\n[1] 来源: a.txt | 相似度: 100.00%\nfirst"
        "\n\n[2] 来源: b.txt | 相似度: 50.00%\nsecond")


def test_mixed_dimensions_are_reported(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    row = dimension_check(df).first()
    assert (row.min_dim, row.max_dim, row.single_dim) == (1, 2, False)


def test_few_queries_scan_the_corpus_without_shuffling_it(spark, sf_dir):
    from chunkloom.plans import inputs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("path"), "text")
    vectors = hash_embed(chunk_corpus(docs, created_at="t")).select("id", "source", "chunk_index", "embedding")
    hits = search(inputs.questions(spark, sf_dir), vectors, lambda h: text_of_hits(h, docs))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text" not in line
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_passages_are_found(spark, corpus):
    from chunkloom.plans import evaluate

    docs = corpus(DOCS)
    asked = spark.createDataFrame(
        [(1, "brown fox"), (2, "the"), (3, "nowhere"), (4, "blue sea"), (5, "joins")], "query_id int, text string")
    want = {(1, "/d/fox.txt"), (2, "/d/fox.txt"), (2, "/d/fish.txt"), (4, "/d/fish.txt"), (5, "/d/code.txt")}
    assert set(map(tuple, evaluate.passage_sources(docs, asked).collect())) == want
