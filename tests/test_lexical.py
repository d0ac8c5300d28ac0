import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import lexical
from chunkloom.plans.queries import REGISTRY

SCHEMA = "id string, text string, source string, chunk_index int"


def some_chunks(n=120):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"c{i:03}", " ".join(["the", *rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 30))]), f"s{i % 7}", i) for i in range(n)]
    return [*rows, ("c900", None, "s", 0), ("c901", " ... ", "s", 0), ("c902", rows[3][1], "s", 0)]


def plain(chunks, asked, k):
    bags = {c[0]: Counter(re.findall(r"[a-z0-9]+", (c[1] or "").lower())) for c in chunks}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    out = []
    for q, terms in asked.items():
        scores = {}
        for t, w in terms.items():
            df = sum(t in b for b in bags.values())
            for i, b in bags.items():
                if t in b:
                    idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + w * idf * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scores(spark, small, monkeypatch):
    if small:  # many buckets and files, a term in all of them
        monkeypatch.setattr(lexical, "BUCKET_ROWS", 100)
        monkeypatch.setattr(lexical, "FILE_ROWS", 40)
    chunks = some_chunks()
    index = lexical.build_lexical_index(spark.createDataFrame(chunks, SCHEMA))
    assert index.chunks == len(chunks) and (index.buckets > 5) == small
    queries = spark.createDataFrame([(1, "The w1 W7 w7"), (2, "w40"), (3, "unknown"), (4, ""), (5, None)], "query_id int, text string")
    hits = lexical.search_bm25(queries, index, 4).rows
    want = plain(chunks, {1: {"the": 1, "w1": 1, "w7": 1}, 2: {"w40": 1}}, 4)
    got = hits.select("query_id", "rank", "id", "score").collect()
    assert sorted((r[0], r[1], r[2], pytest.approx(r[3], abs=2e-6)) for r in got) == want
    weighted = spark.createDataFrame([(1, "w1", 0.5), (1, "w2", 2.0)], "query_id int, term string, weight double")
    got = lexical.search_terms(weighted, index, 3).rows.select("query_id", "rank", "id", "score").collect()
    assert [r[2] for r in sorted(got)] == [r[2] for r in plain(chunks, {1: {"w1": 0.5, "w2": 2.0}}, 3)]


def test_an_empty_index_gives_no_hits(spark):
    index = lexical.build_lexical_index(spark.createDataFrame([], SCHEMA))
    queries = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert lexical.search_bm25(queries, index).rows.count() == 0


def test_counted_terms(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "w array<string>").select(lexical.counted_terms("w").alias("t"))
    assert [[tuple(x) for x in r.t] for r in df.collect()] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_postings_are_built_without_a_text_in_an_exchange(spark, sf_dir):
    from chunkloom.plans import inputs

    chunks = inputs.chunks(spark, sf_dir)
    words = chunks.select("id", lexical.tokens("text").alias("w")).select("id", F.inline(lexical.counted_terms("w")))
    assert "Exchange" not in words._jdf.queryExecution().optimizedPlan().toString()
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" not in plan and "rangepartitioning(text" not in plan


def test_fusion_of_lists_that_share_some_hits(spark):
    schema = "query_id int, rank int, id string, source string, chunk_index int"
    a = spark.createDataFrame([(1, 1, "x", "s", 0), (1, 2, "y", "s", 1), (2, 1, "q", "s", 9)], schema)
    b = spark.createDataFrame([(1, 1, "y", "s", 1), (1, 2, "z", "s", 2)], schema)
    rows = lexical.fuse([a, b], 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.id, r.ranks, r.chunk_index) for r in rows] == [(1, 1, "y", [2, 1], 1), (1, 2, "x", [1, None], 0), (2, 1, "q", [1, None], 9)]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    with pytest.raises(ValueError):
        lexical.fuse([a, b], weights=(1.0,))


def test_feedback_adds_terms_of_the_first_hits(spark):
    chunks = [("a", "cat feline purr", "s", 0), ("b", "feline purr whisker", "s", 1), ("c", "dog bark", "s", 2), ("d", "bark tree", "s", 3)]
    index = lexical.build_lexical_index(spark.createDataFrame(chunks, SCHEMA))
    queries = spark.createDataFrame([(1, "cat")], "query_id int, text string")
    texts = lambda h: h.rows.join(spark.createDataFrame(chunks, SCHEMA).select("id", "text"), "id")
    assert [r.id for r in lexical.search_bm25(queries, index).rows.collect()] == ["a"]
    terms = lexical.feedback_terms(queries, index, texts, depth=1, terms=2)
    assert sorted((r.term, r.weight) for r in terms.collect()) == [("cat", 1.0), ("feline", 0.3), ("purr", 0.3)]
    assert [r.id for r in lexical.search_feedback(queries, index, texts).rows.orderBy("rank").collect()] == ["a", "b"]


def test_fused_search_is_not_worse_than_the_better_list(spark, sf_dir):
    scores = {r.method: r for r in REGISTRY["retrieval_eval_hybrid"](spark, sf_dir).collect()}
    best = max(scores["vector"].mrr, scores["bm25"].mrr)
    assert scores["hybrid_words"].mrr >= best and scores["hybrid"].mrr >= scores["vector"].mrr


def test_a_query_sends_k_rows_of_each_segment_not_every_chunk_that_holds_a_word(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    rows = [(f"c{i:04}", f"the w{i % 7}", "s", i) for i in range(600)]
    index = lexical.build_lexical_index(spark.createDataFrame(rows, SCHEMA).coalesce(2))
    queries = spark.createDataFrame([(1, "the"), (2, "the w3")], "query_id int, text string")
    written = {}
    through = lexical.write_through
    monkeypatch.setattr(lexical, "write_through", lambda df, label: written.setdefault(label, through(df, label)))
    hits = lexical.search_bm25(queries, index, 3).rows.orderBy("query_id", "rank").collect()
    assert [r.id for r in hits] == ["c0000", "c0001", "c0002", "c0003", "c0010", "c0017"]
    assert written["segment-hits"].count() <= 2 * 2 * 3


def test_chunks_that_share_an_id_are_scored_as_one(spark):
    rows = [("a", "cat dog", "s", 0), ("a", "cat tree", "s", 1), ("b", "cat cat dog", "s", 2), ("c", "tree", "s", 3), (None, "cat", "s", 4)]
    index = lexical.build_lexical_index(spark.createDataFrame(rows, SCHEMA))
    hits = lexical.search_bm25(spark.createDataFrame([(1, "cat")], "query_id int, text string"), index, 2).rows.collect()
    assert sorted((r.rank, r.id, r.chunk_index) for r in hits) == [(1, "a", 0), (1, "a", 1), (2, "b", 2)]
    assert not index.unique
