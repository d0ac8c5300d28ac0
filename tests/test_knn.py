import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkloom.functions.vectors import distance, resize
from chunkloom.operators import ivf, knn
from chunkloom.operators.knn import nearest


@pytest.fixture(scope="module")
def tables(spark):
    """Vectors of which more than a third are copies of one, and 30 queries."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[150:] = v[3]
    v[7] = 0
    rows = [(f"r{i:03d}", v[i].tolist(), i % 4) for i in range(len(v))]
    asked = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(29)] + [(29, v[3].tolist())]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>, tag int").repartition(5).cache()
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>").cache()
    return vectors, queries


def plain(vectors, queries, k, space):
    pairs = queries.withColumnRenamed("embedding", "q").crossJoin(vectors)
    d = F.floor(distance(F.col("q"), F.col("embedding"), space) * 1e6 + 0.5) / 1e6
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = pairs.withColumn("distance", d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return sorted((r.query_id, r.rank, r.id, r.distance) for r in ranked.collect())


def rows(hits):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in hits.rows.collect())


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
def test_both_forms_equal_all_pairs(tables, space):
    vectors, queries = tables
    want = plain(vectors, queries, 6, space)
    sent = nearest(queries, vectors, 6, space)
    sharded = nearest(queries, vectors, 6, space, max_broadcast=7, shard_rows=90)
    assert sent.bounded and not sharded.bounded
    assert rows(sent) == want
    assert rows(sharded) == want


def test_fewer_rows_than_k_and_no_rows(tables):
    vectors, queries = tables
    assert len(rows(nearest(queries, vectors.limit(2), 5))) == 60
    assert rows(nearest(queries, vectors.filter("tag > 9"), 5)) == []
    assert rows(nearest(queries.limit(0), vectors, 5)) == []


def test_kept_columns_come_along(tables):
    vectors, queries = tables
    got = nearest(queries, vectors, 3, keep=("tag",)).rows
    assert got.join(vectors.select("id", F.col("tag").alias("t")), "id").filter("tag <> t").count() == 0


def test_bad_arguments(tables):
    vectors, queries = tables
    with pytest.raises(ValueError):
        nearest(queries, vectors, 3, "hamming")
    with pytest.raises(ValueError):
        nearest(queries, vectors, 0)


def test_all_cells_give_the_exact_result(spark, tables):
    vectors, queries = tables
    index = ivf.build_index(vectors, 6)
    exact = rows(nearest(queries, vectors, 6))
    assert rows(ivf.probe(index, queries, 6, nprobe=6)) == exact
    every = spark.createDataFrame([(q, c) for q in range(30) for c in range(6)], "query_id int, cell int")
    assert rows(nearest(queries, index.read(spark), 6, probes=every)) == exact


def test_a_hot_cell_is_written_in_several_files(spark, tables):
    vectors, _ = tables
    index = ivf.build_index(vectors, 4, rows_per_file=40)
    stored = index.read(spark).withColumn("file", F.input_file_name())
    per = stored.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    hot = per.orderBy(F.desc("n")).first()
    assert hot.n > 130 and hot.files > 1
    assert stored.count() == vectors.count()


def test_some_cells_in_the_sharded_form(spark, tables):
    vectors, queries = tables
    index = ivf.build_index(vectors, 6)
    probes = spark.createDataFrame([(q, c) for q in range(30) for c in ((q % 6), (q + 1) % 6)], "query_id int, cell int")
    stored = index.read(spark)
    sent = nearest(queries, stored, 4, probes=probes)
    sharded = nearest(queries, stored, 4, probes=probes, max_broadcast=7, shard_rows=90)
    assert rows(sent) == rows(sharded)
    old, knn.MAX_BROADCAST_PROBES = knn.MAX_BROADCAST_PROBES, 59
    try:
        many_pairs = nearest(queries, stored, 4, probes=probes)
    finally:
        knn.MAX_BROADCAST_PROBES = old
    assert not many_pairs.bounded and rows(many_pairs) == rows(sent)
    cells = {(r.id, r.cell) for r in stored.select("id", "cell").collect()}
    assert all((i, q % 6) in cells or (i, (q + 1) % 6) in cells for q, _, i, _ in rows(sent))


def test_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.withColumnRenamed("id", "query_id")
    exact = {r[:3:2] for r in rows(nearest(q, v, 5))}
    index = ivf.build_index(v, 8)
    found = {r[:3:2] for r in rows(ivf.probe(index, q, 5, nprobe=6))}
    assert len(exact & found) / len(exact) >= 0.9


def test_resize(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>").select(
        resize(F.col("v"), 2).alias("a"), resize(F.col("v"), 5).alias("b")).first()
    assert r.a == [1.0, 2.0] and r.b == [1.0, 2.0, 3.0, 0.0, 0.0]
