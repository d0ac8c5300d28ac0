"""The hashing index and the probed join against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import ivf, lsh
from chunkloom.operators.knn import nearest
from chunkloom.plans.queries import REGISTRY

DIM = 32


@pytest.fixture(scope="module")
def clustered(spark):
    """Groups of near vectors, a third of all rows in one of them, and copies; queries near some rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, DIM))
    group = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 60, 3000))
    rows = centres[group] + 0.35 * rng.normal(size=(3000, DIM))
    rows[2900:] = rows[2899]
    asked = rows[::150] + 0.1 * rng.normal(size=(20, DIM))
    make = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v], f"s{i % 5}") for i, v in enumerate(m)], f"{name} int, embedding array<double>, source string")
    return make(rows, "id").repartition(6), make(asked, "query_id").drop("source")


def found(hits):
    out = {}
    for r in hits.rows.collect():
        out.setdefault(r.query_id, {})[r.id] = r.distance
    return out


def test_hash_index_finds_what_is_near(spark, clustered):
    rows, queries = clustered
    exact = found(nearest(queries, rows, 10, row_id="id"))
    index = lsh.build_hash_index(rows, keep=("source",))
    got = found(lsh.search_hashes(index, queries, 10, keep=("source",)))
    recall = np.mean([len(exact[q].keys() & got[q].keys()) / 10 for q in exact])
    assert recall >= 0.9
    few = found(lsh.search_hashes(index, queries, 10, probes=0))
    assert sum(map(len, few.values())) <= sum(map(len, got.values()))
    for q, hits in got.items():  # distances are exact
        assert all(exact[q][i] == pytest.approx(d, abs=2e-6) for i, d in hits.items() if i in exact[q])
    candidates = index.read(spark, "postings").groupBy("table", "bucket").count().agg(F.max("count")).first()[0]
    assert candidates < 3000


def test_registered_hash_search_has_recall(spark, sf_dir):
    ours = {(r.query_id, r.vec_id) for r in REGISTRY["knn_lsh"](spark, sf_dir).collect()}
    exact = {(r.query_id, r.vec_id) for r in REGISTRY["knn_cosine"](spark, sf_dir).collect()}
    assert len(ours & exact) >= 0.9 * len(exact)


def test_probe_codes():
    projected = np.array([[[5, -1, 0, -7]]])
    assert lsh.probe_codes(projected, 2).tolist() == [[[0b0101, 0b0001, 0b0111]]]


def test_rows_without_vectors_and_empty_tables(spark):
    schema = "id int, embedding array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], schema)
    queries = spark.createDataFrame([(7, [1.0, 0.1])], "query_id int, embedding array<double>")
    got = found(lsh.search_hashes(lsh.build_hash_index(rows, bits=2), queries, 5))
    assert set(got[7]) <= {1, 3} and 1 in got[7]
    assert found(lsh.search_hashes(lsh.build_hash_index(spark.createDataFrame([], schema)), queries, 5)) == {}


@pytest.mark.parametrize("group_rows, group_queries", [(200_000, 65_536), (50, 3)])
def test_probed_join_equals_the_broadcast_form(spark, clustered, group_rows, group_queries):
    rows, queries = clustered
    index = ivf.build_index(rows, 12)
    want = found(ivf.probe(index, queries, 7, nprobe=3, keep=("source",)))
    assert found(ivf.probe_join(index, queries, 7, nprobe=3, keep=("source",), group_rows=group_rows, group_queries=group_queries)) == want
    everything = found(ivf.probe_join(index, queries, 7, nprobe=99, group_rows=group_rows))
    assert everything == found(nearest(queries, rows, 7, row_id="id"))
