import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import sketches as sk


def test_quantiles_of_merged_sketches_keep_the_rank_error(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", i % 40, rng.expovariate(1) if i % 5 else 7.0) for i in range(60_000)]
    df = spark.createDataFrame(rows, "key string, part int, v double").repartition(8)
    small = sk.sketch(df, "v", ["key", "part"])
    assert small.count() == 80
    answers = sk.quantiles(sk.merge(small, ["key"]), [0.01, 0.5, 0.999])
    for r in answers.collect():
        own = [v for k, _, v in rows if k == r.key]
        below, to = sum(v < r.quantile for v in own), sum(v <= r.quantile for v in own)
        assert r.n == len(own) and below / r.n <= r.p + sk.RANK_ERROR and to / r.n >= r.p - sk.RANK_ERROR
    assert sk.rank_check(df, "v", answers, ["key"]).filter("inside").count() == 6
    wrong = answers.withColumn("quantile", F.col("quantile") + 0.5)
    assert sk.rank_check(df, "v", wrong, ["key"]).filter("not inside").count() >= 2


def test_few_values_are_exact_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "key string, v double")
    rows = {(r.key, r.p): (r.n, r.quantile) for r in sk.quantiles(sk.sketch(df, "v", ["key"]), [0.0, 0.5, 1.0]).collect()}
    assert rows == {("a", 0.0): (3, 1.0), ("a", 0.5): (3, 2.0), ("a", 1.0): (3, 3.0), ("b", 0.0): (0, None), ("b", 0.5): (0, None), ("b", 1.0): (0, None)}


@pytest.mark.parametrize("schema", ["key string, v double"])
def test_empty(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert sk.quantiles(sk.merge(sk.sketch(empty, "v", ["key"]), ["key"]), [0.5]).count() == 0
