import random

from chunkloom.operators.containment import containing


def test_containing_equals_python(spark):
    rng = random.Random(2)
    words = ["a", "bb", "the", "fox", "jumps", "over", "lazy", "dog", "x\ny", "é"]
    texts = [(f"k{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    needles = ["", "a", "bb", "the fox", "jumps over lazy", "zzz", "o", "é a"]
    for _ in range(40):
        t = rng.choice(texts)[1]
        at = rng.randrange(len(t) + 1)
        needles.append(t[at : at + rng.randrange(1, 60)])
    rows = [(i, n) for i, n in enumerate(needles)]
    got = containing(
        spark.createDataFrame(texts, "key string, text string"), "key", spark.createDataFrame(rows, "q int, needle string")
    ).select("q", "key").collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, n in rows for k, t in texts if n in t)


def test_no_needles_and_null_needles(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", None)], "key string, text string")
    for rows in ([], [(1, None)]):
        found = containing(texts, "key", spark.createDataFrame(rows, "q int, needle string"))
        assert found.collect() == [] and set(found.columns) == {"q", "needle", "key"}
    assert [r.key for r in containing(texts, "key", spark.createDataFrame([(1, "")], "q int, needle string")).collect()] == ["a"]


def test_a_long_text_is_split_once(spark):
    """Work in proportion to the words: the split isn't inside of what runs for every place."""
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    texts = spark.createDataFrame([("a", text), ("b", "w1 w2")], "source string, text string")
    needles = spark.createDataFrame([(1, "w77 w78 w79 w80 w81 w82 w83"), (2, "w5 w6 w7 w9 w8 w10")], "query_id int, needle string")
    began = time.time()
    assert [(r.query_id, r.source) for r in containing(texts, "source", needles).collect()] == [(1, "a")]
    assert time.time() - began < 20
