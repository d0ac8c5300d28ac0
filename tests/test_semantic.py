import numpy as np

from chunkloom.functions.packing import pack_topics, topic_breaks
from chunkloom.model import SEMANTIC, Template
from chunkloom.operators.chunking import chunk_corpus


def cut(spark, corpus, text, template=SEMANTIC):
    return [r.text for r in chunk_corpus(corpus({"/d/a": text}), template, created_at="t").orderBy("chunk_index").collect()]


def test_parts_where_the_words_change(spark, corpus):
    cats = "The cat sat on the mat. The cat ate on the mat. The cat slept on the mat. The cat sang on the mat."
    stocks = "Markets fell because bond yields rose. Markets fell because bond prices dropped. Markets rose because bond prices rose."
    assert cut(spark, corpus, f"{cats} {stocks}") == [cats, stocks]


def test_size_and_single_sentences(spark, corpus):
    # of at most five neighbours none lies below the 20th percentile
    assert len(cut(spark, corpus, "Cats purr. Stocks fell. Rain came.")) == 1
    assert cut(spark, corpus, "One sentence only") == ["One sentence only"]
    assert cut(spark, corpus, "Same words here. " * 6, Template("s", 40, 0, "semantic")) == ["Same words here. Same words here."] * 3
    long = "x" * 100
    assert cut(spark, corpus, f"A b. {long}. C d.", Template("s", 40, 0, "semantic")) == ["A b.", "x" * 40, "x" * 40, "x" * 20 + ".", "C d."]
    assert cut(spark, corpus, "... !!! ?") != []


def test_breaks_lie_below_the_percentile():
    # three equal neighbours and one without a common bucket
    assert topic_breaks([1, 1, 1, 1, 1], np.array([3, 3, 3, 9, 9]), 64, 30).tolist() == [False, False, True, False]
    assert topic_breaks([1, 1], np.array([3, 9]), 64, 20).tolist() == [False]
    assert topic_breaks([], np.array([], int), 64, 20).tolist() == []
    assert topic_breaks([0, 0, 1], np.array([5]), 64, 20).tolist() == [False, False]


def test_packing_by_hand():
    assert pack_topics([3, 3, 3], [False, True], 100) == [(0, 2), (2, 1)]
    assert pack_topics([3, 3, 3], [False, False], 7) == [(0, 2), (2, 1)]
    assert pack_topics([], [], 7) == []
