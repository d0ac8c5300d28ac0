"""Which texts contain which needles, as equi-joins on grams.

A needle of at least ``MANY_WORDS`` words is looked up by the words in its inside, which stand whole in any text
that contains it. A shorter one is looked up by its rarest character gram: of three characters, or of its own length if it
has fewer. Candidates are verified by ``contains``, so the result is exact for any number of needles.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import write_through

INSIDE_WORDS = 4
MANY_WORDS = INSIDE_WORDS + 2
GRAM = 3


def _words(text: str | Column) -> Column:
    return F.split(text, "[ \\t\\n\\x0b\\f\\r]+")


def _run_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(INSIDE_WORDS)])


def _runs(words: Column) -> Column:
    """Hashes of all runs of ``INSIDE_WORDS`` words, each once."""
    def hashes(held: Column) -> Column:
        last = F.size(held) - INSIDE_WORDS
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: _run_at(held, i))

    # the single-element transform names the words once; the text would be split again for every place
    return F.array_distinct(F.flatten(F.transform(F.array(words), hashes)))


def _grams(text: str, size: int) -> Column:
    """All character grams of a size, each once."""
    last = F.length(text) - size + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(size))))


def containing(texts: DataFrame, key: str, needles: DataFrame) -> DataFrame:
    """``needles`` joined to the ``key`` of each of ``texts(key, text)`` that contains its ``needle``.

    Needles, their grams and the candidates are written, so their sizes are known: while they are few they are broadcast and no text is
    shuffled. Of the texts' grams only those that a needle has are kept, in the scan, before anything is counted or joined; a kind of needle that
    doesn't occur costs no scan.
    """
    rows = write_through(needles.where("needle is not null").withColumn("_words", _words("needle")), "needles")
    kind = F.when(F.size("_words") >= MANY_WORDS, F.lit(MANY_WORDS)).otherwise(F.least(F.length("needle"), F.lit(GRAM)))
    rows = rows.withColumn("_kind", kind)
    kinds = {r["_kind"] for r in rows.select("_kind").distinct().collect()}  # five at most
    found = []
    for size in sorted(kinds):
        own = rows.where(F.col("_kind") == size).drop("_kind", "_words")
        if size == 0:  # every text contains the empty string
            found.append(own.withColumn("_gram", F.lit("")).join(texts.select(key, F.lit("").alias("_gram")), "_gram").drop("_gram"))
        elif size == MANY_WORDS:
            inside = own.withColumn("_gram", _run_at(_words("needle"), F.lit(1)))
            runs = texts.select(key, F.explode(_runs(_words("text"))).alias("_gram"))
            found.append(write_through(inside, "inside").join(runs, "_gram").drop("_gram"))
        else:
            found.append(_by_rarest_gram(texts, key, own, size))
    if not found:
        return needles.withColumn(key, F.lit(None).cast(texts.schema[key].dataType)).limit(0)
    met = write_through(functools.reduce(DataFrame.unionByName, found), "candidates")
    return met.join(texts.select(key, F.col("text").alias("_text")), key).where(F.contains("_text", "needle")).drop("_text")


def _by_rarest_gram(texts: DataFrame, key: str, own: DataFrame, size: int) -> DataFrame:
    """Candidates of needles by the one of their grams that the fewest texts have."""
    of_needles = write_through(own.select("needle").distinct().select("needle", F.explode(_grams("needle", size)).alias("_gram")), "needle-grams")
    grams = texts.select(key, F.explode(_grams("text", size)).alias("_gram"))
    grams = write_through(grams.join(of_needles.select("_gram").distinct(), "_gram", "left_semi"), "grams")
    common = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = (
        of_needles.join(common, "_gram", "left").groupBy("needle")
        .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    )
    return own.join(rarest, "needle").join(grams, "_gram").drop("_gram")
