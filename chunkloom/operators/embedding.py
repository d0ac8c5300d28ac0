"""Turning text into vectors.

``embed`` takes any batch function; ``hash_embed`` is the built-in default, a hashed bag of
words. Texts are cut to words in the JVM; each distinct word of a batch is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import tokens
from chunkloom.functions.vectors import unit_rows
from chunkloom.model import EMBED_BATCH

HASH_DIM = 64


def hash_buckets(text: Column | str, dim: int = HASH_DIM) -> Column:
    """The bucket of every token: the first 8 hex digits of its md5, modulo ``dim``."""
    def bucket(t: Column) -> Column:
        return (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int")

    return F.transform(tokens(text), bucket)


def bucket_vectors(lengths: np.ndarray, buckets: np.ndarray, dim: int) -> np.ndarray:
    """Counts per bucket of each row, scaled to unit length."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(rows * dim + buckets, minlength=len(lengths) * dim)
    return unit_rows(counts.reshape(len(lengths), dim).astype(np.float64))


def float_lists(m: np.ndarray) -> pa.ListArray:
    flat = pa.array(np.ascontiguousarray(m, dtype=np.float32).ravel())
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _word_counter(dim: int) -> Callable:
    @F.arrow_udf("array<float>")
    def counted(words: pa.Array) -> pa.Array:
        lengths = words.value_lengths().fill_null(0).to_numpy()
        coded = words.flatten().dictionary_encode()
        # the same as hash_buckets
        digests = (hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in coded.dictionary.to_pylist())
        buckets = np.fromiter((int.from_bytes(h[:4], "big") % dim for h in digests), np.int64, len(coded.dictionary))
        return float_lists(bucket_vectors(lengths, buckets[coded.indices.to_numpy()], dim))

    return counted


def hash_embed(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = HASH_DIM) -> DataFrame:
    return df.withColumn(out, _word_counter(dim)(tokens(text)))


def embed(
    df: DataFrame,
    model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    text: str = "text",
    out: str = "embedding",
    batch: int = EMBED_BATCH,
    dim: int = HASH_DIM,
) -> DataFrame:
    """Add vectors. ``model()`` runs once per task and returns the function that embeds a
    list of at most ``batch`` texts; without one the hashed bag of words is used."""
    if model is None:
        return hash_embed(df, text, out, dim)

    @F.arrow_udf("array<float>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = model()
        for texts in batches:
            values = texts.to_pylist()
            parts = [
                np.asarray(encode(values[i:i + batch]), dtype=np.float32)
                for i in range(0, len(values), batch)
            ]
            yield float_lists(np.concatenate(parts)) if parts else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(out, encoded(F.col(text)))


def dimension_check(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: smallest and largest dimension and whether the table has a single one."""
    size = F.size(vec)
    return vectors.agg(
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        F.count("*").alias("vectors"),
        F.coalesce(F.min(size) == F.max(size), F.lit(True)).alias("single_dim"),
    )
