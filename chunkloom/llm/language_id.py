"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of
its letters, each permuted (rotated) by its place. A text's vector bundles (sums) those of its n-grams; a language's
prototype bundles the unit vectors of labelled texts. A text gets the language of the prototype with the
largest cosine.

Defined results: a null text or one without a letter is ``und`` with score 0. The score is the cosine, negative
ones as 0. Equal cosines go to the first language by name. Without any labelled text all is ``und``. All of a text
counts, however long. Letters are those of Unicode, lower-cased and composed; any run of other characters is one
gap. Other columns are passed on; their names don't matter.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, grouped_by_bytes, mix64, utf8

DIMENSIONS = 2048
GRAM = 3
#: Labelled texts that the prototypes are fitted on, in expectation: a hash of the id selects them evenly.
FIT_ROWS = 20_000
UND = "und"
GAP = 32
#: Vectors of n-grams that a worker keeps; beyond it starts anew.
KEEP_GRAMS = 20_000
_UNIT = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_vector(code: int) -> np.ndarray:
    words = mix64((np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(code * 0xD1342543DE82EF95 % (1 << 64)))
    return (np.unpackbits(mix64(words).view(np.uint8)).astype(np.int8) << 1) - 1


class _Grams:
    """Vectors of n-grams, made when first met."""

    def __init__(self) -> None:
        self.letter = functools.lru_cache(4096)(_letter_vector)
        self.clear()

    def clear(self) -> None:
        self.codes = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((0, DIMENSIONS), np.int8)

    def add(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if not len(new):
            return
        if len(self.codes) + len(new) > KEEP_GRAMS and len(self.codes):
            self.clear()
            new = codes
        made = np.ones((len(new), DIMENSIONS), np.int8)
        for place in range(GRAM):
            letters, which = np.unique((new >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
            made *= np.stack([np.roll(self.letter(int(c)), GRAM - 1 - place) for c in letters])[which]
        self.vectors = np.concatenate([self.vectors, made])
        codes = np.concatenate([self.codes, new])
        rows = np.concatenate([self.rows, np.arange(len(self.vectors) - len(new), len(self.vectors))])
        order = np.argsort(codes)
        self.codes, self.rows = codes[order], rows[order]

    def get(self, codes: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.codes, codes)]


_grams = functools.cache(_Grams)


def _gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of each n-gram in each text; a text without a letter has none."""
    pieces = []
    for i, t in enumerate(texts):
        t = unicodedata.normalize("NFC", t.lower())
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        is_letter = _letters()[c]
        if not is_letter.any():
            continue
        c = np.where(is_letter, c, GAP)
        c = np.concatenate([[GAP], c, [GAP]])
        c = c[np.concatenate([[True], (c[1:] != GAP) | (c[:-1] != GAP)])]
        code = c[: len(c) - GRAM + 1].copy()
        for k in range(1, GRAM):
            code = (code << 21) | c[k : len(c) - GRAM + 1 + k]
        g, n = np.unique(code, return_counts=True)
        pieces.append((np.full(len(g), i), g, n))
    if not pieces:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def text_vectors(texts: list[str]) -> np.ndarray:
    """A unit vector for each text (zeros for one without a letter)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    which, grams, counts = _gram_counts(texts)
    if not len(which):
        return out
    known = _grams()
    known.add(np.unique(grams))
    rows = known.get(grams)
    bounds = np.flatnonzero(np.diff(which, prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(which)], strict=True):
        bundle = np.zeros(DIMENSIONS, np.float32)
        for k in range(a, b, 1024):
            e = min(b, k + 1024)
            bundle += counts[k:e].astype(np.float32) @ known.vectors[rows[k:e]].astype(np.float32)
        out[which[a]] = bundle
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return (out / np.maximum(norm, 1e-30)[:, None]).astype(np.float32)


def _strings(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in utf8(column)]


def _partial_prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by language, in whole numbers so that the order of summing doesn't matter."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), utf8(batch["text"])
        for part in grouped_by_bytes(texts, 1 << 20):
            vectors = np.rint(text_vectors([t.decode("utf-8", "replace") for t in texts[part]]) * _UNIT).astype(np.int64)
            for lang, v in zip(langs[part], vectors, strict=True):
                sums[lang] = sums[lang] + v if lang in sums else v
    for lang, v in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMENSIONS, "at": np.arange(DIMENSIONS, dtype=np.int32), "v": v})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Unit prototypes of all languages, from about ``fit_rows`` labelled texts."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = labelled.count()
    scale = 1 << 30
    if n > fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(scale)) < int(scale * fit_rows / n))
    sums = (
        labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_partial_prototypes, "lang string, at int, v long")
        .groupBy("lang", "at").agg(F.sum("v").alias("v"))
    )
    prototypes: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x DIMENSIONS numbers
        prototypes.setdefault(r.lang, np.zeros(DIMENSIONS))[r.at] = r.v
    out = {}
    for lang in sorted(prototypes):
        norm = np.linalg.norm(prototypes[lang])
        if norm > 0:
            out[lang] = (prototypes[lang] / norm).astype(np.float32)
    return out


def predict(text: F.Column, prototypes: dict[str, np.ndarray], once: bool = False) -> F.Column:
    """struct(lang string, score double) of each text. ``once``: a filter on it isn't pushed below, which would compute it for the filter and again for the result."""
    langs = list(prototypes)
    matrix = np.stack([prototypes[x] for x in langs], axis=1) if langs else np.zeros((DIMENSIONS, 0), np.float32)

    @F.pandas_udf("lang string, score double")
    def guess(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            texts = texts.fillna("").tolist()
            lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
            for part in grouped_by_bytes(texts, 1 << 20):
                vectors = text_vectors(texts[part])
                if matrix.shape[1]:
                    cosine = np.round(vectors.astype(np.float64) @ matrix, 9)
                    best = cosine.argmax(axis=1)
                    some = vectors.any(axis=1)
                    lang[part] = np.where(some, np.array(langs, object)[best], UND)
                    score[part] = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            yield pd.DataFrame({"lang": lang, "score": score})

    return (guess.asNondeterministic() if once else guess)(text)


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose text has a letter, so that one of the languages is the nearest; where ``lang_col`` is a null string it becomes that language. Noise and
    other languages aren't rejected: a small cosine doesn't tell them from short texts."""
    bounded_batches(docs.sparkSession)
    guess = docs.withColumn("__guess", predict(F.col(text_col), prototypes, once=True)).where(F.col("__guess.lang") != UND)
    if lang_col in docs.columns and isinstance(docs.schema[lang_col].dataType, T.StringType):
        guess = guess.withColumn(lang_col, F.coalesce(lang_col, F.col("__guess.lang")))
    return guess.drop("__guess")


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = fit(docs.where(~held_out("doc_id")))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(F.col("text"), prototypes).alias("g")).select(
        "doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score")
    )
