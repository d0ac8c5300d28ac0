"""Files of a folder tree: listing, decoding, extension checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.text import extension, is_supported
from chunkloom.model import TEXT_EXTENSIONS
from chunkloom.sources.tables import load_corpus

# Encodings tried in order; the last one never fails.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


def _outer_roots(dirs: tuple[str, ...]) -> list[str]:
    """The folders without repeats and without those below another one, so that listing
    them gives each file once."""
    roots = sorted({d.rstrip("/") for d in dirs})
    return [d for d in roots if not any(d.startswith(f"{other}/") for other in roots)]


def _open(spark: SparkSession, dirs: tuple[str, ...]) -> DataFrame:
    """Folders that aren't there are skipped."""
    roots = [d for d in _outer_roots(dirs) if _exists(spark, d)]
    if not roots:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def list_paths(spark: SparkSession, *dirs: str) -> DataFrame:
    """Supported files below ``dirs``: ``path, size, modified``; each file once. The
    contents are not read."""
    files = _open(spark, dirs)
    return files.filter(is_supported("path")).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())])


@F.arrow_udf(DECODED)
def _decode_other(content: pa.Array) -> pa.Array:
    """Bytes that are not UTF-8, by the first other encoding that accepts them."""
    texts, names = [], []
    for raw in content.to_pylist():
        text = name = None
        for name in ENCODINGS[1:] if raw is not None else ():
            try:
                text = raw.decode(name)
                break
            except UnicodeDecodeError:
                continue
        texts.append(text)
        names.append(name)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "charset"])


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` and ``charset``. UTF-8 is decoded in the JVM; only other bytes reach
    Python. Line ends become ``\\n``, as a text file is read."""
    as_utf8 = F.col(content).cast("string")
    valid = F.is_valid_utf8(as_utf8)
    other = _decode_other(F.when(~valid, F.col(content)))
    return (
        files.withColumn("_other", other)
        .withColumn("text", F.when(valid, as_utf8).otherwise(F.col("_other.text")))
        .withColumn("charset", F.when(valid, F.lit(ENCODINGS[0])).otherwise(F.col("_other.charset")))
        .withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
        .drop("_other")
    )


def read_files(spark: SparkSession, *dirs: str) -> DataFrame:
    """``path, text, charset`` of all text files below ``dirs``, each file once."""
    wanted = _open(spark, dirs).filter(extension("path").isin(*TEXT_EXTENSIONS)).select("path", "content")
    return decode(wanted).select("path", "text", "charset")


def read_corpus(spark: SparkSession, *dirs: str) -> DataFrame:
    """All non-blank text files below ``dirs`` as ``(path, text)`` with the name prefix."""
    return load_corpus(read_files(spark, *dirs))


def charset_report(files: DataFrame) -> DataFrame:
    return files.groupBy("charset").agg(F.count("*").alias("files"))


def dedup_uploads(files: DataFrame, name: str = "name", size: str = "size", first_by: str = "path") -> DataFrame:
    """The first file of each name and size. Rows are reduced before the shuffle, so many
    copies of one file do not meet in one task."""
    rest = [c for c in files.columns if c not in (name, size)]
    return files.groupBy(name, size).agg(F.min_by(F.struct(*rest), first_by).alias("_row")).select(
        name, size, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )
