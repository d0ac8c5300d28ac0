"""WARC archives: written by Spark's text writer, read back in splits by boundary-chain verification.

Writing: a page is one record. Of pages with equal payloads (of at least ``LEAST_BYTES`` bytes) the one with the smallest id is
a response, the others are revisits that refer to it. Records are put together by built-in expressions; html isn't
shuffled unless the list of repeated pages is too long to broadcast (its size is known, as it is written first).

Reading: Spark reads the files in splits at the magic line that begins a record. A payload may hold that line too, so what
lies between two magic lines is only a candidate. Tasks number the candidates of a split and emit each one's offset and
that of the successor which its Content-Length promises. From the start of each file pointers are doubled
(a successor's successor, and so on) until nothing new is reached; what isn't reached is no record. A record whose payload holds
magic lines is put together again from its pieces.

Defined results: a null payload is empty; a null url is written as ``about:blank``, control characters in it as %XX; a null page
id is written as ``<urn:page:null>`` and read back as null: it is a revisit if a page with an id has its payload, else a response, and is never referred to; rows that repeat an id are records each, and the first response of that id is referred to. Records
that end beyond their file, or whose header can't be read, end that file's chain.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chunkloom.llm.common import bounded_batches, utf8, written
from chunkloom.session import scratch_path

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 0
# The alphabet of base32, and the profile of a revisit of an equal payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: F.Column) -> F.Column:
    """SHA-1 in base32: five hexadecimal digits are four characters."""
    digits = F.sha1(payload)
    out = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each page to files under ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
        F.coalesce(F.regexp_replace(F.col(url_col), "[\\x00-\\x20\\x7f]", "%20"), F.lit("about:blank")).alias("url"),
    )
    digests = written(rows.select("page_id", "size", F.sha1(F.col("payload").cast("binary")).alias("sha1")), "payload-digests")
    firsts = digests.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeats = digests.join(written(firsts, "payloads"), "sha1").where("page_id is null or page_id > first").select("page_id", F.col("first").alias("refers_to"), F.col("sha1").alias("same")).distinct()
    repeats = written(repeats, "revisits")
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    rows = rows.join(repeats.withColumnsRenamed({"page_id": "r_id"}), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("same")), "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload").cast("binary")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END),
    )
    rows.select(F.concat(header, http, body).alias("value")).write.option("lineSep", END).text(path)


_HEADER = re.compile(rb"(?:^|\r\n)([A-Za-z-]+):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")

_FOUND = (
    T.StructType().add("file", T.StringType()).add("split", T.LongType()).add("local", T.LongType()).add("span", T.LongType()).add("length", T.LongType())
    .add("whole", T.BooleanType()).add("page_id", T.LongType()).add("payload_bytes", T.LongType()).add("payload_digest", T.StringType()).add("record_type", T.StringType()).add("refers_to", T.LongType())
)


def _record(data: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Bytes of the header with its end, Content-Length and fields of what follows a magic line."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v.strip() for k, v in _HEADER.findall(data[:end])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or b"warc-type" not in fields:
        return None
    return end + 4, int(length), fields


def _page(value: bytes) -> int | None:
    m = _PAGE.search(value)
    return int(m[1]) if m else None


def _content(fields: dict[bytes, bytes], block: bytes) -> dict[str, object]:
    """What a record says: its payload's size and digest are those of the bytes read, for a revisit those it states."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode("latin-1")
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        stated = {k.lower(): v.strip() for k, v in _HEADER.findall(head)}.get(b"content-length", b"0")
        size = int(stated) if stated.isdigit() else 0
        digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    return {
        "page_id": _page(fields.get(b"warc-record-id", b"")), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields.get(b"warc-refers-to", b"")) if kind == "revisit" else None,
    }


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece between magic lines, with its offset inside of its split and what it says if it is a record."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, at, where = to_arrow_schema(_FOUND), 0, None
    for batch in batches:
        out = []
        for file, split, data in zip(batch["file"].to_pylist(), batch["split"].to_pylist(), utf8(batch["data"]), strict=True):
            if where != (file, split):
                where, at = (file, split), 0
            row = {"file": file, "split": split, "local": at, "span": len(data) + len(MAGIC), "length": None, "whole": False}
            at += row["span"]
            found = _record(data)
            if found:
                head, length, fields = found
                row["length"] = len(MAGIC) + head + length + len(END)
                if head + length <= len(data):
                    row |= {"whole": True} | _content(fields, data[head : head + length])
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _reached(found: DataFrame) -> DataFrame:
    """(file, offset) of the records: what the chain from the file's start reaches, by pointer jumping."""
    reached = written(found.where("offset = 0").select("file", "offset"), "reached")
    jumps = written(found.where("length is not null").select("file", "offset", (F.col("offset") + F.col("length")).alias("next")), "jumps")
    n = 1
    while True:
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = written(reached.unionByName(step).distinct(), "reached")
        now = reached.count()
        if now == n:
            break
        n = now
        onward = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("beyond"))
        jumps = written(jumps.join(onward, ["file", "next"]).select("file", "offset", F.col("beyond").alias("next")), "jumps")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of the records under ``path``."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data")
    )
    found = written(lines.mapInArrow(_candidates, _FOUND), "candidates")
    # The text before a file's first magic line is empty: its piece is counted as a magic line too many.
    totals = found.groupBy("file", "split").agg(F.sum("span").alias("total"))
    ahead = F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = written(totals.select("file", "split", F.coalesce(ahead, F.lit(0)).alias("base")), "splits")
    found = found.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.col("local") - len(MAGIC)).where("offset >= 0")
    records = found.join(_reached(found), ["file", "offset"])
    records = written(records.where("length is not null"), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = records.where("whole").select(*columns)
    broken = records.where("not whole").select("file", F.col("offset").alias("from"), (F.col("offset") + F.col("length")).alias("to"))
    if not broken.isEmpty():
        out = out.unionByName(_rejoined(lines, base, broken).select(*columns))
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, where = 0, None
    for batch in batches:
        local, data = [], utf8(batch["data"])
        for key, d in zip(zip(batch["file"].to_pylist(), batch["split"].to_pylist(), strict=True), data, strict=True):
            if where != key:
                where, at = key, 0
            local.append(at)
            at += len(d) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch["file"], batch["split"], pa.array(local, pa.int64()), batch["data"]], names=["file", "split", "local", "data"])


def _rejoin(group: pa.Table) -> pa.Table:
    group = group.sort_by("offset")
    data = MAGIC.join(utf8(group["data"]))
    found = _record(data)
    rows = []
    if found and found[0] + found[1] <= len(data):
        rows.append(_content(found[2], data[found[0] : found[0] + found[1]]))
    return pa.Table.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))


def _rejoined(lines: DataFrame, base: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines: their pieces are gathered by record, a group for each."""
    pieces = lines.mapInArrow(_numbered, "file string, split long, local long, data binary").join(base, ["file", "split"])
    pieces = pieces.withColumn("offset", F.col("base") + F.col("local") - len(MAGIC))
    # Records of a file don't overlap, so a cell of fixed size meets few of them: the join is by equal cells.
    cell = 1 << 20
    ranges = broken.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    near = pieces.withColumn("cell", F.floor(F.col("offset") / cell)).join(ranges, ["file", "cell"])
    own = near.where((F.col("offset") >= F.col("from")) & (F.col("offset") < F.col("to")))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return own.select("file", "from", "offset", "data").groupBy("file", "from").applyInArrow(_rejoin, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path)


#: The payload is the html itself; the digest in base32 is built from five hexadecimal digits at a time.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
