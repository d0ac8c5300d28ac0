"""Packed token matrices: best-fit-decreasing packing with a segment tree over capacities.

Texts are encoded, texts longer than a row are cut into full rows and a rest (nothing is lost), and pieces are packed longest
first, each into the row that it fills most. The segment tree's leaves are the numbers of free places in a row, each with the
rows that have so many; an inner node knows whether any row is below it. The smallest leaf that is large enough is
found, emptied and filled in logarithmic time.

A task packs its texts in windows of bounded size as they come from the scan, so texts aren't shuffled and a lost task is repeated as
it was. Each row holds the ids as little-endian 16-bit or 32-bit integers (filled up with ``pad_id``), the cumulative lengths of its segments and the
places where positions start from 0 again, with each segment's document and the number of its first token in it.

Defined results: null and empty texts have no tokens and stand in no row, unless ``end_id`` ends every text; rows that
repeat an id are packed each; a null id is carried on. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.bpe import codec
from chunkloom.llm.common import bounded_batches, grouped_by_bytes, utf8

#: Tokens of a row, and tokens that a task packs at once.
ROW_TOKENS = 2048
WINDOW_TOKENS = 2 << 20
#: Rows of a matrix in the output.
MATRIX_ROWS = 32

SCHEMA = (
    T.StructType().add("matrix", T.StringType()).add("n_rows", T.IntegerType()).add("n_tokens", T.LongType()).add("ids", T.BinaryType())
    .add("cu_seqlens", T.ArrayType(T.ArrayType(T.IntegerType()))).add("position_resets", T.ArrayType(T.ArrayType(T.IntegerType())))
    .add("doc_ids", T.ArrayType(T.ArrayType(T.LongType()))).add("first_tokens", T.ArrayType(T.ArrayType(T.LongType())))
)


class Capacities:
    """Rows by their free places, found by a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = self.leaves + free
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the fewest free places of at least ``size``, and how many; the row is taken out."""
        node = self.leaves + size
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        free = node - self.leaves
        row = self.rows[free].pop()
        if not self.rows[free]:
            while node:
                self.some[node] = 1 if node < self.leaves and (self.some[2 * node] or self.some[2 * node + 1]) else 0
                if self.some[node]:
                    break
                node >>= 1
        return row, free


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers, longest pieces first."""
    tree, rows = Capacities(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, free = found
        rows[row].append(i)
        if free > size:
            tree.add(free - size, row)
    return rows


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS, pad_id: int = 0, end_id: int | None = None) -> DataFrame:
    """Matrices of packed token ids, see SCHEMA."""
    bounded_batches(docs.sparkSession)

    def pack(window: list[tuple[int | None, int, np.ndarray]], number: int, kind: str) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = best_fit(np.array([len(p[2]) for p in window]), row_tokens)
        name = f"{TaskContext.get().partitionId()}-{number}"
        for at in range(0, len(rows), MATRIX_ROWS):
            part = rows[at : at + MATRIX_ROWS]
            ids = np.full((len(part), row_tokens), pad_id, kind)
            ends = []
            for k, row in enumerate(part):
                own = np.concatenate([window[i][2] for i in row])
                ids[k, : len(own)] = own
                ends.append(np.cumsum([0, *(len(window[i][2]) for i in row)]).astype(np.int32).tolist())
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "matrix": f"{name}-{at // MATRIX_ROWS}", "n_rows": len(part), "n_tokens": sum(e[-1] for e in ends), "ids": ids.tobytes(),
                        "cu_seqlens": ends, "position_resets": [e[:-1] for e in ends],
                        "doc_ids": [[window[i][0] for i in row] for row in part], "first_tokens": [[window[i][1] for i in row] for row in part],
                    }
                ],
                schema=to_arrow_schema(SCHEMA),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        kind = "<u2" if len(c.bytes_of) <= 1 << 16 and pad_id < 1 << 16 and (end_id or 0) < 1 << 16 else "<u4"
        window: list[tuple[int | None, int, np.ndarray]] = []
        held = number = 0
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), utf8(batch["text"])
            for part in grouped_by_bytes(texts, 1 << 20):
                for name, ids in zip(names[part], c.encode([t.decode("utf-8", "replace") for t in texts[part]]), strict=True):
                    tokens = np.frombuffer(ids, "<u4").astype(kind)
                    if end_id is not None:
                        tokens = np.append(tokens, np.array([end_id], kind))
                    for at in range(0, len(tokens), row_tokens):
                        window.append((name, at, tokens[at : at + row_tokens]))
                    held += len(tokens)
                    if held >= WINDOW_TOKENS:
                        yield from pack(window, number, kind)
                        window, held, number = [], 0, number + 1
        if window:
            yield from pack(window, number, kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the matrices as Parquet files under ``path``."""
    packed(docs, tokenizer, **options).write.parquet(path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed matrices, each text ended by the tokenizer's end-of-text token."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pad_id=50256, end_id=50256)
