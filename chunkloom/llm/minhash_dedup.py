"""Near-duplicates by an inverted join over MinHash signature coordinates.

Each distinct shingle set has a signature of ``COORDINATES`` minima. It is posted under coordinate-value pairs
(tokens). Two signatures that agree in m coordinates share a token among the first
``COORDINATES - m + 1`` of each in any common order of tokens (prefix merging), and the order used is
rarest first: tokens that only one set has sort first and need no posting, and frequent ones come last, so long posting
lists are skipped unless sets agree in nearly all of them (skip merging). Collisions of a candidate pair are
counted over the whole signature; pairs below the threshold go. What remains is confirmed on the full sets.

Copies (equal sets) are one class throughout. Pairs are made in two rounds: each member of a posting list with the
list's smallest member, then members of a list that aren't connected yet, which are compared inside tasks block by
block and of which only a forest of links comes out. So a large group of near copies costs a row for each copy, and no
link between components is lost: pairs that agree in fewer than m coordinates aside. ``least_matches`` sets m so that of
pairs exactly at the least similarity asked for at most the share ``MISSED`` is lost, and far less above it.

Defined results: texts that are null or without words have an empty set and link with nothing; a null id is a
component of its own (null) and kept. Rows that repeat an id are one document: it links with whatever one of its texts links
with. Classes have numbers of their own, so texts of one id are never taken for each other. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, components, discard, keep_rows, mix64, utf8, written
from chunkloom.llm.shingles import shingle_sets

COORDINATES = 64
#: Share of pairs exactly at the least similarity that may agree in too few coordinates.
MISSED = 1 / 30_000
#: Link when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80

_ODD = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
#: Hashes of which one coordinate's values are computed at once, so that they stay in a core's cache.
_AT_ONCE = 1 << 15


def least_matches(similarity: int) -> int:
    """The most coordinates that all pairs of this similarity in percent agree in, but for the share ``MISSED``."""
    p, missed = similarity / 100, 0.0
    for m in range(COORDINATES):
        missed += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed > MISSED:
            return m
    return COORDINATES


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima of each non-empty set (rows) under each coordinate's hash; ``sizes`` are positive."""
    out = np.empty((len(sizes), COORDINATES), np.uint32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _AT_ONCE, "right")))
        h = hashes[base : ends[to - 1]]
        starts = ends[at:to] - sizes[at:to] - base
        for k in range(COORDINATES):
            out[at:to, k] = np.minimum.reduceat(((h * _ODD[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at = to
    return out


def _class_keys(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set, the sums of two mixes of its members; None for an empty one."""
    keys: list[bytes | None] = [None] * len(sizes)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        key = np.stack([np.add.reduceat(mix64(hashes + np.uint64(salt)), starts) for salt in (0x51ED270B, 0x2545F491)], axis=1)
        for i, k in zip(some.tolist(), key, strict=True):
            keys[i] = k.tobytes()
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"]
        for first, hashes, sizes in shingle_sets(utf8(batch["text"])):
            some = np.flatnonzero(sizes)
            keys = _class_keys(hashes, sizes)
            packed: list[bytes | None] = [None] * len(sizes)
            if len(some):
                for i, s in zip(some.tolist(), signatures(hashes, sizes[some]), strict=True):
                    packed[i] = s.tobytes()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids.slice(first, len(sizes)), "n_shingles": pa.array(sizes, pa.int64()), "class": pa.array(keys, pa.binary()), "signature": pa.array(packed, pa.binary())}
            )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate-value pair of each class."""
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(utf8(batch["signature"])), np.uint32).reshape(-1, COORDINATES)
            rep = np.repeat(batch["rep"].to_numpy(zero_copy_only=False), COORDINATES)
            yield pa.RecordBatch.from_pydict({"rep": rep, "token": (values.astype(np.int64) | coordinate).ravel()})


@F.arrow_udf(T.IntegerType())
def _matches(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(utf8(c)), np.uint32).reshape(-1, COORDINATES) for c in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


def _members(hashes: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(hashes.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts whose class is known."""
    for batch in batches:
        for first, hashes, sizes in shingle_sets(utf8(batch["text"])):
            yield pa.RecordBatch.from_pydict({"rep": batch["rep"].slice(first, len(sizes)), "members": _members(hashes, sizes)})


def _sets_with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts of which the class has to be found by its key."""
    for batch in batches:
        for _, hashes, sizes in shingle_sets(utf8(batch["text"])):
            yield pa.RecordBatch.from_pydict({"class": pa.array(_class_keys(hashes, sizes), pa.binary()), "members": _members(hashes, sizes)})


#: Rows and shingles of a block of an open posting list.
BLOCK_ROWS, BLOCK_SHINGLES = 1_000, 400_000


def _bits(members: pa.ListArray) -> np.ndarray:
    """The sets as rows of bits, over the hashes that two of them have."""
    values = members.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(members.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values)
    values, row = values[order], row[order]
    first = np.diff(values, prepend=~values[:1]) != 0 if len(values) else np.empty(0, bool)
    column = np.cumsum(first) - 1
    many = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    column, row = column[many], row[many]
    column = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
    bits = np.zeros((len(sizes), (int(column[-1]) >> 6) + 1 if len(column) else 1), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits


def _linked_in_blocks(similarity: int):
    """Links between two blocks of a posting list, or within one, of classes that aren't connected yet: a forest of them.

    A pair is looked at under the first token that both prefixes have, and in no other list.
    """
    matches = least_matches(similarity)

    def linked(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        place = group["token"][0].as_py() >> 32
        rep, component, block = (group[c].to_numpy() for c in ("rep", "component", "block"))
        signature = np.frombuffer(b"".join(utf8(group["signature"])), np.uint32).reshape(-1, COORDINATES)
        posted = (group["posted"].to_numpy().view(np.uint64)[:, None] >> np.arange(COORDINATES, dtype=np.uint64) & np.uint64(1)).astype(bool)
        members = group["members"].combine_chunks()
        size = np.diff(members.offsets.to_numpy())
        bits = _bits(members)
        within = group["i"][0].as_py() == group["j"][0].as_py()
        right = np.flatnonzero(block == group["j"][0].as_py())
        parent = list(range(len(rep)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for x in right if within else np.flatnonzero(block == group["i"][0].as_py()):
            y = right[right > x] if within else right
            y = y[component[y] != component[x]]
            equal = signature[y] == signature[x]
            y_first = (equal & posted[y] & posted[x]).argmax(axis=1) == place
            y = y[y_first & (equal.sum(axis=1) >= matches)]
            both = np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64)
            for k in y[100 * both >= similarity * (size[y] + size[x] - both)].tolist():
                a, b = root(int(x)), root(k)
                if a != b:
                    parent[a] = b
                    links.append((int(x), k))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.Table.from_pydict({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    return linked


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(rep, token) of each class's prefix, tokens of one class alone left out."""
    tokens = classes.select("rep", "signature").mapInArrow(_tokens, "rep long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # Of a class's tokens in the order rarest first, those it has alone come first and match nothing.
    ranked = (
        tokens.join(shared, "token").groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        .where(F.size("ranked") >= matches)
    )
    prefix = F.slice("ranked", 1, F.size("ranked") - matches + 1)
    return ranked.select("rep", F.explode(prefix["token"]).alias("token"))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that collide often enough and are alike enough on full sets."""
    signature = classes.select("rep", "signature")
    near = (
        pairs.join(signature.withColumnsRenamed({"rep": "a", "signature": "sa"}), "a")
        .join(signature.withColumnsRenamed({"rep": "b", "signature": "sb"}), "b")
        .where(_matches("sa", "sb") >= least_matches(similarity)).select("a", "b")
    )
    near = written(near, "colliding")
    both = F.size(F.array_intersect("ma", "mb"))
    return (
        near.join(sets.withColumnsRenamed({"rep": "a", "members": "ma"}), "a")
        .join(sets.withColumnsRenamed({"rep": "b", "members": "mb"}), "b")
        .where(100 * both >= similarity * (F.size("ma") + F.size("mb") - both)).select("a", "b")
    )


def _candidate_sets(texts: DataFrame, rows: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """(rep, members) of each class that has postings: the set of one of its texts.

    Where an id stands on one row, that row is the class's text. Of ids on several rows the texts' classes are found by key.
    """
    wanted = written(postings.select("rep").distinct().join(classes.select("rep", "class", "doc_id"), "rep"), "candidates")
    repeated = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    single = wanted.join(repeated, "doc_id", "left_anti").select("doc_id", "rep")
    several = wanted.join(repeated, "doc_id", "left_semi")
    by_id = texts.join(single, "doc_id").select("rep", "text").mapInArrow(_sets, "rep long, members array<long>")
    by_key = (
        keep_rows(texts, several.select("doc_id").distinct(), ["doc_id"]).select("text").mapInArrow(_sets_with_class, "class binary, members array<long>")
        .dropDuplicates(["class"]).join(several.select("class", "rep"), "class")
    )
    return written(by_id.unionByName(by_key.select("rep", "members")), "sets")


def _sketched(docs: DataFrame, id_col: str, text_col: str, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: the sketch of each row, and the component of each id that has links. What else was written is deleted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, class binary, signature binary"), "sketches")
    linked = rows.where("class is not null and doc_id is not null")
    classes = written(
        linked.groupBy("class").agg(F.min(F.struct("doc_id", "signature", "n_shingles")).alias("m"))
        .select(F.monotonically_increasing_id().alias("rep"), "class", "m.doc_id", "m.signature", "m.n_shingles"),
        "classes",
    )
    postings = written(_postings(classes, least_matches(similarity)), "postings")
    sets = _candidate_sets(texts, rows, classes, postings)

    hubs = written(postings.groupBy("token").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "hubs")
    star = postings.join(hubs, "token").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    star = written(_confirmed(star, classes, sets, similarity), "links")
    member = linked.select("class", F.col("doc_id").alias("a")).join(classes.select("class", F.col("doc_id").alias("b")), "class").where("a <> b").select("a", "b").distinct()

    found = components(star)
    placed = written(
        postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(classes.select("rep", "n_shingles"), "rep")
        .select("rep", "token", F.coalesce("component", "rep").alias("component"), "n_shingles"),
        "placed",
    )
    n = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), n.alias("blocks")).where("low < high")
    split = written(split.select("token", "blocks"), "open-lists")
    posted = postings.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("posted"))
    of = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    rest = (
        placed.join(split, "token").withColumn("block", of).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "rep", "component")
    )
    of_rep = classes.select("rep", "signature").join(posted, "rep").join(sets, "rep")
    rest = rest.join(of_rep, "rep").groupBy("token", "i", "j").applyInArrow(_linked_in_blocks(similarity), "a long, b long")
    rest = written(rest, "links")
    # the first round's components stand for its links: trees of depth one, so that fewer rounds follow
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    every = written(known.unionByName(rest), "links")
    links = every
    for end in ("a", "b"):
        ids = classes.select(F.col("rep").alias(end), F.col("doc_id").alias(f"id_{end}"))
        links = links.join(ids, end)
    found = components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(member))
    discard(classes, postings, sets, hubs, star, placed, split, rest, every)
    return rows, found


def _grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; ``similarity`` in percent."""
    return _grouped(*_sketched(docs, id_col, text_col, similarity))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id."""
    rows, found = _sketched(docs, id_col, text_col, similarity)
    groups = _grouped(rows, found)
    stay = written(groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "kept")
    discard(rows)
    return keep_rows(docs, stay, [id_col])


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates, linked from a similarity of 0.85 on."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=85).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
