"""Hard negatives by angular triangle filtering.

Components become floor(256 x); a score is the inner product of two such vectors, a whole number. Every row stores its angles to
a few reference directions. An angle between two vectors lies between the difference and the sum of their angles to any one direction,
so stored angles give a cosine interval; times the norms and rounded outwards it bounds the score. Rows of a shard stand in
the order of their nearest direction and the angle to it, cut into runs; a run has the least and largest angle to each direction. An anchor meets a
run only if the run's score window overlaps what the anchor still wants; only then scores are computed, exactly.

Two passes over the same kind of shard. First each anchor looks for its best rows of its own label (``positives`` of them) in shards of that
label. Then it looks in all shards for the first ``negatives`` rows of other labels whose score lies in each positive's window. What it
wants rises as it finds: the worst of the rows found so far is the least score of interest. Shards give their best, the best of all are merged.

Directions are picked farthest first from at most ``DIRECTION_ROWS`` rows of smallest hash; they decide what is skipped, never a result.

Defined results: rows with a null id, label or vector, or with a component that is null, not finite, or not finite times 256 take
no part. Vectors of different lengths are compared as if the shorter ended in zeros. Rows that repeat an id stand for themselves, but
none of them is a positive or negative of an anchor of that id; anchors alike in id, label and vector give their results once. Scores
outside of a long are held at its ends after ranking. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import bounded_batches, table, written

POSITIVES, NEGATIVES = 5, 10
#: Least and most score of a negative in percent of the positive's.
LEAST, MOST = 30, 90
#: Rows of a shard, how many shards there are before shards grow, and how far they grow.
SHARD_ROWS, SHARDS, MOST_SHARD_ROWS = 8_192, 256, 262_144
#: Anchors of a block.
BLOCK_ROWS = 4_096
DIRECTIONS, DIRECTION_ROWS = 8, 4_096
#: Rows of a run, and runs that are scored at once.
RUN, AT_ONCE = 64, 16
#: Angles are off by less than this (arccos near its ends loses half of a double's digits).
SLACK = 1e-6
_LONG = (-(1 << 63), (1 << 63) - 1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors as rows, filled up with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def _norms(q: np.ndarray) -> np.ndarray:
    scale = np.abs(q).max(axis=1, initial=0)
    return scale * np.sqrt(((q / np.where(scale > 0, scale, 1)[:, None]) ** 2).sum(axis=1))


def angles(q: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to each direction). A zero vector has angle 0; its norm makes every bound 0."""
    q, directions = _same_width(q, directions)
    norms = _norms(q)
    unit = q / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(unit @ directions.T, -1, 1)), 0)


class Anchors(NamedTuple):
    """Rows that ask, with their stored angles."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    theta: np.ndarray


class Exact:
    """Inner products in the narrowest numbers that hold them: by Cauchy and Schwarz no partial sum exceeds the product of norms."""

    def __init__(self, norm_a: float, norm_b: float):
        most = norm_a * norm_b * 1.001
        self.dtype = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        # a score and the place of a row in one number, if it fits a long
        self.whole = np.int64 if most < 1 << 42 else object

    def cast(self, q: np.ndarray) -> np.ndarray:
        if self.dtype is object:
            return np.array([[int(x) for x in row] for row in q], object).reshape(q.shape)
        return q.astype(self.dtype)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T


class Shard:
    """Rows of a shard in runs of near angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norms: np.ndarray, theta: np.ndarray):
        nearest = theta.argmin(axis=1) if theta.shape[1] else np.zeros(len(ids), int)
        order = np.lexsort((theta[np.arange(len(ids)), nearest] if theta.shape[1] else ids, nearest))
        self.ids, self.labels, self.q, self.norms = ids[order], labels[order], q[order], norms[order]
        self.place = np.empty(len(ids), np.int64)  # ties go to the smaller id
        self.place[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.by_place = np.argsort(self.place)
        theta, first = theta[order], np.arange(0, len(ids), RUN)
        self.low, self.high = np.minimum.reduceat(theta, first), np.maximum.reduceat(theta, first)
        self.least_norm, self.most_norm = np.minimum.reduceat(self.norms, first), np.maximum.reduceat(self.norms, first)

    def bounds(self, norms: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor (rows) with any row of each run (columns)."""
        near, far = np.zeros((len(norms), len(self.low))), np.full((len(norms), len(self.low)), np.pi)
        for d in range(theta.shape[1]):
            t = theta[:, d : d + 1]
            near = np.maximum(near, np.maximum(self.low[:, d] - t, t - self.high[:, d]))
            far = np.minimum(far, np.minimum(t + self.high[:, d], 2 * np.pi - t - self.low[:, d]))
        top, bottom = np.cos(np.clip(near - SLACK, 0, np.pi)), np.cos(np.clip(far + SLACK, 0, np.pi))
        above = norms[:, None] * np.where(top > 0, self.most_norm, self.least_norm) * top
        below = norms[:, None] * np.where(bottom > 0, self.least_norm, self.most_norm) * bottom
        off = 1 + 1e-9 * norms[:, None] * self.most_norm
        return np.floor(below - off), np.ceil(above + off)


def best(shard: Shard, asking: Anchors, same: bool, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first ``k`` rows of each anchor (rows) in each window (columns of ``least`` and ``most``, both ends included; empty if least > most) among
    the rows of the anchor's label (``same``) or of others: (anchor * windows + window, id, score, runs scored)."""
    ids, labels = asking.ids, asking.labels
    a, v = _same_width(asking.q, shard.q)
    exact = Exact(asking.norms.max(initial=0), shard.norms.max(initial=0))
    a, v = exact.cast(a), exact.cast(v)
    low, high = shard.bounds(asking.norms, asking.theta)
    windows, n = least.shape[1], len(shard.ids)
    need = least.astype(object if exact.whole is object else np.float64)
    spare = [np.empty(0, np.int64), np.empty(0, exact.whole)]  # slot and score * n + (n - 1 - place) of the best so far
    top = most.max(axis=1, initial=-np.inf)
    order = np.argsort(-high.max(axis=0, initial=0), kind="stable") if len(ids) else []
    scored = 0
    for at in range(0, len(order), AT_ONCE):
        runs = order[at : at + AT_ONCE]
        wanted = need.astype(np.float64).min(axis=1, initial=np.inf)
        overlap = (high[:, runs] >= wanted[:, None]) & (low[:, runs] <= top[:, None])
        some = np.flatnonzero(overlap.any(axis=1))
        if not len(some):
            continue
        runs = runs[overlap.any(axis=0)]
        scored += len(runs)
        rows = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        rows = rows[rows < n]
        s = exact.scores(a[some], v[rows])
        ok = (s >= wanted[some, None]) & (s <= top[some, None])
        i, j = np.nonzero(ok)
        score = np.array([int(x) for x in s[i, j]], object) if exact.whole is object else s[i, j].astype(np.int64)
        i, j = some[i], rows[j]
        alike = labels[i] == shard.labels[j]
        fit = (alike if same else ~alike) & (ids[i] != shard.ids[j])
        i, j, score = i[fit], j[fit], score[fit]
        slots, keys = [spare[0]], [spare[1]]
        for w in range(windows):
            inside = (score >= need[i, w]) & (score <= most[i, w])
            slots.append(i[inside] * windows + w)
            keys.append(score[inside] * n + (n - 1 - shard.place[j[inside]]))
        slot, key = np.concatenate(slots), np.concatenate(keys)
        by = np.lexsort((-key, slot)) if exact.whole is not object else np.array(sorted(range(len(slot)), key=lambda x: (slot[x], -key[x])), np.int64)
        slot, key = slot[by], key[by]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        spare = [slot[rank < k], key[rank < k]]
        last = rank == k - 1
        # equal scores can still win by their id
        need.ravel()[slot[last]] = np.maximum(need.ravel()[slot[last]], key[last] // n)
    slot, key = spare
    return slot, shard.ids[shard.by_place[(n - 1 - key % n).astype(np.int64)]], key // n, scored


def _cut(scores: np.ndarray) -> list[int]:
    return [min(max(int(x), _LONG[0]), _LONG[1]) for x in scores]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
    return rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))


def reference_directions(rows: DataFrame, count: int = DIRECTIONS) -> np.ndarray:
    """``count`` unit vectors of ``DIRECTION_ROWS`` rows at most, each farthest from those before."""
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(DIRECTION_ROWS).toArrow()
    q = np.floor(256 * matrix(sample["embedding"])) if sample.num_rows else np.zeros((0, 1))
    norms = _norms(q)
    unit = q[norms > 0] / norms[norms > 0][:, None]
    unit = unit[np.lexsort(unit.T)]
    chosen: list[int] = [0] if len(unit) else []
    nearest = np.full(len(unit), -2.0)
    while chosen and len(chosen) < count:
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        if nearest.min() > 1 - 1e-9:
            break
        chosen.append(int(nearest.argmin()))
    return unit[chosen]


_STORED = "vec_id long, label string, q array<double>, norm double, theta array<double>"


def with_angles(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Quantised vectors with their norm and their angle to each direction."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.floor(256 * matrix(b["embedding"]))
            norms, theta = angles(q, directions)
            sizes = b["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            flat = q[np.arange(q.shape[1])[None, :] < sizes[:, None]]
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), v.ravel()) for n, v in ((sizes, flat), (np.full(len(b), theta.shape[1]), theta))]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], lists[0], pa.array(norms), lists[1]], names=["vec_id", "label", "q", "norm", "theta"])

    return rows.mapInArrow(store, _STORED)


def shard_count(rows: Column) -> Column:
    """Shards of ``rows`` rows: ``SHARD_ROWS`` each, larger ones beyond ``SHARDS`` shards up to ``MOST_SHARD_ROWS``."""
    by_size = F.ceil(rows / SHARD_ROWS)
    return F.greatest(F.lit(1), F.least(by_size, F.greatest(F.lit(SHARDS), F.ceil(rows / MOST_SHARD_ROWS)))).cast("int")


def _numbers(label: pa.ChunkedArray, other: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    code = {x: i for i, x in enumerate(set(label.to_pylist()) | set(other.to_pylist()))}
    return tuple(np.array([code[x] for x in c.to_pylist()], np.int64) for c in (label, other))


def _both(anchors: pa.Table, rows: pa.Table) -> tuple[Anchors, Shard]:
    sides = []
    for t, labels in zip((anchors, rows), _numbers(anchors["label"], rows["label"]), strict=True):
        sides.append((t["vec_id"].to_numpy(), labels, matrix(t["q"]), t["norm"].to_numpy(), matrix(t["theta"])))
    return Anchors(*sides[0]), Shard(*sides[1])


def _positives_in(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("anchor_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        asking, shard = _both(anchors, rows)
        ends = np.full((len(asking.ids), 1), -np.inf)
        slot, found, score, _ = best(shard, asking, True, ends, -ends, k)
        return pa.Table.from_pydict({"anchor": asking.ids[slot], "anchor_key": anchors["anchor_key"].to_numpy()[slot], "vec_id": found, "score": _cut(score)}, schema)

    return find


def windows_of(scores: list[list[int]], least: int, most: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the score windows least * p <= 100 * s <= most * p in whole scores; no window as an empty one."""
    low, high = np.full((len(scores), wide), np.inf), np.full((len(scores), wide), -np.inf)
    for i, own in enumerate(scores):
        for j, p in enumerate(own):
            low[i, j], high[i, j] = -(-least * p // 100), most * p // 100
    return low, high


def _negatives_in(k: int, least: int, most: int):
    schema = pa.schema([("anchor_key", pa.int64()), ("positive", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        asking, shard = _both(anchors, rows)
        scores = anchors["scores"].to_pylist()
        low, high = windows_of(scores, least, most, max(map(len, scores)))
        slot, found, score, _ = best(shard, asking, False, low, high, k)
        wide = low.shape[1]
        return pa.Table.from_pydict(
            {"anchor_key": anchors["anchor_key"].to_numpy()[slot // wide], "positive": (slot % wide).astype(np.int32), "vec_id": found, "score": _cut(score)}, schema
        )

    return find


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", anchor: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for the rows that ``anchor`` picks
    (by default those whose id is divisible by 100)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    found = usable(vectors, id_col, vector_col, F.col(label) if isinstance(label, str) else label)
    rows = written(with_angles(found, reference_directions(found)), "vectors")
    picked = rows.where(anchor if anchor is not None else F.col("vec_id") % 100 == 0)
    anchors = written(picked.withColumn("anchor_key", F.xxhash64("vec_id", "label", "q")).dropDuplicates(["vec_id", "label", "q"]), "anchors")
    blocks = max(-(-anchors.count() // BLOCK_ROWS), 1)

    of_label = written(rows.groupBy("label").agg(shard_count(F.count("*")).alias("shards")), "label-shards")
    held = rows.join(of_label, "label").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).drop("shards")
    asking = anchors.join(of_label, "label").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    near = asking.groupBy("label", "shard").cogroup(held.groupBy("label", "shard")).applyInArrow(_positives_in(positives), "anchor long, anchor_key long, vec_id long, score long")
    by_score = Window.partitionBy("anchor_key").orderBy(F.col("score").desc(), "vec_id")
    chosen = written(near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives), "positives")

    wanted = chosen.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).getField("score").alias("scores"))
    shards = rows.agg(shard_count(F.count("*"))).first()[0]
    asking = anchors.join(wanted, "anchor_key").withColumn("block", F.pmod("anchor_key", F.lit(blocks)).cast("int"))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asking.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(
        _negatives_in(negatives, least, most), "anchor_key long, positive int, vec_id long, score long"
    )
    by_score = Window.partitionBy("anchor_key", "positive").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    ranked = ranked.select("anchor_key", (F.col("positive") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(ranked, ["anchor_key", "place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("vec_id").alias("positive_id"), "rank", "negative_id",
        F.col("score").alias("positive_score"), "negative_score", F.col("place").alias("positive_rank"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every vector whose id is divisible by 100; every seventh vector has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


OP13_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
