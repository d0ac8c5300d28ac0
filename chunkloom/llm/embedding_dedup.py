"""Near-duplicates among embeddings by navigable small-world graphs, one hierarchy for each shard.

Vectors of one label (and one length) are dealt into shards of bounded size. Each shard's graph is built once, audited, and written.
The audit plants probes: ``AUDITED`` nodes of the shard, picked by hash, are turned to cosines spread between ``COSINE`` and 1. A probe
isn't in the graph, so it stands for the missing half of a pair, whatever links the data have. What the beams find for the probes
is held against brute force, each probe counting the same: while the mean recall is below ``RECALL``, the shard's beams are doubled and the
audit is repeated; a beam as wide as the shard is brute force itself.

Every vector then queries every shard of its label, in blocks, with the shard's beam. A beam search runs for a block of queries in step; a
query whose beam fills with hits goes on with a wider one. What is found is verified by cosine in double precision.

Equal vectors are one class from the start, so copies cost nothing; links are counted by class sizes. Tasks emit each
vector's number of links and a forest of links, which are joined to components; pairs aren't listed.

Defined results: vectors that are null, zero, or hold null or non-finite components, and such without a label, link with
nothing and are their own component. Rows that repeat an id count as vectors each. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import bounded_batches, components, mix64, written

COSINE = 0.93
#: Vectors of a shard, and queries of a block, on average.
SHARD_ROWS = 10_000
#: Links of a node on upper layers; twice as many on the lowest.
DEGREE = 12
BEAM_BUILD, BEAM = 32, 32
#: Mean share of its links that a planted probe must find, and how many probes a shard gets.
RECALL, AUDITED = 0.99, 96
_IN_STEP = 256


def _top(sims: np.ndarray, ids: np.ndarray, done: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if sims.shape[1] <= n:
        return sims, ids, done
    keep = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    return np.take_along_axis(sims, keep, 1), np.take_along_axis(ids, keep, 1), np.take_along_axis(done, keep, 1)


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) in each query's final beam; -1 where it isn't full. ``links``: neighbours of each node, -1 as none."""
    count, at_once = len(queries), max(1, width // 16)
    row = np.arange(count)[:, None]
    seen = np.zeros((count, len(vectors) + 1), bool)  # the last column takes the -1s
    seen[:, -1] = True
    ids = entry.reshape(count, -1)
    np.put_along_axis(seen, ids, True, 1)
    sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", vectors[ids], queries), -2).astype(np.float32)
    done = ids < 0
    while True:
        todo = np.where(done, np.float32(-3), sims)
        k = min(at_once, todo.shape[1])
        pick = np.argpartition(-todo, k - 1, axis=1)[:, :k] if k < todo.shape[1] else np.tile(np.arange(k), (count, 1))
        live = np.take_along_axis(todo, pick, 1) > -2.5
        if not live.any():
            return ids, sims
        nodes = np.where(live, np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(count, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[row, near]] = -1
        seen[row, near] = True
        some = near >= 0
        if not some.any():
            continue
        wide = int(some.sum(axis=1).max())
        near = -np.sort(-near, axis=1)[:, :wide]
        new = np.where(near >= 0, np.einsum("bkd,bd->bk", vectors[near], queries), -2).astype(np.float32)
        sims, ids, done = np.concatenate([sims, new], 1), np.concatenate([ids, near], 1), np.concatenate([done, near < 0], 1)
        sims, ids, done = _top(sims, ids, done, width)


def _spread(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, up to ``degree``: nearest first, those nearer to the node than to any chosen one; the rest fill up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    count, wide = ids.shape
    chosen = np.full((count, degree), -1, np.int64)
    held = np.zeros((count, degree, vectors.shape[1]), np.float32)
    n = np.zeros(count, np.int64)
    taken = np.zeros(ids.shape, bool)
    for k in range(wide):
        v = vectors[ids[:, k]]
        nearest = np.where(np.arange(degree)[None, :] < n[:, None], np.einsum("bmd,bd->bm", held, v), -2).max(axis=1)
        ok = np.flatnonzero((ids[:, k] >= 0) & (ids[:, k] != own) & (n < degree) & (nearest < sims[:, k]))
        chosen[ok, n[ok]] = ids[ok, k]
        held[ok, n[ok]] = v[ok]
        taken[ok, k] = True
        n[ok] += 1
    for k in range(wide):
        ok = np.flatnonzero((ids[:, k] >= 0) & (ids[:, k] != own) & ~taken[:, k] & (n < degree))
        chosen[ok, n[ok]] = ids[ok, k]
        n[ok] += 1
    return chosen


def build_graph(vectors: np.ndarray, seed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (nodes, links of each node as numbers within the layer)."""
    height = np.floor(-np.log(np.maximum(mix64(seed.astype(np.uint64)).astype(np.float64) / 2.0**64, 1e-18)) / np.log(DEGREE)).astype(int)
    layers = []
    for level in range(int(height.max(initial=0)) + 1):
        nodes = np.flatnonzero(height >= level)
        degree = 2 * DEGREE if level == 0 else DEGREE
        layers.append((nodes, _layer(vectors[nodes], degree)))
        if len(nodes) <= DEGREE:
            break
    return layers


def _layer(vectors: np.ndarray, degree: int) -> np.ndarray:
    """Links of a layer whose nodes are inserted in batches that grow with what is there."""
    n = len(vectors)
    links = np.full((n + 1, degree), -1, np.int64)
    at = 0
    while at < n:
        size = min(n - at, 256, max(at, 64))
        new = np.arange(at, at + size)
        q = vectors[new]
        inside = q @ q.T
        np.fill_diagonal(inside, -2)
        k = min(size, degree)
        among = np.argpartition(-inside, k - 1, axis=1)[:, :k]
        ids, sims = among + at, np.take_along_axis(inside, among, 1)
        if at:
            # entries: some nodes spread over what is there
            entry = np.tile(np.unique(np.linspace(0, at - 1, 8).astype(int)), (size, 1))
            found, found_sims = _beam(vectors[:at], links[:at], q, entry, BEAM_BUILD)
            ids, sims = np.concatenate([found, ids], 1), np.concatenate([found_sims, sims], 1)
        ids = np.where(sims > -1.5, ids, -1)
        links[new] = _spread(vectors, new, ids, sims, degree)
        # links back
        a = np.repeat(new, degree)
        b = links[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(b, prepend=-1))
        to = b[first]
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        back = np.full((len(to), int(rank.max(initial=-1)) + 1), -1, np.int64)
        back[np.searchsorted(to, b), rank] = a
        for part in np.array_split(np.arange(len(to)), len(to) // 512 + 1):
            if len(part):
                ids = np.concatenate([links[to[part]], back[part]], 1)
                ids.sort(axis=1)
                ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
                sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", vectors[ids], vectors[to[part]]), -2)
                if ids.shape[1] > 4 * degree:
                    sims, ids, _ = _top(sims, ids, ids < 0, 4 * degree)
                links[to[part]] = _spread(vectors, to[part], ids, sims, degree)
        at += size
    return links[:n]


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int) -> list[np.ndarray]:
    """Nodes with about ``COSINE`` or more to each query. Beams widen while hits fill half of them."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    todo, least = np.arange(len(queries)), np.float32(COSINE - 1e-4)
    while len(todo):
        again = []
        step = max(1, min(_IN_STEP, (64 << 20) // max(1, len(vectors)), (4 << 20) // max(width, 1)))
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            q = queries[part]
            if 2 * width >= len(vectors):
                for i, row in zip(part, q @ vectors.T >= least, strict=True):
                    out[i] = np.flatnonzero(row)
                continue
            nodes, links = layers[-1]
            entry = np.tile(np.arange(min(len(nodes), 8)), (len(q), 1))
            for level in range(len(layers) - 1, -1, -1):
                nodes, links = layers[level]
                ids, sims = _beam(vectors[nodes], links, q, entry, width if level == 0 else 8)
                if level:
                    below = layers[level - 1][0]
                    entry = np.where(ids >= 0, np.searchsorted(below, nodes[ids]), -1)
            hits = (sims >= least) & (ids >= 0)
            for k, i in enumerate(part):
                out[i] = ids[k][hits[k]]
            again.append(part[2 * hits.sum(axis=1) >= width])
        todo = np.concatenate(again) if again else todo[:0]
        width *= 4
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True, initial=1e-300)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_GRAPH = "key long, shard int, width int, ids binary, counts binary, units binary, layers array<binary>"


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("rep")
    ids, units = group["rep"].to_numpy(), _unit(_matrix(group["embedding"]))
    order = np.argsort(mix64(ids.astype(np.uint64)), kind="stable")  # insertion in no order of the data
    ids, units = ids[order], units[order]
    vectors = units.astype(np.float32)
    layers = build_graph(vectors, ids)
    width = audited_width(vectors, layers, ids)
    return pa.Table.from_pydict(
        {
            "key": group["key"][:1], "shard": group["shard"][:1].cast(pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids.tobytes()], "counts": [group["n"].to_numpy()[order].tobytes()],
            "units": [units.tobytes()], "layers": [[x.astype(np.int64).tobytes() for layer in layers for x in layer]],
        },
        schema=pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("units", pa.binary()), ("layers", pa.list_(pa.binary()))]),
    )


def planted(vectors: np.ndarray, ids: np.ndarray, count: int = AUDITED) -> np.ndarray:
    """Unit vectors at cosines spread evenly from ``COSINE`` to 1 to ``count`` nodes, the same for the same nodes."""
    pick = np.argsort(mix64(ids.astype(np.uint64) ^ np.uint64(0x5DEECE66D)), kind="stable")[:count]
    near = vectors[pick].astype(np.float64)
    draw = mix64(ids[pick].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, near.shape[1] + 1, dtype=np.uint64))
    away = draw.astype(np.float64) / 2.0**64 - 0.5
    away -= (away * near).sum(axis=1, keepdims=True) * near
    away = _unit(away + 1e-12)
    cosine = np.linspace(COSINE + 1e-3, 1, len(pick))[:, None]
    return (cosine * near + np.sqrt(1 - cosine**2) * away).astype(np.float32)


def audited_width(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> int:
    """The beam with which planted probes find their links in this graph."""
    probes, width = planted(vectors, ids), BEAM
    truth = [np.flatnonzero(row) for row in probes @ vectors.T >= np.float32(COSINE)]
    while 2 * width < len(vectors):
        found = search(vectors, layers, probes, width)
        if np.mean([np.isin(t, f).mean() for t, f in zip(truth, found, strict=True) if len(t)] or [1.0]) >= RECALL:
            break
        width *= 2
    return width


def _query(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of a block of queries to a shard: (a, b, n), n with b null for the number of links of a, b for a link of the forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    ids, counts = (np.frombuffer(right[c][0].as_py(), np.int64) for c in ("ids", "counts"))
    units = np.frombuffer(right["units"][0].as_py(), np.float64).reshape(len(ids), -1)
    vectors = units.astype(np.float32)
    arrays = [np.frombuffer(x, np.int64) for x in right["layers"][0].as_py()]
    layers = [(nodes, links.reshape(len(nodes), -1)) for nodes, links in zip(arrays[::2], arrays[1::2], strict=True)]
    own, exact = left["rep"].to_numpy(), _unit(_matrix(left["embedding"]))
    queries = exact.astype(np.float32)
    found = search(vectors, layers, queries, right["width"][0].as_py())
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b, n = [], [], []
    for i, near in enumerate(found):
        near = near[(ids[near] != own[i]) & (units[near] @ exact[i] >= COSINE)]
        if len(near):
            a.append(int(own[i]))
            b.append(None)
            n.append(int(counts[near].sum()))
            for k in ids[near].tolist():
                x, y = root(int(own[i])), root(k)
                if x != y:
                    parent[x] = y
                    a.append(int(own[i]))
                    b.append(k)
                    n.append(0)
    return pa.Table.from_pydict({"a": a, "b": b, "n": n}, schema=schema)


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id) of each row."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable).withColumn("key", F.xxhash64("label", F.size("embedding")))
    classes = written(good.groupBy("label", "key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    sizes = classes.groupBy("key").agg((F.floor((F.count("*") - 1) / shard_rows) + 1).cast("int").alias("shards"))
    dealt = classes.join(written(sizes, "labels"), "key")
    graphs = dealt.withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int")).select("key", "shard", "rep", "n", "embedding")
    graphs = written(graphs.groupBy("key", "shard").applyInArrow(_build, _GRAPH), "graphs")
    number = F.sequence(F.lit(0), F.col("shards") - 1)
    queries = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), "shards").cast("int")).withColumn("shard", F.explode(number))
    served = graphs.join(sizes, "key").withColumn("block", F.explode(number)).drop("shards")
    queries = queries.select("key", "shard", "block", "rep", "embedding")
    links = queries.groupBy("key", "shard", "block").cogroup(served.groupBy("key", "shard", "block")).applyInArrow(_query, "a long, b long, n long")
    links = written(links, "vector-links")
    counted = links.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    place = classes.select("label", "embedding", "rep", "n").join(counted.withColumnRenamed("a", "rep"), "rep", "left")
    place = place.join(components(links.where("b is not null")).withColumnRenamed("node", "rep"), "rep", "left")
    found = good.join(place, ["label", "embedding"]).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
