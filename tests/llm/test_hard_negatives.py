"""Hard negatives against a plain search, and awkward vectors."""

import math

import numpy as np
import pytest

from chunkloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int, shards int"


def plain(rows, positives=5, negatives=10):
    """Python integers, all pairs."""
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in good if i % 100 == 0}:
        scored = sorted((-sum(map(int.__mul__, v, w)), j, d) for j, w, d in good if j != i)
        same = [(s, j) for s, j, d in scored if d == c][:positives]
        for place, (p, j) in enumerate(same):
            fit = [(-s, k) for s, k, d in scored if d != c and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, s) for r, (s, k) in enumerate(fit)]
    return sorted(out)


def ours(spark, rows, **kw):
    df = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(tuple(r)[:6] for r in df.collect())


def vectors(n=1500, dim=24, seed=3):
    """Groups of near vectors, a third of all rows in one of them, with many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else int(rng.integers(12))
        v = centres[c] + 0.3 * rng.normal(size=dim)
        if i % 5 == 0:
            v = np.round(centres[c], 1)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], c % 5 if i % 4 else int(rng.integers(5)), "clash", 1, 2))
    return rows


def test_equals_plain_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hn, "SHARD_ROWS", 100)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 4)
    rows = vectors()
    want = plain(rows)
    assert len(want) > 200
    assert ours(spark, rows) == want
    assert ours(spark, rows, positives=3, negatives=2) == plain(rows, 3, 2)


def test_awkward_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(i, v, c, "x", 0, 0) for i, v, c in [
        (0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (0, [1.0, 0.25], 1), (1, [0.5, 0.5], 1), (2, [0.25, 0.5, 0.5], 1), (3, [], 1), (4, [0.0, 0.0], 1),
        (5, None, 1), (6, [None, 1.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1e308, 1.0], 1), (10, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (11, [0.25, 0.25], 2), (11, [0.25, 0.25], 2), (12, [-0.5, -0.5], 2), (13, [0.1, 0.9, 3.0], 2), (14, [0.0], 3), (100, [0.5, 0.5], 2), (200, [], 3), (300, [1.0], 9),
    ]]
    assert ours(spark, rows) == plain(rows)
    assert plain(rows)
    assert ours(spark, rows[:1]) == ours(spark, []) == []


@pytest.mark.parametrize("scale", [1e3, 1e4, 1e6, 1e9])
def test_large_components(spark, scale):
    """Scores beyond what float32, float64 and a long with a place hold."""
    rows = [(i, [x * scale for x in v], c, *rest) for i, v, c, *rest in vectors(300, 6)]
    want = plain(rows)
    if scale == 1e9:
        want = [w for w in want if max(abs(w[4]), abs(w[5])) < 1 << 63]
    assert ours(spark, rows) == want


def test_only_overlapping_windows_are_scored():
    """Far groups are skipped; bounds hold for every pair."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    q = np.floor(256 * np.concatenate([centres[k] + 0.02 * rng.normal(size=(512, 8)) for k in range(8)]))
    labels, ids = np.arange(len(q)) % 2, np.arange(len(q))
    norms, theta = hn.angles(q, centres)
    shard = hn.Shard(ids, labels, q, norms, theta)
    some = np.arange(0, len(q), 97)
    asking = hn.Anchors(ids[some], labels[some], q[some], norms[some], theta[some])
    low, high = shard.bounds(asking.norms, asking.theta)
    scores = q[some] @ shard.q.T
    for r in range(low.shape[1]):
        own = scores[:, r * hn.RUN : (r + 1) * hn.RUN]
        assert (low[:, r] <= own.min(axis=1)).all() and (own.max(axis=1) <= high[:, r]).all()
    ends = np.full((len(some), 1), -np.inf)
    one = hn.Anchors(*[x[:1] for x in asking])
    slot, found, score, scored = hn.best(shard, one, True, ends[:1], -ends[:1], 5)
    assert scored < low.shape[1] / 2
    want = sorted((-s, i) for s, i, c in zip((q @ q[some[0]]).tolist(), ids.tolist(), labels.tolist(), strict=True) if c == labels[some[0]] and i != some[0])[:5]
    assert [(-int(s), int(i)) for s, i in zip(score, found, strict=True)] == want
