"""The mix against a plain one, its budgets, and awkward rows."""

import re
from collections import Counter
from hashlib import md5

import pytest

from chunkloom.llm import mixing
from tests.llm.test_operators import SCHEMA, awkward_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """The rule as it is told: share by weight, stop at the limit, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] >= most * sizes[s] * total}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= above


def plain_plan(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    targets, out = plain_targets(sizes), []
    for s in sizes:
        budget = min(int(targets[s] + 0.5), 3 * sizes[s])
        epochs, before = (budget // sizes[s], 0) if sizes[s] else (0, 0)
        rest = budget - epochs * sizes[s]
        own = [(md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], -1 if r[0] is None else r[0], len(WORDS.findall(r[1] or "")), r[0]) for r in rows if r[3] == s]
        for _, _, size, doc_id in sorted(own, key=lambda x: x[:3]):
            out.append((doc_id, size, sizes[s], targets[s], epochs * size + max(0, min(size, rest - before))))
            before += size
    return out


def mix_rows(n_sources=7):
    """One source with a third of the rows, some too small for their share, null and wordless ones."""
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else [None, "é", "a", "b", "Z", "tiny", "dumb"][i % n_sources]
        words = 0 if source == "dumb" else 1 if source == "tiny" else i * i % 97
        rows.append((i, " \n\t".join(f"w{i}_{k}" for k in range(words)) or None, "en", source, 0, "clash", 1, 1, 1.0))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(docs).select("mix_id", "size", "source_size", "target", "taken").collect()
    want = plain_plan(rows)
    assert sorted(map(str, ((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in plan))) == sorted(map(str, ((*w[:3], round(w[3], 6), w[4]) for w in want)))
    return docs, plan


def test_plan_as_plain(spark):
    docs, plan = check(spark, mix_rows())
    assert sum(r.taken for r in plan) == pytest.approx(sum(r["size"] for r in plan), abs=4)
    assert all(r.taken <= 3 * r["size"] for r in plan)
    assert any(r.target == 3 * r.source_size for r in plan)
    assert sorted(plan) == sorted(mixing.mix_plan(docs.repartition(7)).select("mix_id", "size", "source_size", "target", "taken").collect())


def test_mix_holds_what_the_plan_takes(spark):
    rows = mix_rows()
    rows += [rows[3]] * 40  # rows alike in all columns
    docs, plan = check(spark, rows)
    out = mixing.mixed(docs).collect()
    taken, got = Counter(), Counter()
    for r in plan:
        taken[r.mix_id] += r.taken
    whole = {r[0]: r[1] for r in rows}
    for r in out:
        assert whole[r.doc_id].startswith(r.text)
        got[r.doc_id] += len(WORDS.findall(r.text))
    assert +taken == +got
    assert out[0].asDict().keys() >= {"digest", "component_id", "mix_epoch"}


def test_awkward_and_empty(spark):
    check(spark, [r for r in awkward_rows()])
    for rows in ([], [r for r in awkward_rows() if not WORDS.search(r[1] or "")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        plan = mixing.mix_plan(docs).collect()
        assert len(plan) == len(rows) and all(r.taken == 0 and r.target == 0 for r in plan)
        assert mixing.mixed(docs).count() == 0
