"""Divergences against plain integers, over small blocks, and awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np

from chunkloom.llm import divergence as dv
from tests.llm.test_operators import SCHEMA, awkward_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for r in rows:
        text, lang, source = (r[k] or "" for k in (1, 2, 3))
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode(), o) for o in sources - {s}]
            term = [(-((own[s][t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def ours(spark, rows, **kw):
    return sorted(tuple(r) for r in dv.divergence(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def some_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        words = [f"{'WwÉé'[k % 4]}{'abc'[k % 3]}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in (rng.zipf(1.3, 40) % 700).tolist()]
        rows.append((i, "\x0b   ".join(words), ["en", "de", None][i % 3 if i % 5 else 2], source if i % 7 else None, 0, "clash", 1, 1, 1.0))
    return rows + [(900 + i, "12 ...", "xx", f"t{i}", 0, "", 1, 1, 1.0) for i in range(3)]


def test_equals_plain_over_small_blocks(spark, monkeypatch):
    rows = some_rows()
    want = plain(rows)
    assert {len(x[3]) for x in want if x[2] == "term"} and any(x[0] == "xx" and x[4] == 0 for x in want)
    assert ours(spark, rows) == want
    monkeypatch.setattr(dv, "TABLE_ENTRIES", 50)
    monkeypatch.setattr(dv, "PIECE", 16)
    assert ours(spark, rows, block_terms=40, block_groups=3) == want
    assert ours(spark, rows, least_docs=10, top_terms=4) == plain(rows, 10, 4)


def test_awkward_and_empty(spark):
    rows = awkward_rows()
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, rows, least_docs=1, block_terms=100) == plain(rows, 1)
    assert ours(spark, []) == []


def test_shares_are_exact():
    totals = np.array([3, 10**9 + 7, 8 * 10**15])
    counts = np.array([1, 10**9, 7 * 10**15])
    assert dv.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]
