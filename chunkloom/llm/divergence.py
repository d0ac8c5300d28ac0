"""How far the sources of a language lie apart in their words, by three-dimensional cube partitioning.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each language keeps the terms that stand in at least ``LEAST_DOCS`` of its
documents. A group is a (language, source). For each kept term a group and a language have p = 1 + floor(``SCALE`` * (count + 1) / (N + V)),
N being the sum of their counts over the V kept terms; the divergence at a term is floor((p - q)^2 / q).

Counting: a task counts terms in tables of bounded size as texts stream by, and sends (language, source, term, count, documents).
Pairs: terms are numbered within term blocks and groups within group blocks. The slice of a group block and a term block is packed into one row and
replicated to the cells (group block, group block, term block) that need it. A cell is one task's work: it adds up the divergences of its groups
in both directions over its terms. Terms that neither group has, all alike, are counted, not listed. A last sum runs along the term axis.
Terms: each group's terms above the language's share, the ``TOP_TERMS`` highest.

All numbers are whole: p by long division in base 1000, so counts up to 9 * 10**15 are exact.

Defined results: null text, lang and source are ''; a group without terms has N = 0. A language without kept terms gives 0 for each pair. Rows that
repeat count each. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import bounded_batches, table, utf8, written

LEAST_DOCS, SCALE, TOP_TERMS = 3, 10**9, 200
#: Terms of a term block and groups of a group block, on average and at most.
BLOCK_TERMS, BLOCK_GROUPS = 8_192, 16
#: Entries of the tables that a task counts in.
TABLE_ENTRIES = 300_000
#: Bytes of a text that are split at once.
PIECE = 4 << 20

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; pieces end between terms."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split(b" ")  # not split(): that would know other gaps too
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            n.pop(b"", None)
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())  # the row without a term says that the group occurs
            rows = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), utf8(b["text"]), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in _terms(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(n) - before + 1
            if entries >= TABLE_ENTRIES:
                yield from flush()
                counts, entries = {}, 0
    yield from flush()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for each group."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*columns).mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact."""
    exact = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(29,0)")
    return F.call_function("div", exact, total.cast("decimal(19,0)")) + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same over arrays, by long division: ``SCALE`` is 1000 ** 3."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


_SLICE = "lang string, i int, k int, groups array<int>, totals array<long>, terms long, at binary, n binary, own binary"


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """The entries of a slice as arrays: term number, count, and the group's place in the block."""
    rows = rows.sort_by([("number", "ascending"), ("at", "ascending")])
    lang, i, k = (x.as_py() for x in key)
    own, at, n = rows["number"].to_numpy().astype(np.int32), rows["at"].to_numpy().astype(np.int32), rows["n"].to_numpy()
    return pa.table({"lang": pa.array([lang], pa.string()), "i": pa.array([i], pa.int32()), "k": pa.array([k], pa.int32()), "at": [at.tobytes()], "n": [n.tobytes()], "own": [own.tobytes()]})


def _dense(side: dict, columns: np.ndarray) -> np.ndarray:
    """Counts of a slice's groups (rows) at the given terms (columns)."""
    groups = np.array(side["groups"], np.int64)
    out = np.zeros((len(groups), len(columns)), np.int64)
    at, n, own = (np.frombuffer(side[c] or b"", t) for c, t in (("at", np.int32), ("n", np.int64), ("own", np.int32)))
    out[np.searchsorted(groups, own), np.searchsorted(columns, at)] = n
    return out


def cell(left: dict, right: dict) -> list[tuple[int, int, int]]:
    """(group, other, sum of divergences over the cell's terms), in both directions."""
    columns = np.unique(np.concatenate([np.frombuffer(x["at"] or b"", np.int32) for x in (left, right)]))
    absent = left["terms"] - len(columns)
    p = [shares(_dense(x, columns), np.array(x["totals"], np.int64)[:, None]) if left["terms"] else np.ones((len(x["groups"]), 0), np.int64) for x in (left, right)]
    none = [shares(np.zeros(1, np.int64), np.array(x["totals"], np.int64)) if left["terms"] else np.ones(len(x["groups"]), np.int64) for x in (left, right)]
    out = []
    for a, own in enumerate(left["groups"]):
        square = (p[0][a] - p[1]) ** 2
        square_none = (none[0][a] - none[1]) ** 2
        there = (square // p[1]).sum(axis=1) + absent * (square_none // none[1])
        back = (square // p[0][a]).sum(axis=1) + absent * (square_none // none[0][a])
        for b, other in enumerate(right["groups"]):
            if own != other:
                out.append((own, other, int(there[b])))
                if left["i"] != right["i"]:
                    out.append((other, own, int(back[b])))
    return out


def _cells(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    one, other = left.to_pylist()[0], right.to_pylist()[0]
    found = cell(one, other)
    return pa.table({"lang": [one["lang"]] * len(found), "a": [x[0] for x in found], "b": [x[1] for x in found], "part": [x[2] for x in found]}, schema)


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
    block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' with every other source of the language, part 'term' with the highest terms."""
    bounded_batches(docs.sparkSession)
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = written(terms.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "terms")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = counts.where("term is null").select("lang").distinct().join(of_lang, "lang", "left").na.fill(0, ["v", "lang_total"])
    langs = written(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")), "langs")

    # numbers of terms within their block, of groups within their language
    spread = terms.join(langs.select("lang", "blocks"), "lang").withColumn("k", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    number = (F.row_number().over(Window.partitionBy("lang", "k").orderBy("term")) - 1).alias("at")
    spread = written(spread.select("lang", "term", "lang_n", "k", number), "term-numbers")
    kept = written(counts.where("term is not null").join(spread, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = written(groups.join(langs, "lang").withColumn("i", F.floor(F.col("number") / block_groups).cast("int")), "groups")

    pairs = _pairs(kept, groups, spread, block_groups)
    named = groups.select("lang", F.col("number"), "source")
    pairs = pairs.join(named.toDF("lang", "a", "source"), ["lang", "a"]).join(named.toDF("lang", "b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    info = groups.select("lang", "source", (F.col("total") + F.col("v")).alias("of_group"), (F.col("lang_total") + F.col("v")).alias("of_lang"))
    p = kept.join(info, ["lang", "source"]).where("n > 0").withColumns({"p": share(F.col("n"), F.col("of_group")), "q": share(F.col("lang_n"), F.col("of_lang"))})
    best = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    best = best.withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(best)


def _pairs(kept: DataFrame, groups: DataFrame, spread: DataFrame, block_groups: int) -> DataFrame:
    """(lang, a, b, value) for all ordered pairs of different groups of a language, by cells."""
    member = groups.select("lang", "source", "number", "i")
    entries = kept.join(member, ["lang", "source"]).select("lang", "i", "k", "number", "at", "n")
    packed = entries.groupBy("lang", "i", "k").applyInArrow(_pack, "lang string, i int, k int, at binary, n binary, own binary")
    block = groups.groupBy("lang", "i", "blocks", "v").agg(F.sort_array(F.collect_list(F.struct("number", (F.col("total") + F.col("v")).alias("t")))).alias("g"))
    block = block.select("lang", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), F.col("g.number").alias("groups"), F.col("g.t").alias("totals"))
    sizes = spread.groupBy("lang", "k").agg(F.count("*").alias("terms"))
    slices = block.join(sizes, ["lang", "k"], "left").na.fill(0, ["terms"]).join(packed, ["lang", "i", "k"], "left")
    last = groups.groupBy("lang").agg(F.max("i").alias("last"))
    slices = written(slices.join(last, "lang"), "slices")
    left = slices.withColumn("row", F.col("i")).withColumn("column", F.explode(F.sequence("i", "last")))
    right = slices.withColumn("column", F.col("i")).withColumn("row", F.explode(F.sequence(F.lit(0), "i")))
    keys = ["lang", "row", "column", "k"]
    cells = left.drop("last").groupBy(*keys).cogroup(right.drop("last").groupBy(*keys)).applyInArrow(_cells, "lang string, a int, b int, part long")
    return cells.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of every source of each language from the others, and its highest terms."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs
), flat AS (SELECT row, lang, source, unnest(terms) AS term FROM docs
), vocabulary AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM flat GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM flat SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM vocabulary GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (w.n + 1) // (total + v) AS q
  FROM groups g JOIN vocabulary w ON g.lang = w.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), best AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM best QUALIFY rank <= 200
"""
