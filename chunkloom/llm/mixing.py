"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Sources weigh ``weights``, dealt in turn in the order of their names, and share the words of the whole corpus by weight. A source gives
at most ``most`` times its own words; what it cannot give is shared by weight among the others. Which sources stop is
read off prefix sums over the sources in the order of (most words / weight): a source stops if what is left at its place offers it
as much as it has.

Documents get a hash-random key and are sorted by range over (source, key), so a hot source is split by the keys. Each task adds up its
range; the ends of the ranges, one row for each shuffle partition, give the words before any document. A source's budget is
its target rounded to a whole word. It takes all of its documents as often as the budget holds them, then the documents of
one more pass up to the budget; the document at the cut gives its first words only. Keys depend on ``seed`` and the id, so reruns agree.

Defined results: null texts have size 0 and empty ones too, and give nothing; a null source is a source of its own, the last in
order; rows that repeat an id count each and stand side by side in the order; null ids share one key. If no text has a word, targets are 0.
An empty table gives no rows. Other columns aren't read by ``mix_plan`` and are passed on by ``mixed``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, table, utf8, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"

_GAPS = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = bytes(0 if i in _GAPS else 1 for i in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Columns of the order inside a source.
PLACE = ["mix_key", "mix_id", "size", "mix_digest"]


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of each text: what stands between the characters 0x20 and 0x09 to 0x0D."""
    return pa.array([(b"\0" + t.translate(_IS_WORD)).count(b"\0\1") for t in utf8(texts)], pa.int64())


@F.arrow_udf(T.StringType())
def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """Each text up to the end of its ``counts``-th word."""
    out = []
    for text, n in zip(utf8(texts), counts.to_pylist(), strict=True):
        end = next((m.end() for m in islice(_WORD.finditer(text), max(n - 1, 0), None)), len(text)) if n else 0
        out.append(text[:end].decode())
    return pa.array(out, pa.string())


def running(df: DataFrame, order: list[str], values: list[str], label: str) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of each (non-negative, whole) value over all rows that stand earlier in ``order``.

    Rows are dealt by range and sorted; a task adds up its range. The only rows that meet in one place are the ends of the ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), *[T.StructField(f"before_{v}", T.LongType()) for v in values]])
    names = [f.name for f in schema.fields]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in batches:
            columns = [*b.columns, pa.array(np.full(len(b), part, np.int32))]
            for v in values:
                amounts = b[v].to_numpy()
                ends = np.cumsum(amounts) + total[v]
                columns.append(pa.array(ends - amounts))
                if len(ends):
                    total[v] = int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    inside = written(ranged.mapInArrow(add_up, schema), label)
    ends = inside.groupBy("__part").agg(*[F.max(F.col(f"before_{v}") + F.col(v)).alias(f"__{v}") for v in values])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shuffle partition: bounded whatever the data
    starts = ends.select("__part", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    whole = inside.join(F.broadcast(starts), "__part")
    return whole.select(*df.columns, *[(F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values])


def _dealt(weights: tuple[int, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of (source, no_source, size), a row for each source: also start (words of the sources before it), target, epochs and rest.

    ``epochs`` whole passes and ``rest`` words of one more make up the budget, the target rounded.
    """
    placed = running(sizes.withColumn("one", F.lit(1).cast("long")), ["no_source", "source"], ["one", "size"], "sources")
    bound = placed.select(
        "source", "no_source", "size", F.col("before_size").alias("start"), F.col("before_one").alias("place"),
        _dealt(weights, F.col("before_one")).alias("weight"), (F.col("size") * most).alias("limit"),
    )
    # limit / weight in whole numbers
    bound = bound.withColumn("ratio", F.expr(f"limit * ({math.lcm(*weights)} div weight)"))
    bound = running(bound, ["ratio", "place"], ["limit", "weight"], "limits")
    whole = bound.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left = F.lit(whole["size"]) - F.col("before_limit")
    weight_left = F.lit(whole["weight"]) - F.col("before_weight")
    exact = "decimal(38,0)"
    stops = left.cast(exact) * F.col("weight") >= F.col("limit").cast(exact) * weight_left
    stopped = written(bound.withColumn("stops", stops), "stops")
    given = stopped.agg(
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))), F.lit(0)).alias("weight"),
    ).first()
    share = F.lit(float(whole["size"] - given["words"])) * F.col("weight") / F.lit(float(max(given["weight"], 1)))
    out = stopped.withColumn("target", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(share))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("limit"))
    out = out.withColumn("budget", budget).withColumn("epochs", F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(0))
    return out.select("source", "no_source", "size", "start", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("size")).alias("rest"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return [
        F.col(source_col).cast("string").alias("mix_source"), F.col(source_col).isNull().alias("no_source"),
        F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 16).alias("mix_key"), F.col(id_col).cast("long").alias("mix_id"),
        word_count(F.coalesce(F.col(text_col), F.lit(""))).alias("size"), F.xxhash64(text_col).alias("mix_digest"),
    ]


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """A row for each document: mix_source, no_source, the columns of ``PLACE``, source_size, target, epochs, rest, before (words of its source before
    it in the mix's order) and taken, the words that the mix takes of it."""
    bounded_batches(docs.sparkSession)
    rows = written(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)), "mix-rows")
    sizes = rows.groupBy("mix_source", "no_source").agg(F.sum("size").alias("size")).withColumnRenamed("mix_source", "source")
    targets = written(source_targets(written(sizes, "mix-sources"), weights, most), "mix-targets")
    placed = running(rows, ["no_source", "mix_source", *PLACE], ["size"], "mix-order")
    targets = targets.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "start", "target", "epochs", "rest")
    out = placed.join(targets, placed["mix_source"].eqNullSafe(targets["of"])).withColumn("before", F.col("before_size") - F.col("start"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    out = out.withColumn("taken", F.col("epochs") * F.col("size") + last)
    return out.select("mix_source", "no_source", *PLACE, "source_size", "target", "epochs", "rest", "before", "taken")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the number of the pass as ``mix_epoch``; the texts at the cuts end there.

    Texts aren't shuffled: a row is held against its source's cut only. Rows that are alike in all columns of the order and stand at the cut share it one after the other.
    """
    plan = written(mix_plan(docs, id_col, text_col, source_col, weights, most, seed), "mix-plan")
    at_cut = plan.where("size > 0 and before <= rest and rest < before + size")
    cuts = at_cut.select(F.col("mix_source").alias("of"), *[F.col(c).alias(f"cut_{c}") for c in PLACE], F.col("rest").alias("cut_rest"))
    alike = plan.join(cuts, plan["mix_source"].eqNullSafe(cuts["of"]) & _same_place())
    first = alike.groupBy("of").agg(F.min("before").alias("cut_before"))
    sources = plan.groupBy("mix_source").agg(F.max("epochs").alias("mix_epochs")).withColumnRenamed("mix_source", "name")
    cuts = cuts.join(first.withColumnRenamed("of", "same"), F.col("of").eqNullSafe(F.col("same"))).drop("same")
    info = sources.join(cuts, sources["name"].eqNullSafe(cuts["of"]), "left").withColumn("has_cut", F.col("cut_size").isNotNull()).drop("of")
    info = written(info, "mix-cuts")
    keys = _keyed(docs, id_col, text_col, source_col, seed)
    rows = docs.withColumns({f"__{i}": k for i, k in enumerate(keys)}).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        *[F.col(f"__{i}").alias(n) for i, n in enumerate(["mix_source", "no_source", *PLACE])],
    )
    rows = rows.join(info, rows["mix_source"].eqNullSafe(info["name"]))
    # nulls are smallest in the order, as in a sort; a source without a cut has no row before or at it
    place, cut = F.struct(*PLACE), F.struct(*[F.col(f"cut_{c}").alias(c) for c in PLACE])
    rows = rows.withColumn("at", F.col("has_cut") & place.eqNullSafe(cut)).withColumn("under", F.col("has_cut") & (place < cut))
    beside = rows.where(~F.col("at")).withColumn("words", F.when(F.col("under"), F.col("size")).otherwise(0))
    number = F.row_number().over(Window.partitionBy("mix_source").orderBy("mix_key")) - 1
    within = rows.where("at").withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_rest") - F.col("cut_before") - number * F.col("size"))))
    both = beside.unionByName(within).where("size > 0")
    passes = F.col("mix_epochs") + F.when(F.col("words") > 0, 1).otherwise(0)
    out = both.withColumn("passes", passes).where("passes > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    cut_here = (F.col("mix_epoch") > F.col("mix_epochs")) & (F.col("words") < F.col("size"))
    whole = out.where(~cut_here).select("doc.*", "mix_epoch")
    ended = out.where(cut_here).withColumn("doc", F.col("doc").withField(text_col, first_words(F.col(f"doc.{text_col}"), F.col("words")))).select("doc.*", "mix_epoch")
    return whole.unionByName(ended)


def _same_place() -> Column:
    same = F.lit(True)
    for c in PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"cut_{c}"))
    return same


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_plan(table(spark, sf_dir, "documents")).select(F.col("mix_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:16] AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS most,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM sources
  WINDOW earlier AS (ORDER BY 30 * source_size // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, words_left * weight >= most * weight_left AS stops FROM ordered
), given AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) FILTER (stops) OVER (), 0) AS shared,
         greatest(coalesce(sum(weight) FILTER (NOT stops) OVER (), 0), 1) AS shared_weight
  FROM stopped
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN most::DOUBLE ELSE shared::DOUBLE * weight / shared_weight::DOUBLE END AS target, most FROM given
), budgets AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, most) AS budget,
         CASE WHEN source_size > 0 THEN least(floor(target + 0.5)::BIGINT, most) // source_size ELSE 0 END AS epochs
  FROM targets
), placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
