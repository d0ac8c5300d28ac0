"""Starting streams over folders and collecting what they wrote.

Results go to the shared folder as files, never to driver memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.session import scratch_path, write_through

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``ts`` as an instant, which watermarks need."""
    return as_instants(table_stream(spark, sf_dir, "events"))


def as_instants(events: DataFrame) -> DataFrame:
    """Read the zone-less ``ts`` as UTC, whatever the session's zone is."""
    return events.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def utc_text(instant: str) -> Column:
    """An instant as UTC text, the counterpart of ``as_instants``."""
    return F.date_format(F.to_utc_timestamp(F.col(instant), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all available input and read its output back."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return written_rows(spark, out, stream.schema)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, while a stream with it runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_staged(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Run the append stream that ``build`` makes over parts that arrive one after the other, each in files of its own.

    Between parts the stream stops and goes on from its checkpoint, as it would after a restart.
    """
    spark = parts[0].sparkSession
    folder, schema = scratch_path(spark, label), parts[0].schema
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part-{i}")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in/*"))
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return written_rows(spark, f"{folder}/out", stream.schema)


def run_updates(stream: DataFrame, label: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run an aggregation stream and read the last row of each key, with the ``epoch`` that wrote it.

    An epoch writes the whole keyed table: its own rows and those of the epoch before whose key has no new one. So what is read doesn't grow
    with the number of epochs, only with that of keys. A repeated epoch overwrites itself.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    latest = [-1]

    def merge(rows: DataFrame, epoch: int) -> None:
        new = write_through(rows.withColumn("epoch", F.lit(epoch).cast("long")), f"{label}-epoch")
        if epoch:
            before = spark.read.schema(schema).parquet(f"{out}/table-{epoch - 1}")
            new = new.unionByName(before.join(new.select(*keys), keys, "left_anti").select(*new.columns))
        new.write.mode("overwrite").parquet(f"{out}/table-{epoch}")
        latest[0] = epoch

    run_batches(stream, merge, f"{out}-state", mode)
    return written_rows(spark, f"{out}/table-{latest[0]}", schema)


def written_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a stream wrote; without any input it wrote nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
