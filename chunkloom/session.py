"""Session settings, the shared scratch folder and input spreading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs below this many bytes per core are spread over all cores by a key hash.
# Larger ones split by themselves when scanned, so they are never shuffled for it.
SPREAD_BYTES_PER_CORE = 8 * 1024 * 1024


def build_session(
    app: str = "chunkloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else the folder given to the context
    with ``setCheckpointDir``, else a folder below the session's warehouse, which executors share too."""
    key = "spark.checkpoint.dir"
    configured = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if configured.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{configured} may be a folder of one machine: set spark.checkpoint.dir to a folder that all machines share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the
    rows outlive the executors that made them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan (the file sizes)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for an input too small to split; leave any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan_bytes(df) < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores, *keys)
    return df
