"""Lineage cuts through the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes a task reads at most of files and of a shuffle, as far as row groups and single keys allow.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 64 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}
INITIAL_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INITIAL_PARTITIONS = 200
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever picked for a local master; a cluster without the
    setting is an error, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    named = named or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="graphquarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bounded_tasks(spark: SparkSession) -> None:
    """Lower what one task reads in this session to ``TASK_BYTES``, unless it is lower already.

    Hash tables and sorts hold a multiple of what a task reads. Spark's defaults, 128 MB of files and 64 MB of a shuffle,
    let that grow up to gigabytes. A shuffle begins with partitions enough to be dealt out by size.
    The settings are read when a query runs, so they have to outlast the call.
    """
    for name, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    if int(spark.conf.get(INITIAL_CONF, None) or spark.conf.get("spark.sql.shuffle.partitions")) < INITIAL_PARTITIONS:
        spark.conf.set(INITIAL_CONF, str(INITIAL_PARTITIONS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so loops keep short plans and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files. Else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later readers prune columns, push filters down
    and plan with its size, which a row-wise checkpoint does not offer. The shuffles behind it go once it is complete."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables written between jobs."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
