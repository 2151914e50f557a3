"""What several operators share: tables, scratch tables and slices of text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphquarry.session import scratch_path

SLICE_BYTES = 1 << 20
#: Rows per Arrow batch, and per batch of the Parquet reader.
BATCH_CONFS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
BATCH_ROWS = 1000
LOWEST_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's rows per batch, of Arrow and of the Parquet reader, to ``BATCH_ROWS``, unless they are lower already.

    The defaults of 10,000 and 4,096 rows suit numbers; as many texts, pairs of them or token lists fill the memory of
    Python workers and of the JVM. The settings are read when a query is planned, so they have to outlast the call.
    """
    conf = df.sparkSession.conf
    for name in BATCH_CONFS:
        if not 0 < int(conf.get(name)) <= BATCH_ROWS:
            conf.set(name, str(BATCH_ROWS))


def kept(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again.

    The copy has columns to prune, statistics to plan with, and outlives lost executors. ``codec`` compresses it,
    by default the session's; texts and token lists take a fifth to a quarter less as ``zstd`` than as ``snappy``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns an operator is about to add: the operator's own columns win."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes | None]]:
    """Cut a batch of texts into lists of UTF-8 bytes of about ``limit`` bytes; nulls stay null.

    A text longer than the limit is a list of its own, so memory follows the longest text, not the
    number of rows in a batch.
    """
    held: list[bytes | None] = []
    size = 0
    for value in texts.cast(pa.binary()):
        data = value.as_py()
        held.append(data)
        size += len(data) if data else 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
