"""Ordered operators that keep no unbounded group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphquarry.session import stored

FILL_CHUNK = 1 << 17
#: Buckets in which rows are counted to find heavy keys.
KEY_BUCKETS = 1 << 16
#: Heavy keys sent to all tasks at most.
SENT_KEYS = 100_000


def heavy_keys(df: DataFrame, key: str, most: int, buckets: int = KEY_BUCKETS) -> DataFrame | None:
    """The keys of more than ``most`` rows, or None if there are none.

    Rows are counted by hashed bucket first, at most ``buckets`` numbers a task; a bucket of at most ``most`` rows has no such
    key, so that only the keys of fuller ones are counted by themselves.
    """
    counts = df.select(key, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket_"))
    more = F.col("n_") > most
    full = stored(counts.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_")).where(more).select("bucket_"), "heavy-buckets")
    if full.isEmpty():
        return None
    among = counts.join(F.broadcast(full), "bucket_", "left_semi")
    heavy = stored(among.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where(more).select(key), "heavy-keys")
    return None if heavy.isEmpty() else heavy


def split_heavy(df: DataFrame, key: str, heavy: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of other keys and those of the heavy ones; rows without a key are among the others."""
    if heavy is None:
        return df, None
    sent = F.broadcast(heavy) if heavy.count() <= SENT_KEYS else heavy
    return df.join(sent, key, "left_anti"), df.join(sent, key, "left_semi")


def filled_parts(
    df: DataFrame, group: str, pos: str, columns: list[str], chunk: int = FILL_CHUNK, sized: DataFrame | None = None
) -> list[DataFrame]:
    """:func:`fill_forward` in parts that share no group: usually one, dealt out by group alone.

    An aggregate over the group and more columns needs no further shuffle of that part. Groups of more than ``chunk`` rows
    are the other part, which is cut into chunks. ``sized`` may give a table of the same rows or more that is cheaper to count.
    """
    light, long = split_heavy(df, group, heavy_keys(df if sized is None else sized, group, chunk))
    # rows without a position are filled among themselves
    inside = Window.partitionBy(group, F.isnull(pos)).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    parts = [light.repartition(group).withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})]
    if long is not None:
        parts.append(_filled_chunks(long, group, pos, columns, chunk))
    return parts


def fill_forward(
    df: DataFrame, group: str, pos: str, columns: list[str], chunk: int = FILL_CHUNK
) -> DataFrame:
    """Replace nulls in ``columns`` by the last value before them in ``pos`` order.

    A group of at most ``chunk`` rows is sorted in one task, a longer one is cut into position chunks.
    """
    return reduce(DataFrame.unionByName, [part.select(df.columns) for part in filled_parts(df, group, pos, columns, chunk)])


def _filled_chunks(df: DataFrame, group: str, pos: str, columns: list[str], chunk: int) -> DataFrame:
    """What a chunk starts with comes from one aggregate row per chunk, the last value in each, filled across chunks; rows then
    fill within their chunk from there. The longest sort any task sees is one chunk, or one row per chunk of a group."""
    keyed = stored(df.withColumn("chunk_", F.floor(F.col(pos) / chunk)), "fill-rows")
    before = Window.partitionBy(group).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    ends = keyed.groupBy(group, "chunk_").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in columns]
    )
    starts = stored(
        ends.select(group, "chunk_", *[F.last(c, ignorenulls=True).over(before).alias(f"{c}_start_") for c in columns])
        .where(" OR ".join(f"{c}_start_ IS NOT NULL" for c in columns)),
        "fill-starts",
    )
    inside = Window.partitionBy(group, "chunk_").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    if starts.isEmpty():
        return local.drop("chunk_")
    filled = local.join(starts, [group, "chunk_"], "left")
    return filled.withColumns({c: F.coalesce(c, f"{c}_start_") for c in columns}).drop(
        "chunk_", *[f"{c}_start_" for c in columns]
    )


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based index in the given total order without a global window.

    The rows are range-partitioned and sorted, then kept, because a second sampling could draw
    other range bounds. Offsets come from one count per partition: a table as long as the number
    of shuffle partitions.
    """
    ordered = stored(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "dense-index")
    part = F.shiftright("at_", 33).alias("part_")
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    position = F.col("at_").bitwiseAND((1 << 33) - 1) + F.col("offset_")
    return (
        ordered.withColumn("part_", part)
        .join(F.broadcast(offsets), "part_")
        .withColumn(name, position)
        .drop("at_", "part_", "offset_")
    )


def rank_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add a 1-based rank inside each group, in a total order.

    One sort over group and order ranks all groups together, so a group holding a third of all
    rows is sorted by many tasks; each group then counts from its own first position.
    """
    placed = stored(dense_index(df, [F.asc(group), *order], "place_"), "rank-places")
    starts = stored(placed.groupBy(group).agg(F.min("place_").alias("start_")), "rank-starts")
    rank = (F.col("place_") - F.col("start_") + 1).alias(name)
    return placed.join(starts, group).select(*df.columns, rank)
