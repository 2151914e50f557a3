"""The entity and edge tables: row builders, lenient load, checks, upsert and rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphquarry.schemas import (
    DECAY_HALF_LIFE, EDGE, EDGE_KINDS, ENTITY, ENTITY_KINDS, EVIDENCE_COUNT,
)
from graphquarry.session import scratch_path


def _part(value: Column) -> Column:
    """A value that no other values joined by ``|`` can imitate; null is told from every text."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(F.concat(F.lit("="), escaped), F.lit("-"))


def entity_id(kind: Column, path: Column, name: Column, ordinal: Column | None = None) -> Column:
    """Deterministic id, so a rebuild or a re-run task yields the same graph.

    ``ordinal`` tells apart items of one kind, path and name.
    """
    number = F.lit("0") if ordinal is None else ordinal.cast("string")
    return F.sha2(F.concat_ws("|", _part(kind), _part(path), _part(name), number), 256)


def new_entities(rows: DataFrame, *keep: str) -> DataFrame:
    """Complete ``(kind, name, path, language)`` rows to entities, one for each row.

    Rows of one kind, path and name are numbered in the order of their ``line``, where there is one. ``keep`` names further columns to carry.
    """
    place = F.col("line") if "line" in rows.columns else F.lit(0)
    same = Window.partitionBy("kind", "path", "name").orderBy(place)
    numbered = rows.withColumn("ordinal_", F.row_number().over(same) - 1)
    return numbered.select(
        entity_id(F.col("kind"), F.col("path"), F.col("name"), F.col("ordinal_")).alias("id"),
        "kind", "name", "path", "language",
        F.lit("{}").alias("metadata"),
        F.current_timestamp().alias("last_indexed"),
        *keep,
    )


def new_edges(rows: DataFrame, *keep: str) -> DataFrame:
    """Complete ``(from_id, to_id, kind, confidence)`` rows to edges with constant evidence (S8). ``keep`` names further columns to carry."""
    return rows.select(
        "from_id", "to_id", "kind", F.col("confidence").cast("double").alias("confidence"),
        F.current_timestamp().alias("last_evidence"),
        F.lit(EVIDENCE_COUNT).alias("evidence_count"),
        F.lit(DECAY_HALF_LIFE).alias("decay_half_life"),
        F.array().cast("array<string>").alias("evidence"),
        *keep,
    )


def last_write_wins(writes: DataFrame, *seq: str) -> DataFrame:
    """One edge per ``(from_id, to_id, kind)``: the write with the greatest ``seq``.

    An arg-max aggregate, so repeated writes of one hot edge collapse before the shuffle.
    """
    key = ["from_id", "to_id", "kind"]
    rest = [c for c in writes.columns if c not in key and c not in seq]
    latest = F.max(F.struct(*seq, *rest)).alias("latest")
    return writes.groupBy(*key).agg(latest).select(*key, *[f"latest.{c}" for c in rest])


def lenient_entities(raw: DataFrame) -> DataFrame:
    """Unknown kinds become ``File``, unreadable metadata ``{}``, rows without a key drop."""
    metadata = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")).otherwise("{}")
    kind = F.when(F.col("kind").isin(*ENTITY_KINDS), F.col("kind")).otherwise("File")
    return raw.dropna(subset=["id", "kind", "name", "metadata"]).withColumns(
        {"kind": kind, "metadata": metadata}
    )


def _endpoints(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    return entities.select(F.col("id").alias("from_id")), entities.select(F.col("id").alias("to_id"))


def valid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of a known kind whose two endpoints exist."""
    starts, ends = _endpoints(entities)
    known = edges.where(F.col("kind").isin(*EDGE_KINDS))
    return known.join(starts, "from_id", "left_semi").join(ends, "to_id", "left_semi")


def dangling_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that miss at least one endpoint, with what is missing."""
    starts, ends = (side.withColumn(flag, F.lit(True)) for side, flag in
                    zip(_endpoints(entities), ("has_from", "has_to")))
    marked = edges.join(starts, "from_id", "left").join(ends, "to_id", "left")
    gap = (
        F.when(F.col("has_from").isNull() & F.col("has_to").isNull(), "both")
        .when(F.col("has_from").isNull(), "from")
        .when(F.col("has_to").isNull(), "to")
    )
    return marked.withColumn("missing", gap).where("missing IS NOT NULL").drop("has_from", "has_to")


def require_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Strict form of the check: fail when any edge dangles."""
    first = dangling_edges(edges, entities).limit(1).collect()
    if first:
        raise ValueError(f"entity not found for edge {first[0].asDict()}")
    return edges


def write_graph(entities: DataFrame, edges: DataFrame, root: str) -> None:
    """Replace both tables (S10); the new ones are complete before the old ones go.

    Edges are laid out by kind, so queries prune the others, and sorted by their start, so a
    lookup skips row groups. Rebalancing gives a kind with most of the edges many files and the
    rare kinds one, instead of a file per task and kind.
    """
    base = root.rstrip("/")
    fresh = scratch_path(entities.sparkSession, "graph")
    # as many tasks as compute the rows write them; they are laid out once, when they are read again
    entities.select(*ENTITY.names).write.parquet(f"{fresh}/entities")
    edges.select(*EDGE.names).write.parquet(f"{fresh}/edges")
    # both tables were computed before the first write, so inputs may lie under ``root``
    spark = entities.sparkSession
    spark.read.schema(ENTITY).parquet(f"{fresh}/entities").sortWithinPartitions("path").write.mode(
        "overwrite").parquet(f"{base}/entities")
    laid = spark.read.schema(EDGE).parquet(f"{fresh}/edges").hint("rebalance", "kind").sortWithinPartitions("kind", "from_id")
    laid.write.mode("overwrite").partitionBy("kind").parquet(f"{base}/edges")


def read_entities(spark: SparkSession, root: str) -> DataFrame:
    return lenient_entities(spark.read.schema(ENTITY).parquet(f"{root.rstrip('/')}/entities"))


def read_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edge table as stored; :func:`valid_edges` applies the load-time checks."""
    return spark.read.schema(EDGE).parquet(f"{root.rstrip('/')}/edges").select(*EDGE.names)


def upsert_edges(spark: SparkSession, root: str, writes: DataFrame, *seq: str) -> list[str]:
    """Merge edge ``writes`` into the stored edge table and return the kinds it rewrote.

    A write replaces the stored edge of its ``(from_id, to_id, kind)``; among writes of one edge the greatest ``seq`` stands.
    Edges are stored by kind, and only kinds that occur in the writes are read and overwritten: their new
    rows are complete in the scratch folder before the first old file goes, and other kinds' files stay as they are.
    Unknown kinds, null ends included, are an error, since no later reader would find them.
    """
    fresh = last_write_wins(new_edges(writes, *[c for c in seq if c not in EDGE.names]), *seq)
    held = scratch_path(spark, "upsert-writes")
    fresh.select(*EDGE.names).write.parquet(held)
    fresh = spark.read.schema(EDGE).parquet(held)
    touched = sorted(str(r["kind"]) for r in fresh.select("kind").distinct().limit(len(EDGE_KINDS) + 1).collect())
    unknown = [k for k in touched if k not in EDGE_KINDS]
    if unknown or not fresh.where("from_id IS NULL OR to_id IS NULL").isEmpty():
        raise ValueError(f"edges of unknown kinds or without an end: {unknown}")
    if not touched:
        return []
    base = f"{root.rstrip('/')}/edges"
    old = read_edges(spark, root).where(F.col("kind").isin(*touched))
    stay = old.join(fresh.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").select(*EDGE.names)
    merged = scratch_path(spark, "upsert-merged")
    stay.unionByName(fresh).hint("rebalance", "kind").write.parquet(merged)
    laid = spark.read.schema(EDGE).parquet(merged).hint("rebalance", "kind").sortWithinPartitions("kind", "from_id")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(base)
    return touched
