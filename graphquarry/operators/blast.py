"""Blast radius: breadth-first reach to any depth, for many start nodes at once.

The structural edges are written once as an adjacency table, clustered by node, and every hop reads that.
Each hop is one join of the frontier with the adjacency, one aggregate that leaves a single row
per (source, node), and one anti join with what was reached before. Frontier and visited nodes are tables in
the shared scratch folder, so plans stay short and lost executors only cost the current hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.operators.resolve import path_index
from graphquarry.schemas import DEFAULT_DEPTH, STRUCTURAL_KINDS
from graphquarry.session import stored

HUB_EDGES = 50_000
BROADCAST_ROWS = 100_000


def adjacency(edges: DataFrame, direction: str = "both", kinds: tuple[str, ...] = STRUCTURAL_KINDS) -> DataFrame:
    """``(node, next, rank)`` of the given kinds.

    ``rank`` orders the edges that may discover a node: outgoing before incoming, then by kind.
    """
    place = (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).cast("int")
    used = edges.where(F.col("kind").isin(*kinds)).select("from_id", "to_id", place.alias("rank"))
    out = F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("next"), "rank")
    back = F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("next"),
                    (F.col("rank") + len(kinds)).cast("int").alias("rank"))
    ways = {"out": [out], "in": [back], "both": [out, back]}[direction]
    return used.select(F.explode(F.array(*ways)).alias("way")).select("way.*")


def rank_kind(rank: Column, kinds: tuple[str, ...] = STRUCTURAL_KINDS) -> Column:
    return F.get(F.array(*map(F.lit, kinds)), rank % len(kinds))


class Adjacency:
    """The stored adjacency of a graph and its hubs, prepared once and used by any number of traversals.

    The edges of a hub are cut into hashed chunks. A frontier row at a hub meets every chunk under its own
    join key, so a node holding a third of all edges is worked on by many tasks.
    """

    def __init__(self, edges: DataFrame, direction: str = "both", kinds: tuple[str, ...] = STRUCTURAL_KINDS,
                 hub_edges: int = HUB_EDGES):
        self.direction = direction
        plain = stored(adjacency(edges, direction, kinds), "adjacency")
        hubs = stored(
            plain.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges)
            .select("node", F.ceil(F.col("n") / hub_edges).cast("int").alias("chunks")),
            "adjacency-hubs",
        )
        self.hubs = None if hubs.isEmpty() else hubs
        chunk = F.lit(0)
        if self.hubs is not None:
            plain = plain.join(hubs, "node", "left")
            chunk = F.pmod(F.xxhash64("next"), F.coalesce("chunks", F.lit(1))).cast("int")
        # sorted by node within files, so that a small frontier skips most row groups
        laid = plain.select("node", "next", "rank", chunk.alias("chunk")).repartition("node", "chunk").sortWithinPartitions("node")
        self.edges = stored(laid, "adjacency")

    def meet(self, step: DataFrame, small: bool) -> DataFrame:
        """Frontier rows with the edges at their node, hub rows once per chunk."""
        if small:
            return F.broadcast(step).join(self.edges, "node")
        if self.hubs is None:
            return step.join(self.edges, "node")
        last = F.coalesce("chunks", F.lit(1)) - 1
        dealt = step.join(self.hubs, "node", "left").select(
            "source", "node", "max_depth", F.explode(F.sequence(F.lit(0), last)).alias("chunk")
        )
        return dealt.join(self.edges, ["node", "chunk"])


def reach(
    starts: DataFrame,
    edges: DataFrame | Adjacency,
    direction: str = "both",
    kinds: tuple[str, ...] = STRUCTURAL_KINDS,
    hub_edges: int = HUB_EDGES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(source, node, depth, rank)`` of all nodes within reach, the start left out.

    ``starts`` holds ``(source, max_depth)``, one row per source; a null depth is unbounded. A prepared
    :class:`Adjacency` is used as it is. A frontier counted at ``broadcast_rows`` or fewer is sent to
    the edges, which then stay where they are; a larger one meets them in a shuffle join.
    """
    graph = edges if isinstance(edges, Adjacency) else Adjacency(edges, direction, kinds, hub_edges)
    frontier = stored(starts.select(
        "source", F.col("source").alias("node"), F.col("max_depth").cast("int").alias("max_depth"),
        F.lit(0).alias("depth"), F.lit(None).cast("int").alias("rank"),
    ), "reach-level")
    levels = [frontier]
    depth = 0
    while True:
        depth += 1
        step = frontier.where((F.col("max_depth") >= depth) | F.col("max_depth").isNull()).select("source", "node", "max_depth")
        size = step.count()
        if size == 0:
            break
        found = graph.meet(step, size <= broadcast_rows).groupBy("source", F.col("next").alias("node")).agg(
            F.max("max_depth").alias("max_depth"), F.lit(depth).alias("depth"), F.min("rank").alias("rank")
        )
        # Over undirected edges a hop can only return to the last two levels.
        seen = levels[-2:] if graph.direction == "both" else levels
        before = reduce(DataFrame.unionByName, [level.select("source", "node") for level in seen])
        frontier = stored(found.join(before, ["source", "node"], "left_anti"), "reach-level")
        levels.append(frontier)
    reached = levels[1] if len(levels) > 1 else levels[0].limit(0)
    for level in levels[2:]:
        reached = reached.unionByName(level)
    return reached.select("source", "node", "depth", "rank")


def blast_radius(
    wanted: DataFrame, edges: DataFrame | Adjacency, entities: DataFrame, max_depth: int | None = DEFAULT_DEPTH
) -> DataFrame:
    """Reach of each path in ``wanted`` over structural edges in both directions.

    ``wanted`` has ``path`` and optionally its own ``depth``; ``max_depth`` holds for the others, and None is
    unbounded. Unknown paths yield nothing. Result: ``(source_path, id, kind, name, path, depth, edge_kind)``.
    """
    own = F.col("depth") if "depth" in wanted.columns else F.lit(max_depth).cast("int")
    asked = wanted.where("path IS NOT NULL").select("path", own.alias("max_depth")).groupBy("path").agg(
        F.when(F.count("max_depth") == F.count(F.lit(1)), F.max("max_depth")).alias("max_depth")
    )
    known = path_index(entities.join(asked.select("path"), "path", "left_semi")).select("path", "id")
    starts = asked.join(known, "path").select(F.col("id").alias("source"), "max_depth", "path")
    starts = stored(starts, "blast-starts")
    found = reach(starts, edges, "both")
    return (
        found.join(starts.select("source", F.col("path").alias("source_path")), "source")
        .join(entities.select(F.col("id").alias("node"), "kind", "name", "path"), "node")
        .select("source_path", F.col("node").alias("id"), "kind", "name", "path", "depth",
                rank_kind(F.col("rank")).alias("edge_kind"))
    )
