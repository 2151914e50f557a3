"""Connected components of a large undirected graph by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphquarry.llm.common import kept


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """One row (node, component) for every node of ``links``; the component is its smallest node.

    Each round every node moves to the neighbour, or itself, with the smallest hash under a seed of that
    round; links then join what nodes moved to, and links inside one node vanish. A constant share
    of nodes goes per round whatever the graph's shape, so rounds grow with the logarithm of its size.
    Moves are then applied from the last round back to the first. Every table between rounds is written
    to the shared folder; nothing is collected. Hubs are pre-aggregated, and the joins that carry
    their links read written tables, so adaptive execution can split them.

    Defined cases: null ends make no link; self links give a component of one; repeats count once.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    own = pairs.where("a = b").select(F.col("a").alias("node"))
    live = kept(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-links")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        seed = F.lit(len(moves))
        near = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        chosen = F.min(F.struct(F.xxhash64("to", seed).alias("rank"), "to"))
        kept_moves = kept(
            near.groupBy("node").agg(chosen.alias("best"))
            .select("node", F.when(F.xxhash64("node", seed) <= F.col("best.rank"), F.col("node")).otherwise(F.col("best.to")).alias("to")),
            "components-moves",
        )
        moves.append(kept_moves)
        first = kept_moves.select(F.col("node").alias("a"), F.col("to").alias("ma"))
        second = kept_moves.select(F.col("node").alias("b"), F.col("to").alias("mb"))
        moved = live.join(first, "a").join(second, "b").where("ma <> mb")
        live = kept(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "components-links")
    if not moves:
        return own.distinct().select("node", F.col("node").alias("component"))
    # where each node of a round ends: those that moved nowhere in the last round are their own end
    ends = moves[-1].select("node", F.col("to").alias("end"))
    for move in reversed(moves[:-1]):
        ends = kept(
            move.join(ends.select(F.col("node").alias("to"), "end"), "to", "left")
            .select("node", F.coalesce("end", "to").alias("end")),
            "components-ends",
        )
    named = kept(ends.groupBy("end").agg(F.min("node").alias("component")), "components-names")
    found = kept(ends, "components-ends").join(named, "end").select("node", "component")
    return found.unionByName(
        own.distinct().join(ends.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    )
