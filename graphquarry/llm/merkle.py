"""Merkle manifest of a data set: a tree of digests per group, a tree over the groups' roots, and a proof per row.

Every row is a leaf, the digest of its length-prefixed fields. Within a group, leaves stand in a stated order; every
``arity`` consecutive nodes become one node above, until one is left, the group's subroot. Subroots, in the order of
their groups, become the root in the same way.

Each level is an equi-join of the nodes with themselves: a node looks up the places of its siblings, which its own
place gives (XOR 1 for two, offsets of the slot within the run otherwise), and the rows in slot zero emit the
parents. Then the paths run down: each level joins the paths of its parents, so a row ends with the siblings of all levels
without a join of all rows for each level. Keys of all these joins are unique on one side and held by at most
``arity`` rows on the other, so a group with a third of all rows is dealt out like any other.

Levels are written to the shared scratch folder and shrink by ``arity``; their number is the logarithm of the largest group.
A level is written by as many tasks as its rows need, whatever the number of shuffle partitions: every file costs an
executor writers and, on Hadoop's local file system, processes that set its mode.

Defined cases: a null field counts as ``-``, so null and empty differ; a null group comes first; a null order value
comes first within its group; rows that share it stand in the order of their digests, and equal rows next to each
other; a group of one row has that leaf as its subroot, one group's subroot is the root; an empty table gives no rows; extra
columns are ignored, and the names of the result never meet them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.llm.common import crc_of_id, kept, table
from graphquarry.operators.ordered import dense_index

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups whose first places are sent to every task; more of them are joined by key.
SENT_GROUPS = 100_000
#: Rows that one task writes of a level, so that small levels are not dealt out over a file per shuffle partition.
TASK_ROWS = 10_000
#: The parent's place of a node that stands alone at its level: the subroot itself.
TOP = -1

_PATH = "array<struct<left:string,right:string>>"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of fields in order, each as its UTF-8 byte count, a colon and its value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*map(part, fields))


def proof(path: Column) -> Column:
    """All sibling digests of a path, from the leaf's level up, left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings of a path give."""
    return F.aggregate(path, start, lambda done, p: digest(p["left"], done, p["right"]))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the digests of a node's run before and after it, joined."""
    slot = F.pmod(F.col("at"), F.lit(arity))
    out = nodes.withColumn("found", F.array().cast("array<struct<slot:bigint,digest:string>>"))
    for turn in range(1, arity):
        other = nodes.select(
            F.col("group"), F.col("at").alias("beside"), F.struct(slot.alias("slot"), F.col("digest")).alias("other")
        )
        place = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + F.pmod(slot + turn, F.lit(arity))
        found = F.when(F.col("other").isNull(), F.col("found")).otherwise(F.concat("found", F.array("other")))
        out = out.withColumn("beside", place).join(other, ["group", "beside"], "left").withColumn("found", found).drop("beside", "other")
    names = lambda test: F.array_join(F.transform(F.filter(F.array_sort("found"), test), lambda x: x["digest"]), "")
    return out.withColumns({"left": names(lambda x: x["slot"] < slot), "right": names(lambda x: x["slot"] > slot)}).drop("found")


def _rounds(count: int, arity: int) -> int:
    rounds = 0
    while count > 1:
        count = math.ceil(count / arity)
        rounds += 1
    return rounds


def _tasks(rows: int) -> int:
    return max(1, math.ceil(rows / TASK_ROWS))


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of every group's tree, from ``(group, at, n, digest, …)`` with places ``at`` from 0 and ``n`` rows in the group.

    Each level has ``left`` and ``right`` beside. A group is present up to the level on which it has one node.
    """
    most, rows, groups = nodes.agg(F.max("n"), F.count(F.lit(1)), F.count_if(F.col("at") == 0)).first()
    built = [kept(_siblings(nodes, arity).coalesce(_tasks(rows)), "merkle-level")]
    for k in range(1, 1 + _rounds(most or 0, arity)):
        first = (F.pmod(F.col("at"), F.lit(arity)) == 0) & (F.col("n") > 1)
        parents = built[-1].where(first).select(
            "group", F.floor(F.col("at") / arity).alias("at"), F.ceil(F.col("n") / arity).alias("n"),
            digest(F.col("digest"), F.col("right")).alias("digest"),
        )
        # at most one node of a group is not from a full run
        built.append(kept(_siblings(parents, arity).coalesce(_tasks(rows // arity**k + groups)), "merkle-level"))
    return built


def subroots(built: list[DataFrame]) -> DataFrame:
    """``(group, level, digest)``: the one node each group ends with."""
    tops = [level.where("n = 1").select("group", F.lit(k).alias("level"), "digest") for k, level in enumerate(built)]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def paths(built: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The lowest level's rows with ``path``, and the other columns of their group's row in ``tops``.

    ``tops`` is ``(group, level, path, …)``: where each group's tree ends and the path from there on.
    """
    carried = [c for c in tops.columns if c not in ("level", "group", "path")]
    above: DataFrame | None = None
    for k in reversed(range(len(built))):
        ended = tops.where(F.col("level") == k).select("group", F.lit(TOP).cast("long").alias("parent"), "path", *carried)
        parents = ended if above is None else above.select("group", F.col("at").alias("parent"), "path", *carried).unionByName(ended)
        alone = F.col("n") == 1
        own = F.array(F.struct("left", "right"))
        rows = built[k] if k == 0 else built[k].select("group", "at", "n", "left", "right")
        above = (
            rows.withColumn("parent", F.when(alone, F.lit(TOP).cast("long")).otherwise(F.floor(F.col("at") / arity)))
            .join(parents, ["group", "parent"])
            .withColumn("path", F.when(alone, F.col("path")).otherwise(F.concat(own, "path")))
            .drop("parent", "left", "right", "n")
        )
    return above


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``at``, the 0-based place within ``group``, and ``n``, the rows of the group.

    All groups are sorted together, by ranges of (group, order); a place counts from the group's first.
    """
    sorted_rows = dense_index(rows, [F.asc("group"), *order], "place")
    starts = kept(sorted_rows.groupBy("group").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    sent = F.broadcast(starts) if starts.count() <= SENT_GROUPS else starts
    return sorted_rows.join(sent, "group").withColumn("at", F.col("place") - F.col("start")).drop("place", "start")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = ARITY,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """``(order, group, leaf, subroot, root, path)`` of every row, and ``carried`` columns computed from the row.

    ``path`` holds, level by level from the leaf to the root, the joined digests left and right of the row's node.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of at least 2")
    carried = carried or {}
    # every group as text that sorts as asked: null first, then by bytes
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(
        name.alias("group"), F.col(order).alias("order"), F.col(group).alias("named"),
        leaf([F.col(f) for f in fields]).alias("digest"), F.struct(*[c.alias(k) for k, c in carried.items()] or [F.lit(0)]).alias("carried"),
    )
    built = levels(_placed(rows, [F.asc("order"), F.asc("digest")]), arity)
    ended = kept(subroots(built), "merkle-subroots")
    upper = levels(
        dense_index(ended.select(F.col("group").alias("name"), "digest", "level"), [F.asc("name")], "at")
        .select(F.lit("").alias("group"), "at", F.lit(ended.count()).alias("n"), "digest", F.struct("name", F.col("level").alias("tier")).alias("below")),
        arity,
    )
    roots = [r["digest"] for r in subroots(upper).collect()]  # one, or none for an empty table
    over = paths(upper, subroots(upper).select("group", "level", F.array().cast(_PATH).alias("path")), arity)
    tops = kept(
        over.select(F.col("below.name").alias("group"), F.col("below.tier").alias("level"), "path", F.col("digest").alias("subroot")),
        "merkle-tops",
    )
    found = paths(built, tops, arity).coalesce(_tasks(built[0].count()))
    return found.select(
        F.col("order").alias(order), F.col("named").alias(group), F.col("digest").alias("leaf"), "subroot",
        F.lit(roots[0] if roots else None).cast("string").alias("root"), "path", *[F.col(f"carried.{k}").alias(k) for k in carried],
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    cut = F.when(F.pmod(crc_of_id(), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    altered = leaf([cut if f == "text" else F.col(f) for f in FIELDS])
    found = manifest(docs, carried={"altered": altered})
    return found.withColumn("folded_root", fold(F.col("altered"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
