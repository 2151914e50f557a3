"""Graph questions as a table: validation and answers for any number of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.operators import blast, neighbors, resolve
from graphquarry.operators.ordered import dense_index
from graphquarry.schemas import DEFAULT_DEPTH, DEFAULT_LIMIT, STRUCTURAL_KINDS
from graphquarry.session import stored

# The tools and the texts their answers use.
TOOLS = ("blast_radius", "dependencies", "co_changes", "who_owns", "hotspots")
ONE_HOP = ("dependencies", "co_changes", "who_owns")
TOO_LARGE = "Request too large"
BAD_JSON = "Invalid JSON in request"
NO_ENTITY = "missing required param: entity"
HAS_DOTS = "entity path must not contain '..'"

#: Ranks one row of a hotspot request unfolds to at a time.
RANKS = 4096
#: Hotspot rows one task makes, about.
TASK_ROWS = 1_000_000

#: A request with one thing it found; ``hit`` is null where it found nothing.
NEAR = ("request_id", "tool", "entity", "direction", "id", "hit", "there", "result", "detail", "value")

JSON_REQUEST = (
    "id STRING, method STRING, params STRUCT<name: STRING, arguments: "
    "STRUCT<entity: STRING, depth: BIGINT, direction: STRING, limit: BIGINT>>"
)


@dataclass(frozen=True)
class Bounds:
    """What a service refuses; all off by default. A request beyond a bound gets an error row that names it."""

    depth: int | None = None
    limit: int | None = None
    entity_bytes: int | None = None
    request_bytes: int | None = None


def _over(value: Column, bound: int | None) -> Column:
    return F.lit(False) if bound is None else value > bound


def decode_requests(lines: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """JSON request lines (column ``value``) to request rows; blank lines are skipped.

    A tool name may carry a prefix ending in ``_``. Unreadable or oversized lines keep their
    reason in ``decode_error``.
    """
    line = F.trim("value")
    call = F.from_json(F.when(~_over(F.octet_length(line), bounds.request_bytes), line), JSON_REQUEST)
    rows = lines.where(F.length(line) > 0).select(line.alias("line"), call.alias("r"))
    known = F.regexp_extract("r.params.name", rf"(?:^|_)({'|'.join(TOOLS)})$", 1)
    return rows.select(
        F.col("r.id").alias("request_id"),
        F.when(known != "", known).otherwise(F.col("r.params.name")).alias("tool"),
        "r.params.arguments.entity", "r.params.arguments.depth",
        "r.params.arguments.direction", "r.params.arguments.limit",
        F.when(_over(F.octet_length("line"), bounds.request_bytes), TOO_LARGE)
        .when(F.try_parse_json("line").isNull(), BAD_JSON).alias("decode_error"),
    )


def _asked_for(value: Column, default: int) -> Column:
    return F.when(value >= 0, value).otherwise(default).cast("long")


def validated(requests: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Apply defaults, and give ``error`` where a request cannot be answered."""
    tool, entity = F.coalesce("tool", F.lit("")), F.col("entity")
    needs_entity = tool != "hotspots"
    earlier = F.col("decode_error") if "decode_error" in requests.columns else F.lit(None).cast("string")
    error = (
        F.when(earlier.isNotNull(), earlier)
        .when(~tool.isin(*TOOLS), F.concat(F.lit("Unknown tool: "), tool))
        .when(needs_entity & entity.isNull(), NO_ENTITY)
        .when(needs_entity & _over(F.octet_length(entity), bounds.entity_bytes), f"entity path too long (max {bounds.entity_bytes} chars)")
        .when(needs_entity & F.contains(entity, F.lit("..")), HAS_DOTS)
        .when((tool == "blast_radius") & _over(F.col("depth"), bounds.depth), f"depth too large (max {bounds.depth})")
        .when((tool == "hotspots") & _over(F.col("limit"), bounds.limit), f"limit too large (max {bounds.limit})")
    )
    return requests.select(
        "request_id", "tool", "entity",
        _asked_for(F.col("depth"), DEFAULT_DEPTH).alias("depth"),
        F.coalesce("direction", F.lit("downstream")).alias("direction"),
        _asked_for(F.col("limit"), DEFAULT_LIMIT).alias("limit"),
        error.alias("error"),
    )


def one_hop_edges(edges: DataFrame) -> DataFrame:
    """``(tool, id, far, out, edge_kind, confidence)``: every edge from each end that a one-hop tool asks about."""
    group = F.when(F.col("kind").isin(*STRUCTURAL_KINDS), "dependencies").when(
        F.col("kind") == "co_changes_with", "co_changes").when(F.col("kind") == "owned_by", "who_owns")
    used = edges.where(F.col("kind").isin(*STRUCTURAL_KINDS, "co_changes_with", "owned_by"))

    def way(rows: DataFrame, near: str, far: str, out: bool) -> DataFrame:
        return rows.select(
            group.alias("tool"), F.col(near).alias("id"), F.col(far).alias("far"), F.lit(out).alias("out"),
            F.col("kind").alias("edge_kind"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        )

    # most edges are asked one way only, so only the structural ones are read again, and no row passes an explode
    return way(used, "from_id", "to_id", True).unionByName(way(neighbors.structural(used), "to_id", "from_id", False))


def _outgoing() -> Column:
    return (F.col("tool") != "dependencies") | (F.col("direction") != "upstream")


def _described(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Found rows with what the entity ``far`` is; ``there`` is null where the graph has none.

    Answers repeat what is found for every request that asks for it, so the far end is looked up before they do.
    """
    far = entities.select(F.col("id").alias("far"), F.col("kind").alias("far_kind"), "name", "path", F.lit(True).alias("there"))
    return found.join(far, "far", "left").withColumn("hit", F.col("far").isNotNull())


def _one_hop(asked: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies, co-changes and owners in one join on (tool, entity, direction).

    Equal questions are asked once; requests without an entity keep out of the join, where their
    missing keys would meet in one task.
    """
    hops = one_hop_edges(edges)
    calls = asked.where(F.col("tool").isin(*ONE_HOP)).withColumn("out", _outgoing())
    questions = stored(calls.where("id IS NOT NULL").select("tool", "id", "out").distinct(), "requests-hops")
    structural = F.col("tool") == "dependencies"
    found = stored(
        _described(hops.join(questions, ["tool", "id", "out"], "left_semi"), entities).select(
            "tool", "id", "out", "hit", "there", _shown().alias("result"), F.when(structural, F.col("far_kind")).alias("detail"),
            F.when(~structural, F.col("confidence")).alias("value"),
        ),
        "requests-edges",
    )
    known = calls.where("id IS NOT NULL").join(found, ["tool", "id", "out"], "left")
    return known.unionByName(calls.where("id IS NULL"), allowMissingColumns=True).select(*NEAR)


def _blast(asked: DataFrame, entities: DataFrame, graph: DataFrame | blast.Adjacency) -> DataFrame:
    """Blast radius of the distinct entities asked for, joined back to every request."""
    calls = asked.where("tool = 'blast_radius'")
    starts = calls.where("id IS NOT NULL").groupBy(F.col("id").alias("source")).agg(
        F.max("depth").cast("int").alias("max_depth")
    )
    reached = blast.reach(starts, graph).select(
        F.col("source").alias("id"), F.col("node").alias("far"), F.col("depth").alias("at"), "rank",
        F.lit("blast_radius").alias("tool"),
    )
    found = stored(
        _described(reached, entities).select("id", "at", "hit", "there", _shown().alias("result"), "rank"), "requests-reach"
    )
    known = calls.where("id IS NOT NULL")
    near = (known["id"] == found["id"]) & (found["at"] <= known["depth"])
    met = known.join(found, near, "left").select(
        "request_id", "tool", "entity", "direction", known["id"], "hit", "there", "result", blast.rank_kind(F.col("rank")).alias("detail"),
        F.col("at").cast("double").alias("value"),
    )
    return met.unionByName(
        calls.where("id IS NULL").select("request_id", "tool", "entity", "direction", "id"), allowMissingColumns=True
    )


def _hotspots(asked: DataFrame, ranking: DataFrame | None) -> DataFrame | None:
    """Every hotspot request with the first rows of the ranking, up to its limit; None if nobody asks.

    A request unfolds to its ranks in slices, so no single row holds more than ``RANKS`` of them.
    """
    calls = asked.where("tool = 'hotspots'").select("request_id", "tool", "limit")
    if ranking is None:
        return None
    total = F.lit(ranking.count())
    rows = F.least(F.col("limit"), total)
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((rows - 1) / RANKS))).alias("slice")
    within = F.explode(F.sequence(F.col("slice") * RANKS + 1, F.least("rows", (F.col("slice") + 1) * RANKS)))
    # a few bytes of requests may unfold to gigabytes, so they are dealt out by what they make
    made = calls.agg(F.sum(F.greatest(rows, F.lit(0)).cast("double"))).first()[0] or 0
    dealt = (
        calls.where(rows > 0).select("request_id", "tool", rows.alias("rows"), slices).repartition(1 + int(made) // TASK_ROWS)
        .select("request_id", "tool", within.alias("rank"))
    )
    none = calls.where(rows <= 0).select("request_id", "tool")
    return dealt.join(ranking, "rank").unionByName(none, allowMissingColumns=True).select(
        "request_id", "tool", F.col("rank").cast("int").alias("rank"), "result", "value"
    )


def _nothing() -> Column:
    """The message of a request that has no result."""
    quoted = F.concat(F.lit("'"), F.col("entity"), F.lit("'"))
    return (
        F.when(F.col("tool") == "blast_radius", F.concat(F.lit("No blast radius results for "), quoted))
        .when(F.col("tool") == "co_changes", F.concat(F.lit("No co-change data for "), quoted))
        .when(F.col("tool") == "who_owns", F.concat(F.lit("No ownership data for "), quoted))
        .when(F.col("id").isNull(), F.concat(F.lit("Entity not found: "), F.col("entity")))
        .otherwise(F.concat(F.lit("No "), F.col("direction"), F.lit(" dependencies for "), quoted))
    )


def _shown() -> Column:
    return F.when(F.col("tool") == "who_owns", F.col("name")).otherwise(neighbors.display_key())


class Prepared:
    """What all batches of requests share: entity and path tables, adjacency, and the ranking once it is asked for."""

    def __init__(self, entities: DataFrame, edges: DataFrame):
        self.entities, self.edges = entities, edges
        self.ids = stored(resolve.path_index(entities).select(F.col("path").alias("entity"), "id"), "requests-paths")
        self._graph: blast.Adjacency | None = None
        self._ranking: DataFrame | None = None
        self._ranked = 0

    def graph(self) -> blast.Adjacency:
        if self._graph is None:
            self._graph = blast.Adjacency(self.edges)
        return self._graph

    def ranking(self, longest: int) -> DataFrame:
        """``(rank, result, value)`` of at least the ``longest`` first hotspots."""
        if self._ranking is None or self._ranked < longest:
            scored = neighbors.scored_hotspots(self.entities, self.edges)
            order = [F.desc("edge_count"), F.asc("path"), F.asc("id")]
            # twice what is asked for, so that few longer questions rank anew
            top = dense_index(scored.orderBy(*order).limit(min(2 * longest, (1 << 31) - 1)), order, "at")
            self._ranking = stored(
                top.select((F.col("at") + 1).alias("rank"), F.coalesce("path", "name").alias("result"), F.col("edge_count").cast("double").alias("value")),
                "requests-ranking",
            )
            self._ranked = 2 * longest
        return self._ranking


def answer(
    requests: DataFrame, entities: DataFrame, edges: DataFrame, bounds: Bounds = Bounds(), prepared: Prepared | None = None
) -> DataFrame:
    """Answer a table of requests.

    Result: ``(request_id, tool, status, result, detail, value, rank, message)``; ``status`` is
    ``ok``, ``empty`` or ``error``. ``value`` holds the depth, confidence or degree. Edges must
    be valid (both endpoints present). Outer joins carry requests without a match through, so
    every request appears without a second pass over the answers. ``prepared`` is shared by the
    batches of a stream.
    """
    ready = prepared or Prepared(entities, edges)
    checked = validated(requests, bounds)
    valid = checked.where("error IS NULL")
    asked = stored(
        valid.where("entity IS NOT NULL").join(ready.ids, "entity", "left")
        .unionByName(valid.where("entity IS NULL"), allowMissingColumns=True),
        "requests-asked",
    )
    tools = {r["tool"]: r["longest"] for r in asked.groupBy("tool").agg(F.max("limit").alias("longest")).collect()}

    near = _one_hop(asked, entities, edges)
    if "blast_radius" in tools:
        near = near.unionByName(_blast(asked, entities, ready.graph()))
    found = F.coalesce("hit", F.lit(False))
    answered = near.where(~found | F.col("there")).select(
        "request_id", "tool",
        F.when(found, "ok").otherwise("empty").alias("status"),
        "result", "detail", "value",
        F.lit(None).cast("int").alias("rank"),
        F.when(~found, _nothing()).alias("message"),
    )
    hot = _hotspots(asked, ready.ranking(max(tools["hotspots"], 1)) if "hotspots" in tools else None)
    some = F.col("result").isNotNull()
    hot = asked.limit(0).selectExpr("request_id", "tool", "CAST(NULL AS INT) AS rank", "entity AS result", "CAST(NULL AS DOUBLE) AS value") if hot is None else hot
    hot = hot.select(
        "request_id", "tool", F.when(some, "ok").otherwise("empty").alias("status"), "result",
        F.lit(None).cast("string").alias("detail"), "value", "rank",
        F.when(~some, "No hotspot data found. Run 'index' first.").alias("message"),
    )
    failed = checked.where("error IS NOT NULL").select(
        "request_id", "tool", F.lit("error").alias("status"),
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("rank"),
        F.col("error").alias("message"),
    )
    return answered.unionByName(hot).unionByName(failed)


def one_hop_table(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``(tool, id, out, result, detail, value)``: what each one-hop question finds, stored once for all requests to come."""
    far = entities.select(F.col("id").alias("far"), F.col("kind").alias("far_kind"), "name", "path")
    structural = F.col("tool") == "dependencies"
    return stored(
        one_hop_edges(edges).join(far, "far").select(
            "tool", "id", "out", _shown().alias("result"), F.when(structural, F.col("far_kind")).alias("detail"),
            F.when(~structural, F.col("confidence")).alias("value"),
        ),
        "requests-one-hop",
    )


def one_hop_answers(requests: DataFrame, ids: DataFrame, found: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """:func:`answer` for requests of one-hop tools and unknown ones, by outer joins with stored tables only.

    ``requests`` may be a stream: rows come and go one by one, without state. ``ids`` is :attr:`Prepared.ids`, ``found`` is
    :func:`one_hop_table`. Requests that cannot match get keys of their own, so that they do not meet in one task.
    """
    alone = lambda key: F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64("request_id").cast("string")))
    checked = validated(requests, bounds).withColumn("key", alone(F.when(F.col("error").isNull(), F.col("entity"))))
    placed = checked.join(ids.withColumnRenamed("entity", "key"), "key", "left").withColumns({"out": _outgoing(), "at": alone(F.col("id"))})
    met = placed.join(found.withColumnRenamed("id", "at"), ["tool", "at", "out"], "left")
    failed, hit = F.col("error").isNotNull(), F.col("result").isNotNull()
    return met.select(
        "request_id", "tool", F.when(failed, "error").when(hit, "ok").otherwise("empty").alias("status"), "result", "detail", "value",
        F.lit(None).cast("int").alias("rank"), F.when(failed, F.col("error")).when(~hit, _nothing()).alias("message"),
    )
