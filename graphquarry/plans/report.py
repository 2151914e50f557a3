"""The graph report: indexed node and link tables, reach, rankings and one JSON document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphquarry.functions import paths
from graphquarry.operators import blast
from graphquarry.operators.ordered import dense_index
from graphquarry.schemas import COCHANGE_REPORT_THRESHOLD, REPORT_LINK_KINDS
from graphquarry.session import checkpointed, stored

# Report depths and list lengths.
BLAST_DEPTH = 3
TOP_HOTSPOTS = 10
TOP_CONTRIBUTORS = 8
TOP_PARTNERS = 6
LIST_CHUNK = 4096
#: Logarithm of the registers of one sketch: 4,096 registers, 1.6 % standard error.
SKETCH_BITS = 12


def file_table(entities: DataFrame) -> DataFrame:
    """``(idx, id, path)`` of all files, numbered in path order (V1)."""
    files = entities.where("kind = 'File'").select("id", "path")
    return dense_index(files, [F.asc("path"), F.asc("id")], "idx")


def primary_owner(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``(id, owner, owner_email)``: the owner with the greatest share, smallest e-mail on a tie (V2)."""
    people = entities.where("kind = 'Person'").select(
        F.col("id").alias("to_id"), F.col("name").alias("owner"), F.col("path").alias("owner_email")
    )
    files = entities.where("kind = 'File'").select(F.col("id").alias("from_id"))
    owned = edges.where("kind = 'owned_by'").join(people, "to_id", "left")
    best = F.min(F.struct(
        (-F.coalesce("confidence", F.lit(-1.0))).alias("less"),
        F.coalesce("owner_email", F.lit("")).alias("owner_email"),
        F.coalesce("owner", F.lit("unknown")).alias("owner"),
    )).alias("best")
    # one row per start is left when the starts that are no files drop out
    owner_of = owned.groupBy("from_id").agg(best).join(files, "from_id", "left_semi")
    return owner_of.select(F.col("from_id").alias("id"), "best.owner", "best.owner_email")


def indexed_links(edges: DataFrame, files: DataFrame, threshold: float = COCHANGE_REPORT_THRESHOLD) -> DataFrame:
    """``(kind, source, target, confidence)`` of the report's file-to-file edges."""
    shown = F.col("kind").isin(*REPORT_LINK_KINDS) | (
        (F.col("kind") == "co_changes_with") & (F.col("confidence") >= threshold)
    )
    start = files.select(F.col("id").alias("from_id"), F.col("idx").alias("source"))
    end = files.select(F.col("id").alias("to_id"), F.col("idx").alias("target"))
    # a number stands for the kind while links move
    kinds = F.array(*map(F.lit, (*REPORT_LINK_KINDS, "co_changes_with")))
    kept = edges.where(shown).select("from_id", "to_id", F.array_position(kinds, F.col("kind")).cast("int").alias("at"), "confidence")
    # edges are often laid out by their end, so that they move together in the first join and compress well
    return kept.join(end, "to_id").join(start, "from_id").select(
        F.get(kinds, F.col("at") - 1).alias("kind"), "source", "target", "confidence"
    )


def struct_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("kind").isin(*REPORT_LINK_KINDS)).select("kind", "source", "target")


def cochange_links(links: DataFrame) -> DataFrame:
    """One link per unordered pair, the most confident, rounded to three digits."""
    pairs = links.where("kind = 'co_changes_with'").withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    # the source tells the target, so that no more than the pair, its confidence and the source moves
    best = F.max(F.struct("confidence", (-F.col("source")).alias("less"))).alias("best")
    source = -F.col("best.less")
    # dealt out by one end, of which a task has many links in a row; a file has at most as many links as there are files
    return pairs.repartition("a").groupBy("a", "b").agg(best).select(
        source.alias("source"), F.when(source == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target"),
        F.round("best.confidence", 3).alias("confidence"),
    )


def link_degree(links: DataFrame) -> DataFrame:
    """``(idx, degree)`` over structural and co-change links (V5)."""
    ends = links.select(F.explode(F.array("source", "target")).alias("idx"))
    return ends.groupBy("idx").agg(F.count(F.lit(1)).alias("degree"))


def symmetric_adjacency(links: DataFrame) -> DataFrame:
    """``(node, next)`` in both directions over structural links."""
    return blast.adjacency(_as_edges(links), "both", REPORT_LINK_KINDS).select("node", "next")


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "kind")


def all_sources_blast(files: DataFrame, links: DataFrame, depth: int = BLAST_DEPTH) -> DataFrame:
    """``(source, node, depth)``: reach of every file over structural links."""
    starts = files.select(F.col("idx").alias("source"), F.lit(depth).alias("max_depth"))
    return blast.reach(starts, _as_edges(struct_links(links)), "both", REPORT_LINK_KINDS).select(
        "source", "node", "depth"
    )


def blast_size(files: DataFrame, reached: DataFrame) -> DataFrame:
    """``(idx, blast)``: number of files in each file's reach, zero included."""
    sizes = reached.groupBy(F.col("source").alias("idx")).agg(F.count(F.lit(1)).alias("blast"))
    return files.select("idx").join(sizes, "idx", "left").select("idx", F.coalesce("blast", F.lit(0)).alias("blast"))


def blast_size_estimate(files: DataFrame, links: DataFrame, depth: int = BLAST_DEPTH, precision: int = SKETCH_BITS) -> DataFrame:
    """``(idx, blast)``: :func:`blast_size` to within a few per cent, without the table of all reached pairs.

    Every file starts with a sketch of itself; each hop unites the sketches of a file and its neighbours. A hop moves one
    sketch per link, of a size that ``precision`` bounds, where exact sets move every pair: a hub with d links makes d sketches
    to unite, not d squared pairs. The relative standard error is about 1.04 / sqrt(2 ** precision), and small sets are exact.
    """
    beside = stored(symmetric_adjacency(struct_links(links)).distinct(), "estimate-links")
    own = files.select("idx").groupBy("idx").agg(F.hll_sketch_agg("idx", precision).alias("reach"))
    for hop in range(depth):
        known = stored(own, "estimate-sketches")
        moved = beside.join(known.select(F.col("idx").alias("next"), "reach"), "next").select(F.col("node").alias("idx"), "reach")
        own = known.unionByName(moved).groupBy("idx").agg(F.hll_union_agg("reach").alias("reach"))
    # a file is part of its own sketch
    sizes = own.select("idx", F.greatest(F.hll_sketch_estimate("reach") - 1, F.lit(0)).alias("blast"))
    return files.select("idx").join(sizes, "idx", "left").select("idx", F.coalesce("blast", F.lit(0)).alias("blast"))


def owner_ranks(owner_of: DataFrame) -> DataFrame:
    """``(owner_idx, owner, files)``: most files first (V8)."""
    counts = owner_of.groupBy("owner").agg(F.count(F.lit(1)).alias("files"))
    return dense_index(counts, [F.desc("files"), F.asc("owner")], "owner_idx")


def top_contributors(ranks: DataFrame, limit: int = TOP_CONTRIBUTORS) -> DataFrame:
    return ranks.where(F.col("owner_idx") < limit)


def crate_index(files: DataFrame) -> DataFrame:
    """``(crate_idx, crate)`` in name order (V9)."""
    crates = files.select(paths.crate_of(F.col("path")).alias("crate")).distinct()
    return dense_index(crates, [F.asc("crate")], "crate_idx")


def node_table(files: DataFrame, owner_of: DataFrame, ranks: DataFrame, crates: DataFrame, degree: DataFrame) -> DataFrame:
    """One row per file with its label, group, owner and degree."""
    return (
        files.withColumns({"label": paths.basename(F.col("path")), "crate": paths.crate_of(F.col("path"))})
        .join(owner_of, "id", "left")
        .withColumns({"owner": F.coalesce("owner", F.lit("unowned")), "owner_email": F.coalesce("owner_email", F.lit(""))})
        .join(ranks.select("owner", "owner_idx"), "owner", "left")
        .join(crates, "crate", "left")
        .join(degree, "idx", "left")
        .select(
            "idx", "label", "path", "crate", "crate_idx", "owner", "owner_email",
            F.coalesce("owner_idx", F.lit(-1)).alias("owner_idx"),
            F.coalesce("degree", F.lit(0)).alias("degree"),
        )
    )


def report_hotspots(nodes: DataFrame, limit: int = TOP_HOTSPOTS) -> DataFrame:
    return nodes.orderBy(F.desc("degree"), "path").limit(limit).select("idx", "label", "path", "degree")


def partner_top(pair_links: DataFrame, nodes: DataFrame, limit: int = TOP_PARTNERS) -> DataFrame:
    """Strongest co-change partners of each node, both directions.

    ``row_number() <= limit`` lets Spark keep only ``limit`` rows per node and task before the
    shuffle, so a node with many partners stays small.
    """
    ways = F.array(
        F.struct(F.col("source").alias("idx"), F.col("target").alias("partner")),
        F.struct(F.col("target").alias("idx"), F.col("source").alias("partner")),
    )
    both = pair_links.select(F.explode(F.array_distinct(ways)).alias("w"), "confidence").select(
        "w.idx", "w.partner", "confidence"
    )
    order = Window.partitionBy("idx").orderBy(F.desc("confidence"), "partner")
    top = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    names = nodes.select(F.col("idx").alias("partner"), "label")
    return top.join(names, "partner").select(
        "idx", "rank", "partner", "label", F.round(F.col("confidence") * 100).cast("int").alias("percent")
    )


@dataclass(frozen=True)
class Report:
    """The report's tables; shared inputs are materialised once."""

    files: DataFrame
    links: DataFrame
    nodes: DataFrame
    owners: DataFrame
    crates: DataFrame

    @classmethod
    def build(cls, entities: DataFrame, edges: DataFrame, threshold: float = COCHANGE_REPORT_THRESHOLD) -> Report:
        files = file_table(entities)
        links = stored(indexed_links(edges, files, threshold), "report-links")
        owner_of = checkpointed(primary_owner(edges, entities))
        ranks, crates = owner_ranks(owner_of), crate_index(files)
        nodes = checkpointed(node_table(files, owner_of, ranks, crates, link_degree(links)))
        return cls(files, links, nodes, ranks, crates)

    def struct_links(self) -> DataFrame:
        return struct_links(self.links)

    def cochange_links(self) -> DataFrame:
        return cochange_links(self.links)

    def blast(self) -> DataFrame:
        return all_sources_blast(self.files, self.links)

    def hotspots(self) -> DataFrame:
        return report_hotspots(self.nodes)

    def stats(self, pair_links: DataFrame | None = None) -> DataFrame:
        """One row of totals (V17), each a scalar subquery. ``pair_links`` may give the co-change links, if they are there already."""
        def total(df: DataFrame) -> Column:
            return df.agg(F.count(F.lit(1))).scalar()

        return self.nodes.sparkSession.range(1).select(
            total(self.nodes).alias("files"),
            total(self.struct_links()).alias("struct_edges"),
            total(self.cochange_links() if pair_links is None else pair_links).alias("cochange_edges"),
            total(self.owners).alias("owners"),
            total(self.crates).alias("crates"),
        )

    def json_fragments(self, repo: str) -> DataFrame:
        """The whole report as one compact JSON document, cut into ordered fragments.

        Rows are ``(section, key, text)``; the texts in ``(section, key)`` order are the
        document. No row grows with the data: lists come one element, or one bounded slice of
        node numbers, per row.
        """
        n = F.col
        nodes = F.struct(n("idx").alias("id"), "label", "path", "crate", "crate_idx", "owner", "owner_email", "owner_idx", "degree")
        struct_item = F.struct("source", "target", F.lit("struct").alias("kind"))
        pair_item = F.struct("source", "target", F.lit("cochange").alias("kind"), "confidence")
        kind_rank = F.array_position(F.array(*map(F.lit, REPORT_LINK_KINDS)), n("kind"))
        hot = F.struct(n("idx").alias("id"), "label", "path", "degree")
        spark = self.nodes.sparkSession
        repo_text = F.regexp_replace(F.to_json(F.array(F.lit(repo))), r"^\[|\]$", "")
        pair_links = stored(self.cochange_links(), "report-pairs")  # counted, listed and searched for the first
        stats = self.stats(pair_links).select(
            F.lit(0).alias("section"), _key(),
            F.concat(F.lit('{"repo":'), repo_text, F.lit(',"stats":'), F.to_json(F.struct("*")), F.lit(',"nodes":[')).alias("text"),
        )
        parts = [
            stats,
            _items(self.nodes, 1, [n("idx")], F.to_json(nodes)),
            _literal(spark, 2, '],"struct_links":['),
            _items(self.struct_links(), 3, [n("source"), n("target"), kind_rank], F.to_json(struct_item)),
            _literal(spark, 4, '],"cochange_links":['),
            _items(pair_links, 5, [n("source"), n("target")], F.to_json(pair_item)),
            _literal(spark, 6, '],"blast":{'),
            self._blast_fragments(7),
            _literal(spark, 8, '},"hotspots":['),
            _items(self.hotspots(), 9, [-n("degree"), n("idx")], F.to_json(hot)),
            _literal(spark, 10, '],"owners":['),
            _items(self.owners, 11, [n("owner_idx")], F.to_json(F.struct(n("owner").alias("name"), n("files").alias("count")))),
            _literal(spark, 12, '],"crates":['),
            _items(self.crates, 13, [n("crate_idx")], F.regexp_replace(F.to_json(F.array("crate")), r"^\[|\]$", "")),
            _literal(spark, 14, "]}"),
        ]
        document = parts[0]
        for part in parts[1:]:
            document = document.unionByName(part)
        return document

    def _blast_fragments(self, section: int) -> DataFrame:
        """``"<idx>":[`` … ``]`` per file, its reach in slices of at most ``LIST_CHUNK`` nodes."""
        reached = self.blast()
        slices = reached.groupBy("source", F.floor(F.col("node") / LIST_CHUNK).alias("slice")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda v: v.cast("string")), ",").alias("list")
        )
        slices = checkpointed(slices)
        first = slices.groupBy("source").agg(F.min("slice").alias("first"))
        comma = F.when(F.col("slice") == F.col("first"), "").otherwise(",")
        body = slices.join(first, "source").select(
            F.lit(section).alias("section"), _key(F.col("source"), F.lit(1), F.col("slice")),
            F.concat(comma, F.col("list")).alias("text"),
        )
        idx = F.col("idx")
        heads = self.nodes.select(
            F.lit(section).alias("section"), _key(idx, F.lit(0)),
            F.concat(F.when(idx == 0, '"').otherwise(',"'), idx.cast("string"), F.lit('":[')).alias("text"),
        )
        tails = self.nodes.select(F.lit(section).alias("section"), _key(idx, F.lit(2)), F.lit("]").alias("text"))
        return body.unionByName(heads).unionByName(tails)

    def write_json(self, repo: str, path: str) -> None:
        """Write the document as text parts; concatenated in name order they are valid JSON."""
        self.json_fragments(repo).orderBy("section", "key").select("text").write.mode("overwrite").text(path)


def _key(*columns: Column) -> Column:
    return F.array(*[c.cast("bigint") for c in columns]).cast("array<bigint>").alias("key")


def _items(df: DataFrame, section: int, key: list[Column], text: Column) -> DataFrame:
    rows = df.select(F.lit(section).alias("section"), _key(*key), text.alias("text"))
    first = rows.agg(F.min("key")).scalar()
    return rows.withColumn("text", F.when(F.col("key") == first, F.col("text")).otherwise(F.concat(F.lit(","), "text")))


def _literal(spark, section: int, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(section).alias("section"), _key(), F.lit(text).alias("text"))
