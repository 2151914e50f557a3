"""The user's entry point: build or load a graph and ask it questions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphquarry.operators import blast, neighbors, resolve
from graphquarry.plans import index, requests as request_plan
from graphquarry.plans.report import Report
from graphquarry.schemas import COCHANGE_REPORT_THRESHOLD, DEFAULT_DEPTH, DEFAULT_LIMIT
from graphquarry.sources import tables


def _end(direction: str) -> str:
    return "from_id" if neighbors.outgoing(direction) else "to_id"


class CodeGraph:
    """A code-base graph: an entity table and an edge table."""

    def __init__(self, entities: DataFrame, edges: DataFrame):
        self.entities = entities
        self.edges = edges
        self._adjacency: dict[str, blast.Adjacency] = {}

    def adjacency(self, direction: str = "both") -> blast.Adjacency:
        """The structural adjacency, written once per graph and direction and used by all traversals."""
        if direction not in self._adjacency:
            self._adjacency[direction] = blast.Adjacency(self.edges, direction)
        return self._adjacency[direction]

    @classmethod
    def index(cls, root: str, files: DataFrame, commits: DataFrame | None = None,
              line_counts: DataFrame | None = None, **options) -> CodeGraph:
        """Build the graph from scratch, replace the tables under ``root`` and open them."""
        entities, edges = index.build(files, commits, line_counts, **options)
        tables.write_graph(entities, edges, root)
        return cls.load(files.sparkSession, root)

    @classmethod
    def load(cls, spark: SparkSession, root: str, validate: bool = True) -> CodeGraph:
        """Open stored tables; ``validate=False`` skips the endpoint check of edges this
        library wrote itself, which saves two joins per query."""
        entities, edges = tables.read_entities(spark, root), tables.read_edges(spark, root)
        return cls(entities, tables.valid_edges(edges, entities) if validate else edges)

    def all_entities(self) -> DataFrame:
        return self.entities

    def _at(self, path: str | Iterable[str] | DataFrame) -> DataFrame:
        """Entities at the given paths: one path is a literal that reaches the Parquet scan, more are a table to join."""
        if isinstance(path, str):
            return self.entities.where(F.col("path") == path)
        if not isinstance(path, DataFrame):
            path = self.entities.sparkSession.createDataFrame([(p,) for p in path], "path string")
        return self.entities.join(path.select("path"), "path", "left_semi")

    def _ids(self, path: str | Iterable[str] | DataFrame) -> DataFrame:
        return resolve.path_index(self._at(path))

    def _near(self, path: str | Iterable[str] | DataFrame, *ends: str) -> tuple[DataFrame, DataFrame]:
        """The asked entities and the edges at them.

        For a single path the one id becomes a literal, so the filter reaches the Parquet scan and reads the
        row groups that hold it. More paths stay a table, and no job runs before the caller's action.
        """
        wanted = self._ids(path)
        if not isinstance(path, str):
            return wanted, self.edges
        ids = [row.id for row in wanted.select("id").collect()]
        at = [F.col(end).isin(ids) for end in ends]
        return self.entities.where(F.col("id").isin(ids)), self.edges.where(reduce(or_, at))

    def find(self, path: str | Iterable[str] | DataFrame) -> DataFrame:
        return self._ids(path)

    def blast_radius(self, path: str | Iterable[str] | DataFrame, depth: int | None = DEFAULT_DEPTH) -> DataFrame:
        """What a change may affect: reach in both directions, with depth and discovering kind."""
        return blast.blast_radius(self._ids(path).select("path"), self.adjacency(), self.entities, depth)

    def reachable(self, path: str | Iterable[str] | DataFrame, depth: int | None = DEFAULT_DEPTH) -> DataFrame:
        """What a file depends on, directly or not: outgoing reach."""
        starts = self._ids(path).select(F.col("id").alias("source"), F.lit(depth).cast("int").alias("max_depth"))
        found = blast.reach(starts, self.adjacency("out"))
        return found.join(self.entities.withColumnRenamed("id", "node"), "node").select(
            "source", "kind", "name", "path", "depth"
        )

    def dependencies(self, path: str | Iterable[str] | DataFrame, direction: str = "downstream") -> DataFrame:
        wanted, edges = self._near(path, _end(direction))
        return neighbors.dependencies(wanted, edges, self.entities, direction)

    def neighbors(self, path: str | Iterable[str] | DataFrame, direction: str = "downstream") -> DataFrame:
        wanted, edges = self._near(path, _end(direction))
        return neighbors.all_neighbors(wanted, edges, self.entities, direction)

    def co_changes(self, path: str | Iterable[str] | DataFrame, symmetric: bool = False) -> DataFrame:
        wanted, edges = self._near(path, *(("from_id", "to_id") if symmetric else ("from_id",)))
        return neighbors.co_changes(wanted, edges, self.entities, symmetric)

    def who_owns(self, path: str | Iterable[str] | DataFrame) -> DataFrame:
        wanted, edges = self._near(path, "from_id")
        return neighbors.owners(wanted, edges, self.entities)

    def hotspots(self, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return neighbors.hotspots(self.entities, self.edges, limit)

    def answer(self, requests: DataFrame, bounds: request_plan.Bounds = request_plan.Bounds()) -> DataFrame:
        return request_plan.answer(requests, self.entities, self.edges, bounds)

    def report(self, threshold: float = COCHANGE_REPORT_THRESHOLD) -> Report:
        return Report.build(self.entities, self.edges, threshold)
