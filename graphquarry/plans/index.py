"""The index build: source text, commit log and blame become the two graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.functions import paths
from graphquarry.operators import cochange, extract, ownership, resolve
from graphquarry.session import checkpointed
from graphquarry.sources import commit_log, tables
from graphquarry.sources.source_tree import scannable


def file_id(path: Column) -> Column:
    """Id of a ``File`` entity. Ids derive from their row, so no lookup join is needed."""
    return tables.entity_id(F.lit("File"), path, paths.basename(path))


def structure(files: DataFrame, ts_mode: str = "normalized") -> tuple[DataFrame, DataFrame]:
    """Entities ``(kind, name, path, language)`` and import edges of ``(path, source)`` files.

    The text is read once: its facts, a small fraction of it, are written to the checkpoint
    folder and feed the file list, the items and all three resolvers.
    """
    found = checkpointed(extract.facts(scannable(files)))
    registered = extract.files_of(found)
    entities = registered.select(F.lit("File").alias("kind"), "name", "path", "language").unionByName(
        extract.item_entities(extract.items_of(found)), allowMissingColumns=True
    )
    by_path = (
        resolve.mod_edges(extract.mods_of(found), registered)
        .unionByName(resolve.crate_use_edges(extract.uses_of(found), registered))
        .unionByName(resolve.ts_edges(extract.specifiers_of(found), registered, ts_mode))
    )
    edges = by_path.select(
        file_id(F.col("from_path")).alias("from_id"), file_id(F.col("to_path")).alias("to_id"),
        "kind", "confidence",
    )
    return entities, edges


def build(
    files: DataFrame,
    commits: DataFrame | None = None,
    line_counts: DataFrame | None = None,
    ts_mode: str = "normalized",
    merge: str = "sum",
    commit_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(entities, edges)`` of a code base; history parts are optional and independent.

    ``commits`` comes from :func:`commit_log.parse_commits`, ``line_counts`` from one of the
    blame readers in :mod:`graphquarry.operators.ownership`.
    """
    rows, edge_rows = structure(files, ts_mode)
    entities = tables.new_entities(rows)
    if commits is not None:
        changed = commit_log.changes(commit_log.newest_commits(commits, commit_limit))
        pairs = checkpointed(cochange.cochange_pairs(changed))
        scored = cochange.cochange_confidence(pairs)
        edge_rows = edge_rows.unionByName(cochange.cochange_edges(scored, entities))
    if line_counts is not None:
        tracked = line_counts.join(entities.where("kind = 'File'").select("path"), "path", "left_semi")
        people = tables.new_entities(ownership.persons(tracked, entities))
        entities = entities.unionByName(people)
        shares = ownership.ownership_share(tracked)
        edge_rows = edge_rows.unionByName(ownership.ownership_edges(shares, entities, merge))
    return entities, tables.new_edges(edge_rows)
