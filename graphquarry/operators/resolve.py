"""Candidate paths joined to the file table.

Each declaration expands to a fixed, small number of candidate paths. One equi-join against the
file list (unique on ``path``) finds the ones that exist, and the lowest candidate position per
declaration wins. The file list is stored with one row per path before it is joined: an aggregate directly
under the join would keep adaptive execution from splitting a target that many files import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.functions import paths
from graphquarry.session import stored

# File stems whose sub-modules are siblings, and the suffixes tried in order.
MODULE_ROOT_STEMS = ("main", "lib", "mod")
TS_SUFFIXES = (".ts", "/index.ts", ".tsx", "/index.tsx")


def _targets(files: DataFrame) -> DataFrame:
    return stored(files.select(F.col("path").alias("target")).distinct(), "resolve-targets")


def _first_existing(declared: DataFrame, candidates: Column, files: DataFrame, *key: str) -> DataFrame:
    """Lowest candidate that exists per ``key``; ``candidates`` must derive from the key alone.

    Only the position is aggregated, a fixed-width value that hashes; the path follows from it.
    """
    expanded = declared.select(*key, F.posexplode(candidates).alias("pos_", "target"))
    known = _targets(files)
    best = (
        expanded.where(~F.contains("target", F.lit("..")))
        .join(known, "target")
        .groupBy(*key)
        .agg(F.min("pos_").alias("pos_"))
    )
    return best.withColumn("target", F.get(candidates, F.col("pos_"))).drop("pos_")


def _as_edges(resolved: DataFrame, kind: str) -> DataFrame:
    return resolved.select(
        F.col("path").alias("from_path"),
        F.col("target").alias("to_path"),
        F.lit(kind).alias("kind"),
        F.lit(1.0).alias("confidence"),
    )


def mod_targets(mods: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, name, target)`` for each ``mod name;`` whose file exists (R1, R1g)."""
    path, name = F.col("path"), F.col("name")
    own = paths.stem(paths.basename(path))
    base = F.when(own.isin(*MODULE_ROOT_STEMS), paths.parent(path)).otherwise(
        paths.join_path(paths.parent(path), own)
    )
    candidates = F.array(
        paths.join_path(base, F.concat(name, F.lit(".rs"))),
        paths.join_path(base, F.concat(name, F.lit("/mod.rs"))),
    )
    safe = ~(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")))
    return _first_existing(mods.where(safe).select("path", "name").distinct(), candidates, files, "path", "name")


def mod_edges(mods: DataFrame, files: DataFrame) -> DataFrame:
    return _as_edges(mod_targets(mods, files), "imports").distinct()


def crate_use_edges(uses: DataFrame, files: DataFrame) -> DataFrame:
    """``depends_on`` edges of ``crate::<module>…`` imports whose ``src/<module>.rs`` exists (R2)."""
    inner = F.regexp_extract("specifier", r"(?s)^crate::(.*)$", 1)
    module = F.get(F.split(inner, "::"), F.lit(0))
    wanted = (
        uses.where(F.col("specifier").startswith("crate::"))
        .select("path", F.concat(F.lit("src/"), module, F.lit(".rs")).alias("target"))
        .where("target <> 'src/.rs'")
        .distinct()
    )
    # distinct before the join only: an aggregate behind it would use its partitioning and forbid a split
    return _as_edges(wanted.join(_targets(files), "target"), "depends_on")


def ts_targets(specifiers: DataFrame, files: DataFrame, mode: str = "normalized") -> DataFrame:
    """``(path, specifier, target)`` of relative specifiers.

    ``literal`` joins paths without folding ``.``/``..``, so only same-directory specifiers
    resolve; ``normalized`` folds them and drops what leaves the root.
    """
    if mode not in ("normalized", "literal"):
        raise ValueError(f"unknown mode: {mode}")
    spec = F.regexp_replace("specifier", "/+$", "")
    directory = paths.parent(spec)
    last = paths.basename(spec)
    base = F.when(last.isin(".", ".."), last).otherwise(paths.stem(last))
    joined = paths.join_path(paths.parent(F.col("path")), F.concat(
        F.when(directory == ".", "").otherwise(F.concat(directory, F.lit("/"))), base
    ))
    place = paths.normalized(joined) if mode == "normalized" else joined
    candidates = F.array(*[F.concat(F.col("place"), F.lit(suffix)) for suffix in TS_SUFFIXES])
    relative = (
        specifiers.where(F.col("specifier").rlike(r"^\.{1,2}/"))
        .select("path", "specifier", place.alias("place"))
        .distinct()
    )
    return _first_existing(relative, candidates, files, "path", "specifier", "place").drop("place")


def ts_edges(specifiers: DataFrame, files: DataFrame, mode: str = "normalized") -> DataFrame:
    return _as_edges(ts_targets(specifiers, files, mode), "imports").distinct()


def find_by_path(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of each requested path; the smallest id stands when a path repeats."""
    asked = wanted.select("path")
    return asked.distinct().join(path_index(entities.join(asked, "path", "left_semi")), "path")


def path_index(entities: DataFrame) -> DataFrame:
    """One entity per path: the smallest id, with its kind and name."""
    best = F.min(F.struct("id", "kind", "name", "language")).alias("best")
    return entities.where("path IS NOT NULL").groupBy("path").agg(best).select(
        "path", "best.id", "best.kind", "best.name", "best.language"
    )
