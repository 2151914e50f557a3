"""Path columns: components, languages, scan filter, normalisation and grouping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directories never scanned.
SKIPPED_DIRS = ("target", "node_modules", "dist", ".next", "build")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Directory part without a trailing slash; empty for a top-level file."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def join_path(directory: Column, rest: Column) -> Column:
    return F.when(directory == "", rest).otherwise(F.concat(directory, F.lit("/"), rest))


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".rs"), "rust").otherwise("typescript")


def is_source_file(path: Column) -> Column:
    """True for ``.rs``/``.ts``/``.tsx`` outside the skipped directories, ``.d.ts`` excluded."""
    directories = F.split(parent(path), "/")
    return (
        path.rlike(r"[^/]\.(rs|ts|tsx)$")
        & ~path.endswith(".d.ts")
        & ~F.arrays_overlap(directories, F.array(*map(F.lit, SKIPPED_DIRS)))
    )


def normalized(path: Column) -> Column:
    """Fold ``.`` and ``..``; a path that climbs out of the root keeps its leading ``..``."""
    up = F.lit("..")

    def push(acc: Column, part: Column) -> Column:
        climbs = F.element_at(F.concat(F.array(up), acc), -1) != up
        return (
            F.when(part.isin("", "."), acc)
            .when((part == up) & climbs, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/"), empty, push), "/")


def crate_of(path: Column) -> Column:
    """Top-level group: ``crates/<x>/…`` gives ``x``, a lone file name gives ``(root)``."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return (
        F.when((first == "crates") & (F.size(parts) >= 2), F.get(parts, F.lit(1)))
        .when((F.size(parts) == 1) | (first == ""), "(root)")
        .otherwise(first)
    )
