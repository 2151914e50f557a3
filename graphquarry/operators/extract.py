"""Facts from source text: items, imports and module declarations.

Input is always ``(path, source)``; every operator is a scan followed by an explode, so it runs
without a shuffle and parallelises by file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.functions import paths, text


ITEM_KINDS = ("Function", "Struct", "Trait", "Impl")


def _once(make: Callable[[], Column]) -> Callable[[], Column]:
    """A column over ``path`` and ``source`` that is put together once per JVM: large ones take seconds, mostly calls into it."""
    held: dict[str, object] = {}

    def column() -> Column:
        if held.get("jvm") is not SparkContext._jvm:
            held.update(jvm=SparkContext._jvm, column=make())
        return held["column"]

    return column


@_once
def _rust_text() -> Column:
    return text.clean_rust(F.col("source"))


@_once
def _typescript_text() -> Column:
    return text.clean_typescript(F.col("source"), F.col("path").endswith(".tsx"))


@_once
def _all_facts() -> Column:
    itself = F.array(text.fact(F.lit("file"), F.lit(0), paths.basename(F.col("path")), F.lit(None)))
    rust = text.let(_rust_text(), text.rust_facts)
    found = F.when(F.col("path").endswith(".rs"), rust).otherwise(text.ts_facts(_typescript_text()))
    return F.concat(itself, found)


def _explode(files: DataFrame, found: Column) -> DataFrame:
    return files.select("path", F.explode(found).alias("f")).select("path", "f.*")


def _rust(files: DataFrame, found: Callable[[Column], Column]) -> DataFrame:
    return _explode(files.where(F.col("path").endswith(".rs")), found(_rust_text()))


def facts(files: DataFrame) -> DataFrame:
    """``(path, fact, pos, name, line)``: every fact of every file in one pass over the text.

    Each file also yields one row of fact ``file``, so the text need not be read again to list it.
    """
    return _explode(files, _all_facts())


def files_of(found: DataFrame) -> DataFrame:
    return file_registration(found.where("fact = 'file'"))


def items_of(found: DataFrame) -> DataFrame:
    kept = found.where(F.col("fact").isin(*ITEM_KINDS))
    return kept.select("path", F.col("fact").alias("kind"), "name", "line")


def uses_of(found: DataFrame) -> DataFrame:
    return found.where("fact = 'use'").select("path", "pos", F.col("name").alias("specifier"))


def mods_of(found: DataFrame) -> DataFrame:
    return found.where("fact = 'mod'").select("path", "pos", "name")


def specifiers_of(found: DataFrame) -> DataFrame:
    return found.where("fact = 'specifier'").select("path", "pos", F.col("name").alias("specifier"))


def rust_items(files: DataFrame) -> DataFrame:
    """``(path, kind, name, line)`` for functions with a body, structs, traits and impls."""
    return items_of(_rust(files, text.rust_item_facts))


def rust_uses(files: DataFrame) -> DataFrame:
    """``(path, pos, specifier)``: text of each ``use`` without ``use `` and ``;``."""
    return uses_of(_rust(files, text.rust_use_facts))


def rust_mods(files: DataFrame) -> DataFrame:
    """``(path, pos, name)``: each body-less ``mod name;``."""
    return mods_of(_rust(files, text.rust_mod_facts))


def ts_specifiers(files: DataFrame) -> DataFrame:
    """``(path, pos, specifier)`` of every TypeScript import or re-export with a source."""
    scripts = files.where(F.col("path").rlike(r"\.tsx?$"))
    return specifiers_of(_explode(scripts, text.ts_facts(_typescript_text())))


def item_entities(items: DataFrame) -> DataFrame:
    """Item rows as graph entities with the qualified path ``<file>::<name>``."""
    return items.where(F.col("kind").isin(*ITEM_KINDS)).select(
        "kind",
        "name",
        F.concat("path", F.lit("::"), F.col("name")).alias("path"),
        F.lit("rust").alias("language"),
        "line",
    )


def file_registration(files: DataFrame) -> DataFrame:
    """``(path, name, language)`` of every scannable file (S1 filter, S2)."""
    path = F.col("path")
    return files.where(paths.is_source_file(path)).select(
        "path", paths.basename(path).alias("name"), paths.language_of(path).alias("language")
    )


def language_counts(registered: DataFrame) -> DataFrame:
    return registered.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
