"""Blame dumps in porcelain form, one dump per source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphquarry.sources.listing import read_texts


def read_blame_dumps(spark: SparkSession, root: str, suffix: str = ".blame") -> DataFrame:
    """``(path, dump)`` from a folder that mirrors the source tree."""
    path = F.regexp_replace("path", F.lit(f"\\Q{suffix}\\E$"), F.lit(""))
    return read_texts(spark, root, f"*{suffix}").select(path.alias("path"), F.col("text").alias("dump"))


def read_blame_records(spark: SparkSession, root: str, suffix: str = ".blame") -> DataFrame:
    """``(path, record)``: dumps cut in front of each content line, so a large dump is read by many tasks.

    A record is the content of one line and, behind its line end, the header of the next; the first of a file is a header
    alone. Where a record stood in its file does not matter to who wrote how much.
    """
    path = F.regexp_replace("path", F.lit(f"\\Q{suffix}\\E$"), F.lit(""))
    return read_texts(spark, root, f"*{suffix}", "\n\t").select(path.alias("path"), F.col("text").alias("record"))


def blame_lines(dumps: DataFrame) -> DataFrame:
    """``(path, pos, line)`` of each dump line."""
    return dumps.select("path", F.posexplode(F.split("dump", "\n")).alias("pos", "line"))
