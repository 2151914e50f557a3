"""Whole text files below a folder, with paths relative to it."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

# Scheme and authority of a location: file:, hdfs://host, s3a://bucket.
_PLACE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_texts(spark: SparkSession, root: str, glob: str, separator: str | None = None) -> DataFrame:
    """``(path, text)`` of every file below ``root`` whose name matches ``glob``.

    With a ``separator``, one row for each part between two of them; large files are then read by many tasks.
    """
    root = root if re.match(_PLACE, root) else os.path.abspath(root)
    below = re.sub(_PLACE, "", root).rstrip("/")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    raw = reader.text(root, wholetext=True) if separator is None else reader.text(root, lineSep=separator)
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    path = F.substr(F.regexp_replace(plain, _PLACE, ""), F.lit(len(below) + 2))
    return raw.select(path.alias("path"), F.col("value").alias("text"))
