"""Commit-log dumps: ``--name-status`` text with a marker line in front of each commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphquarry.functions.text import let
from graphquarry.session import stored

# The marker line and the number of header lines after it.
MARKER = "COMMIT_START"
HEADER_LINES = 5
#: Characters of the line ends that may close a record.
LINE_ENDS = 4


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit record (S3); the marker line is the record separator, so files split.

    A first scan finds the line ends each file uses; files of both kinds may share a folder.
    """
    file = F.col("_metadata.file_path")
    marks = spark.read.option("lineSep", "\n").text(path).where(F.col("value").isin(MARKER, f"{MARKER}\r"))
    kinds = stored(marks.groupBy(file.alias("file")).agg(F.bool_or(F.endswith("value", F.lit("\r"))).alias("crlf")), "log-line-ends")
    found = kinds.agg(F.bool_or("crlf").alias("some"), F.bool_and("crlf").alias("all")).first()

    def records(end: str) -> DataFrame:
        return spark.read.option("lineSep", f"\n{MARKER}{end}").text(path)

    if not found["some"]:
        return records("\n").select(F.col("value").alias("record"))
    if found["all"]:
        return records("\r\n").select(F.col("value").alias("record"))
    parts = [
        records(end).select(F.col("value").alias("record"), file.alias("file"))
        .join(kinds.where(F.col("crlf") == crlf), "file", "left_semi").select("record")
        for end, crlf in (("\n", False), ("\r\n", True))
    ]
    # stored, because the check for cut records must not be pushed below the choice of files
    return stored(parts[0].unionByName(parts[1]), "log-records")


def parse_commits(records: DataFrame) -> DataFrame:
    """``(hash, author, email, timestamp, message, files_changed)`` per record (H2–H4)."""
    headless = F.regexp_replace("record", f"^{MARKER}\r?\n", "")
    # the pattern of the last line ends meets no more than these characters and need not try every place of a record
    kept, last = F.greatest(F.length(headless) - LINE_ENDS, F.lit(0)), F.right(headless, F.lit(LINE_ENDS))
    body = F.concat(F.left(headless, kept), F.regexp_replace(last, "\r?\n?$", ""))
    # an array of one element is exploded, since no filter of a later step moves below that and has records read again
    parsed = records.select(F.explode(F.array(let(let(body, _whole), _fields))).alias("c"))
    return parsed.where(F.col("c.n") >= HEADER_LINES).select("c.*").drop("n")


def _whole(body: Column) -> Column:
    """Lines of a record; a marker line among them is an error."""
    cut = F.concat(F.lit("marker line inside a commit record: "), F.left(body, F.lit(80)))
    whole = F.when(body.rlike(f"(?m)^{MARKER}\r?$"), F.raise_error(cut)).otherwise(body)
    # one character splits without a pattern
    return F.split(F.replace(whole, F.lit("\r\n"), F.lit("\n")), "\n")


def _fields(lines: Column) -> Column:
    header = [F.get(lines, F.lit(i)) for i in range(HEADER_LINES)]
    rest = F.filter(F.slice(lines, F.lit(HEADER_LINES + 1), F.size(lines)), lambda line: F.contains(line, F.lit("\t")))
    return F.struct(
        F.size(lines).alias("n"),
        header[0].alias("hash"),
        header[1].alias("author"),
        header[2].alias("email"),
        F.coalesce(header[3].try_cast("bigint"), F.lit(0)).alias("timestamp"),
        header[4].alias("message"),
        F.transform(rest, lambda line: let(F.split(line, "\t", 3), _change)).alias("files_changed"),
    )


def _change(fields: Column) -> Column:
    return F.struct(change_path(fields).alias("path"), change_kind(F.get(fields, F.lit(0))).alias("kind"))


def change_kind(status: Column) -> Column:
    return (
        F.when(status.startswith("A"), "Added").when(status.startswith("D"), "Deleted").otherwise("Modified")
    )


def change_path(fields: Column) -> Column:
    """New path of a rename or copy, else the second field."""
    status = F.get(fields, F.lit(0))
    moved = (status.startswith("R") | status.startswith("C")) & (F.size(fields) >= 3)
    return F.when(moved, F.get(fields, F.lit(2))).otherwise(F.get(fields, F.lit(1)))


def changes(commits: DataFrame) -> DataFrame:
    """Exploded form ``(hash, path, kind)``."""
    return commits.select("hash", F.explode("files_changed").alias("c")).select("hash", "c.path", "c.kind")


def newest_commits(commits: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``limit`` newest commits, all without a limit; merges are left out when a ``parents`` column tells them (H1).

    Only (timestamp, hash) keys are ranked, as a distributed top-k; the change lists of the chosen
    commits are then joined back. Equal keys beyond the limit come along.
    """
    if "parents" in commits.columns:
        commits = commits.where(F.size("parents") <= 1)
    if limit is None:
        return commits
    newest = commits.select("timestamp", "hash").orderBy(F.desc("timestamp"), "hash").limit(limit)
    return commits.join(newest, ["timestamp", "hash"], "left_semi")
