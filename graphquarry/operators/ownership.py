"""Who wrote the lines of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.operators.ordered import FILL_CHUNK, filled_parts, heavy_keys, rank_within, split_heavy
from graphquarry.operators.resolve import path_index
from graphquarry.session import stored

#: Lines of a file that are counted in one task at most.
HOT_LINES = 1 << 17
SHA = r"^([0-9a-f]{40,64}) \d+ \d+"


def _mail(text: Column) -> Column:
    return F.regexp_replace(text, "^<+|>+$", "")


def blamed_from_dumps(dumps: DataFrame) -> DataFrame:
    """``(path, author, email, line_count)`` from whole dumps, each line credited by its commit (H8).

    A dump splits into hunks inside its row, so nothing is ordered across rows: hunk counts
    aggregate per (file, commit), and the one hunk that carries the author names it for all.
    """
    hunks = dumps.where(~F.col("path").startswith("-")).select(
        "path", F.explode(F.split("dump", r"(?m)(?=^[0-9a-f]{40,64} \d+ \d+)")).alias("hunk")
    )
    lines = F.size(F.split("hunk", "\n\t")) - 1
    facts = hunks.select(
        "path",
        F.regexp_extract("hunk", SHA, 1).alias("sha"),
        F.nullif(F.regexp_extract("hunk", r"(?m)^author (.*)$", 1), F.lit("")).alias("author"),
        F.nullif(_mail(F.regexp_extract("hunk", r"(?m)^author-mail (.*)$", 1)), F.lit("")).alias("email"),
        lines.cast("bigint").alias("n"),
    ).where("sha <> ''")
    return _by_commit(facts)


def blamed_from_records(records: DataFrame) -> DataFrame:
    """``(path, author, email, line_count)`` from ``(path, record)`` parts of dumps in any order, by commit (H8).

    Every header announces one line and names its commit; the first header of a commit names the author. So counts by
    (file, commit) need neither order nor whole files, and combine before they are shuffled. A record's first
    line is content, whatever it looks like, except in a file's first record, which is a full header.
    """
    record = F.col("record")
    opens = record.rlike(SHA) & record.rlike(r"\nauthor ")
    rest = F.when(F.contains(record, F.lit("\n")), F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise("")
    heads = records.where(~F.col("path").startswith("-")).select(
        "path", F.when(opens & ~rest.rlike("(?m)" + SHA), record).otherwise(rest).alias("head")
    )
    facts = heads.select(
        "path",
        F.regexp_extract("head", SHA, 1).alias("sha"),
        F.nullif(F.regexp_extract("head", r"(?m)^author (.*)$", 1), F.lit("")).alias("author"),
        F.nullif(_mail(F.regexp_extract("head", r"(?m)^author-mail (.*)$", 1)), F.lit("")).alias("email"),
        F.lit(1).cast("bigint").alias("n"),
    ).where("sha <> ''")
    return _by_commit(facts)


def blamed_lines(lines: DataFrame, mode: str = "by_commit", chunk: int = FILL_CHUNK) -> DataFrame:
    """``(path, author, email, line_count)`` from dump lines ``(path, pos, line)`` (H8).

    ``by_commit`` credits each content line to the author of its hunk's commit.
    ``carry_forward`` credits it to the last author header above it, whichever commit that was.
    """
    line = F.col("line")
    lines = lines.where(~F.col("path").startswith("-"))
    rows = lines.select(
        "path",
        "pos",
        F.nullif(F.regexp_extract(line, SHA, 1), F.lit("")).alias("sha"),
        F.when(line.startswith("author "), F.substr(line, F.lit(8))).alias("author"),
        F.when(line.startswith("author-mail "), _mail(F.substr(line, F.lit(13)))).alias("email"),
        line.startswith("\t").cast("bigint").alias("n"),
    ).where("sha IS NOT NULL OR author IS NOT NULL OR email IS NOT NULL OR n = 1")
    # parts share no file, so each is summed by itself, without another shuffle where a file is in one task
    if mode == "by_commit":
        counted = map(_by_commit, filled_parts(rows, "path", "pos", ["sha"], chunk, lines))
    elif mode == "carry_forward":
        named = rows.drop("sha").where("author IS NOT NULL OR email IS NOT NULL OR n = 1")
        counted = (
            _line_counts(part.where("n = 1").select(
                "path",
                F.coalesce("author", F.lit("")).alias("author"),
                F.coalesce("email", F.lit("")).alias("email"),
            ))
            for part in filled_parts(named, "path", "pos", ["author", "email"], chunk, lines)
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    return reduce(DataFrame.unionByName, counted)


def _by_commit(facts: DataFrame) -> DataFrame:
    """Sum hunk facts per commit of a file, then per author."""
    commits = facts.groupBy("path", "sha").agg(
        F.sum("n").alias("n"), F.max("author").alias("author"), F.max("email").alias("email")
    )
    return (
        commits.where("n > 0")
        .groupBy("path", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("email", F.lit("")).alias("email"))
        .agg(F.sum("n").alias("line_count"))
    )


def line_counts(blamed: DataFrame, hot_lines: int = HOT_LINES, sized: DataFrame | None = None) -> DataFrame:
    """Count attributed lines ``(path, author, email)``; files with no line drop out.

    Files of up to ``hot_lines`` lines are counted in one task each, so the shares and edges made of the counts need no further
    shuffle by file. The lines of longer files are dealt out by author too. ``sized`` may give a table with about as many rows
    for each path; else the lines are stored, because they are read once more to find the longer files.
    """
    kept = stored(blamed.select("path", "author", "email"), "blamed-lines") if sized is None else blamed
    light, hot = split_heavy(kept, "path", heavy_keys(kept if sized is None else sized, "path", hot_lines))
    counts = _line_counts(light.repartition("path"))
    return counts if hot is None else counts.unionByName(_line_counts(hot))


def _line_counts(blamed: DataFrame) -> DataFrame:
    return blamed.groupBy("path", "author", "email").agg(F.count(F.lit(1)).alias("line_count"))


def ownership_share(counts: DataFrame) -> DataFrame:
    """Add each owner's percentage of the file's lines (H9)."""
    totals = counts.groupBy("path").agg(F.sum("line_count").alias("total"))
    return counts.join(totals, "path").select(
        "path", "author", "email", "line_count",
        (F.col("line_count") / F.col("total") * 100.0).alias("percentage"),
    )


def ranked_owners(shares: DataFrame) -> DataFrame:
    """Add ``rank``: most lines first within each file."""
    return rank_within(shares, "path", [F.desc("line_count"), F.asc("email"), F.asc("author")], "rank")


def persons(counts: DataFrame, entities: DataFrame) -> DataFrame:
    """New ``Person`` entities, one per e-mail not yet in the graph.

    The name is the one with most lines under that e-mail, smallest first on a tie.
    """
    per_name = counts.groupBy("email", "author").agg(F.sum("line_count").alias("n"))
    named = per_name.groupBy("email").agg(
        F.min(F.struct((-F.col("n")).alias("less"), F.col("author").alias("name"))).alias("top")
    )
    known = entities.select(F.col("path").alias("email"))
    return named.join(known, "email", "left_anti").select(
        F.lit("Person").alias("kind"),
        F.col("top.name").alias("name"),
        F.col("email").alias("path"),
        F.lit(None).cast("string").alias("language"),
    )


def ownership_edges(shares: DataFrame, entities: DataFrame, merge: str = "sum") -> DataFrame:
    """``owned_by`` edges from files to persons, confidence = share of lines.

    One e-mail under several names in a file meets the same edge more than once: ``sum`` adds the
    shares, ``last`` keeps the smallest, which is the one written last in descending order.
    """
    if merge not in ("sum", "last"):
        raise ValueError(f"unknown merge: {merge}")
    combine = F.sum if merge == "sum" else F.min
    per_owner = shares.groupBy("path", "email").agg((combine("percentage") / 100.0).alias("confidence"))
    files = entities.where("kind = 'File' AND path IS NOT NULL").select("path", F.col("id").alias("from_id"))
    people = stored(path_index(entities).select(F.col("path").alias("email"), F.col("id").alias("to_id")), "owner-ids")
    # stored, so that an e-mail that owns most files can be split in the join
    owned = stored(per_owner.join(files, "path").select("from_id", "email", "confidence"), "owner-shares")
    return owned.join(people, "email").select(
        "from_id", "to_id", F.lit("owned_by").alias("kind"), "confidence"
    )
