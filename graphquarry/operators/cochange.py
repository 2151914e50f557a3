"""Files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.operators.ordered import dense_index, heavy_keys, split_heavy
from graphquarry.operators.resolve import path_index
from graphquarry.session import stored

BLOCK_FILES = 2048
#: Changes of a file whose pairs are counted in one task at most.
HOT_CHANGES = 1 << 14
#: Big commits sent to all tasks at most.
SENT_COMMITS = 100_000
#: Files whose pairs are counted first, for a least value of the greatest count.
SEED_FILES = 500
#: Files sent to all tasks at most.
SENT_FILES = 100_000


def path_codes(changes: DataFrame) -> DataFrame:
    """``(path, code)``: every changed path with its number in path order, so codes compare as their paths do."""
    paths = changes.where("path IS NOT NULL").select("path").distinct()
    return stored(dense_index(paths, [F.asc("path")], "code"), "cochange-codes")


def cochange_pairs(changes: DataFrame, block_files: int = BLOCK_FILES, codes: DataFrame | None = None) -> DataFrame:
    """``(file_a, file_b, count)`` over all commits, ``file_a <= file_b`` (H5).

    Equals counting every pair of change positions: a path listed ``n`` times in a commit meets
    another listed ``m`` times in ``n*m`` pairs and itself in ``n(n-1)/2``. The pairs of a commit
    are the result itself, so none may be left out; what is bounded is the share of one task.
    Commits of up to ``block_files`` changes are put together in one row each, where every change is followed by a slice of
    the later ones: a slice, not a row per pair, moves to the task of its first file, which counts all pairs of that file. So the result
    is dealt out by ``file_a``, but for files of more than ``HOT_CHANGES`` changes, whose pairs are dealt out by both files. Larger
    commits are cut into hashed blocks and every block pair joins under its own
    key, so a commit holding a third of all rows spreads over the cluster. With ``codes``, the table of
    :func:`path_codes`, the files of a pair are numbers: pairs far outnumber changes, and two numbers move
    through their shuffles where two paths would.
    """
    rows = changes.where("hash IS NOT NULL").select("hash", "path")
    if codes is not None:
        # joined on the left side as it comes, so that the changes of a hot path can be split
        rows = rows.join(codes, "path").select("hash", F.col("code").alias("path"))
    rows = stored(rows, "cochange-rows")
    kind = rows.schema["path"].dataType
    # a number takes four bytes of a slice where that is enough
    short = "int" if codes is not None and codes.count() < 1 << 31 else kind
    big = heavy_keys(rows, "hash", block_files, max(1 << 10, min(1 << 20, 4 * rows.count() // block_files)))
    plain, wide = split_heavy(rows, "hash", big)
    slices = _slices(plain, short, kind)
    if wide is not None:
        slices = slices.unionByName(_big_slices(wide, block_files, short))
    light, hot = split_heavy(slices, "file_a", None if (found := heavy_keys(rows, "path", HOT_CHANGES)) is None else found.withColumnRenamed("path", "file_a"))
    counted = _summed(light.repartition("file_a"), kind)
    return counted if hot is None else counted.unionByName(_summed(hot, kind))


def _slices(changes: DataFrame, short, kind) -> DataFrame:
    """``(file_a, rest, weight)``: each change of a commit with the paths that follow it in order, once per pair of changes."""
    listed = F.sort_array(F.collect_list(F.col("path").cast(short)))
    commits = changes.repartition("hash").groupBy("hash").agg(listed.alias("paths")).where(F.size("paths") > 1)
    at = commits.select("paths", F.explode(F.sequence(F.lit(1), F.size("paths") - 1)).alias("at"))
    rest = F.slice("paths", F.col("at") + 1, F.size("paths") - F.col("at"))
    return at.select(F.element_at("paths", F.col("at")).cast(kind).alias("file_a"), rest.alias("rest"), F.lit(1).cast("bigint").alias("weight"))


def _big_slices(changes: DataFrame, block_files: int, short) -> DataFrame:
    """The pairs of commits of many changes as :func:`_slices` of one path each."""
    return _listed_pairs(_listed(changes), block_files).select(
        F.least("a", "b").alias("file_a"), F.array(F.greatest("a", "b").cast(short)).alias("rest"), _weight().alias("weight")
    )


def _summed(slices: DataFrame, kind) -> DataFrame:
    pairs = slices.select("file_a", F.explode("rest").alias("file_b"), "weight")
    return pairs.groupBy("file_a", F.col("file_b").cast(kind).alias("file_b")).agg(F.sum("weight").alias("count"))


def _listed(changes: DataFrame) -> DataFrame:
    listed = changes.groupBy("hash", "path").agg(F.count(F.lit(1)).alias("n"))
    return stored(listed, "cochange-listed")


def _listed_codes(changes: DataFrame, codes: DataFrame) -> DataFrame:
    # joined on the left side as it comes, so that the changes of a hot path can be split
    coded = changes.select("hash", "path").join(codes, "path").select("hash", F.col("code").alias("path"))
    return _listed(coded)


def _listed_pairs(listed: DataFrame, block_files: int) -> DataFrame:
    big = stored(
        listed.groupBy("hash").agg(F.count(F.when(F.col("n") > 0, True)).alias("k"))
        .where(F.col("k") > block_files)
        .select("hash", F.ceil(F.col("k") / block_files).alias("blocks")),
        "cochange-big",
    )
    n_big = big.count()
    if n_big == 0:
        return _plain_pairs(listed)
    # sent where it is small, so that a big commit is dealt to blocks before anything moves by its hash
    placed = listed.join(F.broadcast(big) if n_big <= SENT_COMMITS else big, "hash", "left")
    return _plain_pairs(placed.where("blocks IS NULL")).unionByName(_block_pairs(placed.where("blocks IS NOT NULL")))


def _counted_pairs(listed: DataFrame, block_files: int) -> DataFrame:
    pairs = _listed_pairs(listed, block_files)
    return (
        pairs.groupBy(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"))
        .agg(F.sum(_weight()).alias("count"))
    )


def _weight() -> Column:
    return F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))


def pair_bounds(listed: DataFrame) -> DataFrame:
    """``(path, bound)``: no pair with the path counts more. A commit adds at most the path's own listings times the most of any path."""
    most = stored(
        listed.groupBy("hash").agg(F.max("n").alias("most")).where(F.col("most") > 1), "cochange-repeats"
    )
    n_most = most.count()
    if n_most == 0:
        placed = listed.withColumn("most", F.lit(1))
    else:
        placed = listed.join(F.broadcast(most) if n_most <= SENT_COMMITS else most, "hash", "left")
    return placed.groupBy("path").agg(F.sum(F.col("n") * F.coalesce("most", F.lit(1))).alias("bound"))


def strong_pairs(
    changes: DataFrame, threshold: float, seed_files: int = SEED_FILES, block_files: int = BLOCK_FILES,
    codes: DataFrame | None = None,
) -> DataFrame:
    """``(file_a, file_b, count, confidence)`` of the pairs of at least ``threshold`` of the greatest count (H5, H6, V4).

    The rows :func:`cochange_pairs` has at that confidence, without making the others. The exact counts among the
    ``seed_files`` files of the highest bounds give a least value of the greatest count; a file whose own bound
    is under ``threshold`` of that is in no such pair, so its rows drop out before commits join with themselves. The greatest
    count itself is among the pairs that stay. ``codes`` are as in :func:`cochange_pairs`.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share of the greatest count")
    listed = _listed(changes) if codes is None else _listed_codes(changes, codes)
    bounds = stored(pair_bounds(listed), "cochange-bounds")
    seeds = bounds.orderBy(F.desc("bound"), "path").limit(seed_files).select("path")
    among = _counted_pairs(stored(listed.join(F.broadcast(seeds), "path", "left_semi"), "cochange-seeds"), block_files)
    least = threshold * (among.agg(F.max("count")).first()[0] or 0)
    strong = stored(bounds.where(F.col("bound") >= least).select("path"), "cochange-strong")
    sent = F.broadcast(strong) if strong.count() <= SENT_FILES else strong
    kept = stored(listed.join(sent, "path", "left_semi").select("hash", "path", "n"), "cochange-kept")
    pairs = stored(_counted_pairs(kept, block_files), "cochange-pairs")
    return cochange_confidence(pairs).where(F.col("confidence") >= threshold)


def _side(rows: DataFrame, suffix: str, *rest: Column | str) -> DataFrame:
    return rows.select("hash", F.col("path").alias(suffix), F.col("n").alias(f"n_{suffix}"), *rest)


def _ordered() -> Column:
    """Each unordered pair once; a path pairs with itself only where it is listed again."""
    return (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n_a") > 1))


def _plain_pairs(listed: DataFrame) -> DataFrame:
    both = _side(listed, "a").join(_side(listed, "b"), "hash")
    return both.where(_ordered()).select("a", "n_a", "b", "n_b")


def _block_pairs(listed: DataFrame) -> DataFrame:
    placed = listed.withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")))
    left = _side(placed, "a", F.col("own").alias("i"),
                 F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = _side(placed, "b", F.col("own").alias("j"),
                  F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    both = left.join(right, ["hash", "i", "j"]).where((F.col("i") < F.col("j")) | _ordered())
    return both.select("a", "n_a", "b", "n_b")


def cochange_confidence(pairs: DataFrame) -> DataFrame:
    """Add ``confidence = count / greatest count`` (H6); the maximum is a scalar subquery."""
    top = pairs.agg(F.max("count").alias("top")).scalar()
    return pairs.withColumn("confidence", F.col("count") / top)


def ranked_cochanges(pairs: DataFrame) -> DataFrame:
    """Most frequent pairs first, in a total order (H7)."""
    return pairs.orderBy(F.desc("count"), "file_a", "file_b")


def cochange_edges(scored: DataFrame, entities: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``co_changes_with`` edges of pairs whose two paths are both in the graph (H12). ``codes`` are those of the pairs."""
    ids = path_index(entities).select("path", "id")
    if codes is not None:
        ids = ids.join(codes, "path").select(F.col("code").alias("path"), "id")
    ids = stored(ids, "cochange-paths")
    a = ids.select(F.col("path").alias("file_a"), F.col("id").alias("from_id"))
    b = ids.select(F.col("path").alias("file_b"), F.col("id").alias("to_id"))
    return scored.join(a, "file_a").join(b, "file_b").select(
        "from_id", "to_id", F.lit("co_changes_with").alias("kind"), "confidence"
    )
