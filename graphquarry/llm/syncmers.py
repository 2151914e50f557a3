"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is lower-cased; its characters without white space are the alphabet, in every script and at every length.
Of all runs of ``K`` characters, a closed syncmer is one whose smallest inner run of ``S`` characters (by hash) is its
first or its last. Whether a run is chosen depends on the run alone, so equal passages choose equal
anchors wherever they stand. The fingerprint is the sequence of anchor hashes in text order, of which equal
neighbours, as in a character repeated at length, count once; likeness is the share of common anchors.

Texts under ``FEW`` characters, where few runs fit, have all inner runs as anchors beside the syncmers. Hashes of inner runs
are even and those of syncmers odd: where only one of two texts has inner runs, syncmers alone are compared.

Nothing leaves the JVM. Most runs are refused after two or three comparisons of inner runs.

Defined cases: null and empty texts, and texts of white space, have no anchor and an empty
fingerprint; two empty fingerprints have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphquarry.llm.common import LOWEST_ID, kept, table, without
from graphquarry.operators.ordered import dense_index

K = 9
S = 2
WINDOW = K - S + 1
FEW = 4 * K  # from here on the first three quarters of a text hold a syncmer
WORD = r"[^\s]+"
NOTHING = 42  # xxhash64 of null, which follows the last character
BLOCK = 32  # neighbours by id that are worked on in one task
TASK_CHARS = 1 << 23  # characters a task is given, so that its chosen runs sort in memory
MOST_TASKS = 20_000


def with_anchors(df: DataFrame, text: str, name: str, keep_places: bool = False) -> DataFrame:
    """Add ``name``, the array of anchor hashes in text order; with ``keep_places``, structs (at, value).

    ``at`` is the number of the word in which the anchor begins, counted from 0, plus the number of the character in it
    in units of 2**-30.
    """
    columns = without(df, name, "c_", "pair_", "place_", "at_", "all_").columns
    df = df.select(*columns)
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    visible = F.regexp_replace(lower, r"\s+", "")
    step = df.withColumn("c_", F.when(visible == "", F.array().cast("array<string>")).otherwise(F.split(visible, "")))
    if keep_places:
        words = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
        inside = lambda w, i: F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda o: i + o * F.lit(2.0**-30))
        step = step.withColumn("place_", F.flatten(F.transform(words, inside)))
    step = step.withColumn("pair_", F.transform("c_", lambda c, i: F.xxhash64(F.xxhash64(c), F.xxhash64(F.get("c_", i + 1)))))
    step = step.drop("c_")
    n = F.size("pair_")
    pair = lambda i: F.get("pair_", i)

    def chosen(first: Column, i: Column) -> Column:  # the cheapest tests that refuse come first
        last = pair(i + (WINDOW - 1))
        inner = [pair(i + j) for j in range(1, WINDOW - 1)]
        at_first, at_last = first <= last, last <= first
        for x in inner:
            at_first = at_first & (first <= x)
        for x in reversed(inner):
            at_last = at_last & (last <= x)
        return (i <= n - K) & (at_first | at_last)

    inner = [*range(0, K - S, S), K - S]  # inner runs that together cover all K characters
    value = lambda i: F.hash(*[pair(i + j) for j in inner]).bitwiseOR(F.lit(1))
    at = F.filter(F.transform("pair_", lambda p, i: F.when(chosen(p, i), i)), lambda i: i.isNotNull())
    step = step.withColumn("at_", at)
    struct = lambda i, v: F.struct(i.alias("at"), v.alias("value"))
    found = F.transform("at_", lambda i: struct(i, value(i)))
    each = F.transform("pair_", lambda p, i: struct(i, F.hash(p).bitwiseAND(F.lit(-2))))
    short = F.array_sort(F.concat(each, found))
    if keep_places:
        step = step.withColumn("all_", F.when(n < FEW, short).otherwise(found))
        anchors = F.filter("all_", lambda a, i: (i == 0) | (a["value"] != F.get("all_", i - 1)["value"]))
        anchors = F.transform(anchors, lambda a: struct(F.get("place_", a["at"]), a["value"]))
    else:
        step = step.withColumn("all_", F.when(n < FEW, short["value"]).otherwise(F.transform("at_", value)))
        anchors = F.filter("all_", lambda v, i: (i == 0) | (v != F.get("all_", i - 1)))
    return step.select(*columns, anchors.alias(name))


def fingerprint(anchors: Column) -> Column:
    """Eight hexadecimal digits per anchor, in text order."""
    digits = lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")
    return F.lower(F.array_join(F.transform(anchors, digits), ""))


def likeness(left: Column, right: Column) -> Column:
    """Common anchors over all distinct anchors of both, 0 to 1; inner runs count if both have them."""
    short = lambda v: F.coalesce(F.get(v, F.lit(0)).bitwiseAND(F.lit(1)) == 0, F.lit(False))
    syncmers = lambda v: F.filter(v, lambda a: a.bitwiseAND(F.lit(1)) == 1)
    one = (short(left) != short(right)) & (F.size(left) > 0) & (F.size(right) > 0)
    left, right = (F.when(one & short(v), syncmers(v)).otherwise(v) for v in (left, right))
    every = F.size(F.array_union(left, right))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(every, F.lit(1)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``anchors`` with their places, and ``fingerprint``."""
    docs = without(docs, "anchors", "fingerprint")
    found = with_anchors(docs, text, "anchors", keep_places=True)
    return found.withColumn("fingerprint", fingerprint(F.transform("anchors", lambda a: a["value"])))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows by id and by two hashes of id and text: copies of one row share all three."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST_ID)).alias("key"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.select("*", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def _seats(rows: DataFrame) -> DataFrame:
    """Deal rows into blocks of neighbours by id: ``(key, h1, h2, block, spot, owner, copies, need)``.

    Every row is the owner of one seat. The row that follows it sits at the next spot of the same block: as an owner, or as a guest where
    a block ends. Rows of an id that several texts share have blocks of their own, as many as they fill, so no block
    exceeds a small number of rows. ``need`` is the longest opening that is asked of a row in that block. No text is moved.
    """
    of = ["key", "h1", "h2"]
    texts = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("copies"), F.floor(F.max(F.length("text")) / 4).cast("int").alias("ask"))
    texts = kept(texts, "syncmers-rows")
    first = F.min(F.struct("h1", "h2")).alias("first")
    ids = kept(texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), first), "syncmers-ids")
    shared = ids.where("texts > 1").select("key")
    if not shared.isEmpty():  # the smallest of several texts stands for its id as a successor
        least = rows.join(shared, "key", "left_semi").groupBy("key").agg(F.min(F.struct("text", "h1", "h2")).alias("least"))
        least = least.select("key", F.struct("least.h1", "least.h2").alias("stands"))
        ids = ids.join(least, "key", "left").select("key", "texts", F.coalesce("stands", "first").alias("first"))
    order = kept(dense_index(ids, [F.asc("key")], "place"), "syncmers-order")
    total = F.lit(order.count())
    part = F.pmod(F.col("h1"), F.ceil(F.col("texts") / BLOCK).cast("long"))
    block = F.when(F.col("texts") == 1, F.xxhash64(F.floor(F.col("place") / BLOCK))).otherwise(F.xxhash64("place", part))
    owners = kept(
        texts.join(order.drop("first"), "key").select(*of, block.alias("block"), F.col("place").alias("spot"), "copies", "ask", "texts"),
        "syncmers-owners",
    )
    # one row per block and spot asks for the next spot; the last place asks for the first, seated behind it
    asked = owners.groupBy("block", (F.col("spot") + 1).alias("spot")).agg(F.max("ask").alias("need"))
    given = order.select(F.col("place"), "key", "first.h1", "first.h2")
    asked = asked.withColumn("place", F.pmod(F.col("spot"), F.greatest(total, F.lit(1)))).join(given, "place")
    seats = owners.select(*of, "block", "spot", F.lit(True).alias("owner"), "copies", F.lit(0).alias("need")).unionByName(
        asked.select(*of, "block", "spot", F.lit(False).alias("owner"), F.lit(0).cast("long").alias("copies"), "need")
    )
    # an owner that is also asked for in its own block sits there once
    both = seats.groupBy(*of, "block", "spot").agg(F.max("owner").alias("owner"), F.max("copies").alias("copies"), F.max("need").alias("need"))
    return kept(both.withColumn("seat", F.monotonically_increasing_id()), "syncmers-seats")


def _next(value: Column) -> Column:
    """``value`` of the row at the next spot of the block that is asked for there."""
    return F.first(F.when(F.col("need") >= 0, value), ignorenulls=True).over(
        Window.partitionBy("block").orderBy("spot").rangeBetween(1, 1))


def _seated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every row once in its block, guests beside, with the opening of its successor."""
    rows = _rows(docs, doc_id, text)
    seats = _seats(rows)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, min(-(-chars // TASK_CHARS), MOST_TASKS))
    once = rows.groupBy("key", "h1", "h2").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    dealt = once.join(seats, ["key", "h1", "h2"]).repartition(parts, "block")
    opening = F.expr("substring(text, 1, need)")
    found = dealt.withColumn("n_chars", F.length("text").cast("long")).withColumn("opening", _next(opening))
    return found.withColumn("opening", F.expr("substring(opening, 1, CAST(floor(n_chars / 4) AS INT))"))


def with_successor(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its length and the opening characters of the next document by id that a quarter of its own
    length asks for; after the last comes the first.

    Only ids, hashes and lengths are sorted. Texts are dealt into blocks of ``BLOCK`` neighbours by id, of which the first of the next
    block is a guest, so what follows a text lies in the same task.

    Defined cases: a null id counts as the smallest; rows that share an id all precede the next id,
    and as somebody's successor the one with the smallest text stands for them; a single id follows itself.
    """
    owners = _seated(docs, doc_id, text).where("owner").withColumn("copy_", F.explode(F.expr("sequence(1, copies)")))
    return owners.select("doc_id", "text", "n_chars", "opening")


def _visible(text: str) -> Column:
    return F.regexp_replace(F.lower(F.col(text)), r"\s+", "")


def _hashes(visible: str) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(F.col(visible) == "", none).otherwise(F.transform(F.split(visible, ""), lambda c: F.xxhash64(c)))


def _pairs(hashes: str) -> Column:
    """Hashes of all pairs of neighbouring characters, the last one's with nothing."""
    after = F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1)))
    return F.zip_with(hashes, after, lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(NOTHING).cast("long"))))


def _positions(first: Column, n: Column) -> Column:
    """Places of runs from ``first`` on, and for texts under ``FEW`` characters those of inner runs as ``-1 - place``."""
    none = F.array().cast("array<int>")
    runs = F.when(n >= K, F.sequence(first, first + n - K)).otherwise(none)
    return F.concat(runs, F.when((n > 0) & (n < FEW), F.sequence(-first - n, -first - 1)).otherwise(none))


def edited_anchors(seated: DataFrame) -> DataFrame:
    """``anchors`` and ``edited_anchors`` of all seated rows, made from one row per place in compiled code.

    A run is chosen by itself alone. So the edited text has the anchors of the runs that end before the cut, and only what lies behind
    is looked at again; if lower-casing across the cut changes what precedes it, all of it. Chosen runs are collected per
    row in the task that holds its block, as numbers that sort by place.
    """
    quarter = F.expr("CAST(floor(n_chars / 4) AS INT)")
    rows = seated.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - CAST(floor(n_chars / 4) AS INT)), opening)"))
    rows = rows.withColumn("edited", F.when(F.col("owner"), F.col("edited")).otherwise("")).withColumn("quarter", quarter)
    rows = rows.withColumn("head", F.expr("substring(text, 1, CAST(n_chars AS INT) - quarter)"))
    rows = rows.select(
        "block", "seat", "spot", "owner", "need", "copies", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
        _visible("text").alias("v"), _visible("edited").alias("w"), F.length(_visible("head")).alias("head"),
    )
    rows = rows.withColumn("n", F.length("v")).withColumn("m", F.length("w"))
    same = (F.col("m") >= FEW) & F.expr("substring(v, 1, head) = substring(w, 1, head)")
    rows = rows.withColumn("cut", F.when(same, F.greatest(F.col("head") - (K - 1), F.lit(0))).otherwise(0))
    rows = rows.withColumn("w", F.expr("substring(w, cut + 1)"))
    meta = F.struct("spot", "owner", "need", "copies", "doc_id", "n_chars", "sha", "n", "cut")
    tail = F.col("m") - F.col("cut")
    tail_runs = F.when(tail >= K, F.sequence(F.col("n"), F.col("n") + tail - K)).otherwise(F.array().cast("array<int>"))
    places = F.concat(
        F.array(F.lit(None).cast("int")), _positions(F.lit(0), F.col("n")),
        F.when(F.col("m") < FEW, _positions(F.col("n"), F.col("m"))).otherwise(tail_runs),
    )
    each = rows.select("block", "seat", meta.alias("meta"), places.alias("places"), _hashes("v").alias("v"), _hashes("w").alias("w"))
    each = each.select("block", "seat", "meta", "places", F.concat(_pairs("v"), _pairs("w")).alias("p"))
    each = each.select("block", "seat", "meta", "p", F.explode_outer("places").alias("t"))
    t = F.col("t")
    pair = lambda j: F.get("p", t + j)
    # little code: compiled methods beyond 8,000 bytes are interpreted by the JVM
    least = F.array_min(F.slice("p", t + 1, WINDOW))
    edge = (least == pair(0)) | (least == pair(WINDOW - 1))
    inner = F.hash(F.get("p", -1 - t)).bitwiseAND(F.lit(-2))
    run = F.hash(*[pair(j) for j in (*range(0, K - S, S), K - S)]).bitwiseOR(F.lit(1))
    value = F.when(t < 0, inner).otherwise(run).cast("long") + F.lit(1 << 31)
    place = F.when(t < 0, -1 - t).otherwise(t).cast("long")
    found = each.where(F.when(t >= 0, edge).otherwise(True)).select(
        "block", "seat", F.when(t.isNull(), F.col("meta")).alias("meta"), (place * F.lit(1 << 32) + value).alias("a")
    )
    rows = found.groupBy("block", "seat").agg(F.first("meta", ignorenulls=True).alias("meta"), F.sort_array(F.collect_list("a")).alias("a"))
    rows = rows.select("block", "seat", "meta.*", "a")
    limit = F.col("n").cast("long") * F.lit(1 << 32)
    bound = F.col("cut").cast("long") * F.lit(1 << 32)
    own = F.filter("a", lambda a: a < limit)
    # all places of the text precede those of the edited tail, so one filter keeps the order
    after = F.filter("a", lambda a: (a >= limit) | ((a < bound) & (a.bitwiseAND(F.lit(1)) == 1)))
    plain = lambda v: F.transform(v, lambda a: (a.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    rows = rows.withColumns({"anchors": plain(own), "edited_anchors": plain(after)}).drop("a")
    once = lambda c: F.filter(c, lambda v, i: (i == 0) | (v != F.get(c, i - 1)))
    return rows.withColumns({"anchors": once("anchors"), "edited_anchors": once("edited_anchors")})


def query(spark, sf_dir: str) -> DataFrame:
    rows = edited_anchors(_seated(table(spark, sf_dir, "documents"), "doc_id", "text"))
    rows = rows.withColumn("next_anchors", _next(F.col("anchors"))).where("owner")
    out = rows.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"), "copies",
    )
    return out.withColumn("copy_", F.explode(F.expr("sequence(1, copies)"))).drop("copies", "copy_")
