"""Line deduplication over all documents, in DataFrame expressions only.

A text is cut at line feeds. A line's key is the line without white space at its ends, A-Z lower-cased. Keys are
exploded with their places and hashed, distinct documents are counted per hash, and lines whose key stands in enough
documents go everywhere but in the document with the smallest id that holds it. What stays is put together by place.

Only hashes, ids and places move through the counting shuffles; texts move once, to meet the places of their dropped
lines. Counts are combined before they are shuffled. The table of shared keys has one row per key and is stored before
lines meet it, so adaptive execution can split the lines of a very common key.

Hashes are the first 128 bits of SHA-256: for a trillion different lines the chance that any two agree is about 1e-15.

Defined cases: a null or empty text is one empty line; keys below ``min_chars`` code points are never dropped, nor are
repeats within one document by themselves; a null id counts as the smallest; rows that share an id are one
document, so they never count as two and all lose the same keys; result columns replace input columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.functions.text import let
from graphquarry.llm.common import LOWEST_ID, kept, table, without

MIN_DOCS = 2
MIN_CHARS = 10
RESULT = ("n_lines", "n_dropped", "kept_text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"
#: Characters other than A-Z that full lower-casing might change.
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased; the full mapping is far faster and used where it does the same."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_SPACE)))


def _hashed(line: Column, min_chars: int) -> Column:
    digest = lambda key: F.unhex(F.substring(F.sha2(key, 256), 1, 32))
    return let(F.btrim(line, F.lit(_SPACE)), lambda bare: F.when(F.length(bare) >= min_chars, digest(lower_ascii(bare))))


def _without_places(lines: Column, places: Column) -> Column:
    """``lines`` without those at the sorted 0-based ``places``, in time linear in both.

    The places become one flag per line, as runs; cutting stretches out of ``lines`` would copy all of it for each.
    """
    before = lambda k: F.when(k == 0, -1).otherwise(F.get(places, k - 1))
    run = lambda k: F.concat(F.array_repeat(F.lit(True), F.get(places, k) - before(k) - 1), F.array(F.lit(False)))
    flags = F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - 1), run))  # nothing after the last place
    stays = lambda known: F.filter(lines, lambda _, i: F.coalesce(F.get(known, i), F.lit(True)))
    return let(flags, stays)


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(hash_, first_)``: hashes in at least ``min_docs`` documents and the smallest id of them."""
    each = lines.select("hash_", "id_").distinct()
    counted = each.groupBy("hash_").agg(F.count(F.lit(1)).alias("n_"), F.min("id_").alias("first_"))
    return counted.where(F.col("n_") >= min_docs).select("hash_", "first_")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Add ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``."""
    # texts of rows that share an id are told apart by their own hash
    marks = {"id_": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST_ID)), "row_": F.xxhash64(F.coalesce(text, F.lit("")))}
    # the row's hash is made once, inside: beside the exploded array the text would travel along with every line
    hashed = lambda row: F.transform(lines_of(F.col(text)), lambda line, i: F.struct(
        row.alias("row_"), i.alias("at_"), _hashed(line, min_chars).alias("hash_")))
    found = F.filter(let(marks["row_"], hashed), lambda x: x["hash_"].isNotNull())
    exploded = docs.select(marks["id_"].alias("id_"), F.explode(found).alias("line_")).select("id_", "line_.*")
    lines = kept(exploded, "line-hashes")
    shared = kept(shared_lines(lines, min_docs), "line-shared")
    dropped = (
        lines.join(shared, "hash_").where("id_ <> first_")
        .groupBy("id_", "row_").agg(F.sort_array(F.collect_set("at_")).alias("places_"))
    )
    rows = without(docs, *RESULT)
    names = rows.columns
    met = rows.withColumns(marks).join(dropped, ["id_", "row_"], "left")
    lines, places = lines_of(F.col(text)), F.col("places_")
    out = met.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long"),
        "kept_text": F.when(places.isNull(), F.coalesce(text, F.lit("")))
        .otherwise(let(lines, lambda cut: F.array_join(_without_places(cut, places), "\n"))),
    })
    return out.select(*names, *RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
