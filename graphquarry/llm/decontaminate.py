"""Benchmark decontamination: documents scanned for windows of benchmark words.

The windows of all benchmark items form a hash set that is sent to every task once its size is
checked. Document words become vocabulary numbers; runs of known words get a rolling hash per window
length, hash hits are compared word by word, and verified hits mark words, spans and items.

Defined cases: a null or empty text has no words and is clean; an item without words has no window;
a repeated item id counts once; a null item id is written as the empty string; columns of the input
that carry the names of result columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, kept, slices, table, without

WINDOW = 10
#: Characters of benchmark text whose windows one task may hold at a time.
BLOCK_CHARS = 16_000_000
RESULT = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")
SCAN = pa.struct([
    ("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("runs", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))),
])
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of digits, Latin letters and non-ASCII characters."""
    return data.translate(_FOLD).split() if data else []


class Windows:
    """The windows of some benchmark items, by length, as numbers of a vocabulary of their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.owners: dict[bytes, set[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for name, text in items:
            found = words(text)
            if not found:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in found], np.int32)
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                key = ids[i : i + length].tobytes()
                self.owners.setdefault(key, set()).add(name)
                by_length.setdefault(length, set()).add(key)
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        self.hashes = {
            n: np.unique(self._hash(list(np.stack([np.frombuffer(k, np.int32) for k in keys]).T)))
            for n, keys in by_length.items()
        }

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for factor, column in zip(self.factors, columns, strict=False):
            total += column.astype(np.uint64) * factor
        return total

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """Every occurrence as (first word, word after the last, items); 0 marks unknown words."""
        found = []
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            value = self._hash([ids[starts + j] for j in range(length)])
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for start in starts[hashes[at] == value].tolist():
                owners = self.owners.get(ids[start : start + length].tobytes())
                if owners:
                    found.append((start, start + length, owners))
        return found

    def scan(self, texts: list[bytes | None]) -> list[dict]:
        split = [words(t) for t in texts]
        # one unknown word after each text keeps windows inside their own text
        ids = np.fromiter(
            chain.from_iterable(chain(map(self.number.get, w, repeat(0)), (0,)) for w in split),
            np.int32, sum(map(len, split)) + len(split),
        )
        first = np.cumsum([0] + [len(w) + 1 for w in split])
        out = [{"n_words": len(w), "item_ids": [], "runs": []} for w in split]
        marked: dict[int, tuple[set[str], list[tuple[int, int]]]] = {}
        for start, stop, owners in self.hits(ids):
            row = int(np.searchsorted(first, start, "right")) - 1
            names, ranges = marked.setdefault(row, (set(), []))
            names |= owners
            ranges.append((start - int(first[row]), stop - int(first[row])))
        for row, (names, ranges) in marked.items():
            runs: list[list[int]] = []
            for start, stop in sorted(ranges):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            out[row] |= {"item_ids": sorted(names), "runs": [{"first": a, "stop": b} for a, b in runs]}
        return out


def _scanner(items: list[tuple[str, bytes]], docs: DataFrame, window: int):
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @arrow_udf(from_arrow_type(SCAN))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Windows(sent.value, window)
        for texts in batches:
            for part in slices(texts):
                yield pa.array(index.scan(part), SCAN)

    return scan


@arrow_udf(from_arrow_type(SPANS))
def char_spans(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Code point ranges of word ranges."""
    out = []
    for text, ranges in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
        places = [m.span() for m in _WORD.finditer(text)] if text and ranges else []
        out.append([{"start": places[r["first"]][0], "stop": places[r["stop"] - 1][1]} for r in ranges or ()])
    return pa.array(out, SPANS)


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """One loader for each block, so that blocks are not held together."""
    named = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name_"), F.col(text).alias("text_")
    ).where("text_ is not null")
    n = -(-(named.agg(F.sum(F.length("text_"))).first()[0] or 0) // limit) or 1

    def load(k: int) -> list[tuple[str, bytes]]:
        part = named.where(F.pmod(F.xxhash64("name_"), F.lit(n)) == k) if n > 1 else named
        return [(r["name_"], r["text_"].encode()) for r in part.collect()]

    return [lambda k=k: load(k) for k in range(n)]


def _merged(runs: Column) -> Column:
    """Overlapping or touching word ranges joined."""
    empty = F.array().cast("array<struct<first:int,stop:int>>")

    def step(done, run):
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["stop"], run["stop"]).alias("stop"))),
        )
        touches = (F.size(done) > 0) & (run["first"] <= F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(touches, grown).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), empty, step)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Add word counts, hit words, hit items and hit spans to every document.

    Benchmark text up to ``block_chars`` characters goes to all tasks at once. A larger benchmark is
    cut into blocks of that size by item id; each block scans all documents in a job of its own
    and keeps only hits, which then meet by row, so no task holds more than one block.
    """
    bounded_batches(docs)
    docs = without(docs, *RESULT)
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    if len(blocks) == 1:
        scanned = docs.withColumn("scan_", _scanner(blocks[0](), docs, window)(F.col(text)))
        found = scanned.select(*docs.columns, "scan_.*")
    else:
        placed = kept(docs.withColumn("row_", F.monotonically_increasing_id()), "decontaminate-docs")
        parts = [
            kept(
                placed.select("row_", _scanner(block(), docs, window)(F.col(text)).alias("scan_"))
                .select("row_", "scan_.*").where("size(item_ids) > 0"),
                "decontaminate-hits",
            )
            for block in blocks
        ]
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        merged = kept(
            hits.groupBy("row_").agg(
                F.flatten(F.collect_list("item_ids")).alias("item_ids"),
                F.flatten(F.collect_list("runs")).alias("runs"),
            ).select("row_", F.array_sort("item_ids").alias("item_ids"), _merged(F.col("runs")).alias("runs")),
            "decontaminate-merged",
        )
        counted = placed.withColumn("n_words", _scanner([], docs, window)(F.col(text))["n_words"])
        found = counted.join(merged, "row_", "left").select(
            *docs.columns, "n_words",
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("runs", F.array().cast("array<struct<first:int,stop:int>>")).alias("runs"),
        )
    n_hit = F.aggregate("runs", F.lit(0), lambda n, r: n + r["stop"] - r["first"]).cast("long")
    return found.select(
        *docs.columns, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        "item_ids", char_spans(F.col(text), F.col("runs")).alias("spans"),
        (F.size("item_ids") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Documents without benchmark passages: hit documents dropped, or hit spans cut out of their text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    # the input row rides along whole, so that none of its columns can clash with the operator's
    slim = docs.select(F.struct(*docs.columns).alias("row_"), F.col(text).alias("text_"))
    found = contamination(slim, benchmark, text="text_", **options)
    if remove == "documents":
        return found.where("NOT contaminated").select("row_.*")

    def cut(state, span):
        return F.struct(
            F.concat(state["done"], F.substring(F.col("text_"), state["at"] + 1, span["start"] - state["at"])).alias("done"),
            span["stop"].alias("at"),
        )

    left = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), cut,
        lambda s: F.concat(s["done"], F.substring(F.col("text_"), s["at"] + 1, F.length("text_"))),
    )
    whole = F.when(F.col("contaminated"), left).otherwise(F.col("text_")).alias(text)
    return found.select(*[whole if c == text else F.col("row_")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )
