"""Near-duplicate documents: MinHash bands propose, Bayesian tests on signature batches prune, full sets decide.

A document is its set of distinct five-word shingles. One pass over the texts gives each set a key, band
hashes and a second, independent signature of one byte per hash. Equal sets become one node. Nodes that
share a band bucket are candidates. Tasks compare the signatures of a bucket's members batch by batch: after
each batch the posterior of the similarity, from a flat prior, says how likely the threshold still is, and
below the chosen miss probability the pair is dropped. Survivors are verified on their full shingle
sets, so no false link remains. The number of bands is chosen so that a pair at the threshold is missed
with as small a probability.

Links make components, and pairs inside one component need no test. So rounds hand over survivors
sparingly: first only a forest of each bucket of the first bands, likeliest pairs first, which already joins most
of a large group once instead of once per band; then a forest of the other buckets; then the likeliest few
between any two components; then all that still join two components. A bucket that holds one component is finished. A large
bucket is cut into blocks and compared block by block, each pair of blocks in a group of its own; rounds that
look for forests take each block with itself and with one other. A pair is handed over by the first band its nodes
share only. Nothing has a cap.

Defined cases: null texts and texts without words have no shingle and are linked with nothing; shorter texts
than a shingle are one shingle; a null id counts as the smallest id and stays null in the result; rows that
share an id are one document. Columns named like results are replaced.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import LOWEST_ID, bounded_batches, kept, slices, table, without
from graphquarry.llm.components import components

SHINGLE_WORDS = 5
BAND_ROWS = 5
BATCHES, BATCH = 4, 64
#: Members of a bucket that are compared as one block.
BLOCK = 512
#: By round: the bands whose buckets are compared (none: all), and the survivors handed over for two components (0: a forest, none: all).
ROUNDS = ((2, 0), (None, 0), (None, 8), (None, None))
#: Ids or buckets sent to all tasks at most (8 bytes each); beyond it texts, signatures and bands are joined by shuffle.
SENT_IDS = 1_000_000
RESULT = ("n_shingles", "component_id", "kept")


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``percent`` per cent, and the probability to miss a pair at that bound."""

    percent: int = 80
    miss: float = 1e-5
    batch_miss: float = 1e-4

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** BAND_ROWS))


def words(data: bytes | None) -> list[bytes]:
    return data.lower().split() if data else []  # of bytes: A-Z, and the six ASCII white-space characters


_RNG = np.random.default_rng(20240229)
_STEP = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    found = words(data)
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    if len(w) < SHINGLE_WORDS:
        h = (w * _SHORT[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))
    else:
        n = len(w) - SHINGLE_WORDS + 1
        h = w[:n] * _STEP[0]
        for j in range(1, SHINGLE_WORDS):
            h += w[j : n + j] * _STEP[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


class Hasher:
    """Minimal hashes of a set: bands for candidates, bytes for the Bayesian test."""

    def __init__(self, bands: int) -> None:
        rng = np.random.default_rng(77)
        self.bands = bands
        n = bands * BAND_ROWS + BATCHES * BATCH
        self.factor = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        self.mixer = rng.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) | np.uint64(1)

    def minima(self, found: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        short = (found >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 1024):
            block = np.multiply.outer(self.factor, short[i : i + 1024])
            block += self.shift[:, None]
            np.minimum(low, block.min(axis=1), out=low)
        return low

    def features(self, data: bytes | None) -> dict:
        from xxhash import xxh3_128_digest

        found = shingles(data)
        if not len(found):
            return {"n_shingles": 0, "set_key": None, "bands": [], "signature": b""}
        low = self.minima(found)
        rows = low[: self.bands * BAND_ROWS].reshape(self.bands, BAND_ROWS).astype(np.uint64)
        keys = (rows * self.mixer).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
        return {
            "n_shingles": len(found), "set_key": xxh3_128_digest(found.tobytes()), "bands": keys.view(np.int64).tolist(),
            "signature": (low[self.bands * BAND_ROWS :] >> np.uint32(7)).astype(np.uint8).tobytes(),
        }


FEATURES = pa.struct([
    ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
])


def least_matches(at_least: float, miss: float) -> list[int]:
    """For 1, 2, ... batches: the fewest equal bytes with which P(similarity >= at_least) is not below ``miss``."""
    grid = (np.arange(4000) + 0.5) / 4000
    equal = grid + (1 - grid) / 256  # unequal minima share a byte by chance
    out = []
    for n in range(BATCH, BATCHES * BATCH + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(equal) + (n - m) * np.log1p(-equal)
            weight = np.exp(logs - logs.max())
            if weight[grid >= at_least].sum() >= miss * weight.sum():
                break
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, needed: list[int], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of two signature tables that stay possible, and their equal bytes; ``open_`` masks pairs to compare.

    The first batch is compared for all pairs, later ones for those still alive.
    """
    i, j = np.nonzero(open_)
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        for at in range(0, len(i), 1 << 15):
            to = slice(at, at + (1 << 15))
            matches[to] += (left[i[to], part] == right[j[to], part]).sum(1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j, matches


def handed_over(left: np.ndarray, right: np.ndarray, matches: np.ndarray, share: int | None) -> np.ndarray:
    """Which survivors to verify now, given the components of their ends: a forest (0), the best few, or all."""
    if share is None or not len(left):
        return np.arange(len(left))
    best = np.argsort(-matches, kind="stable")
    if share:
        counts: dict[tuple[int, int], int] = {}
        out = []
        for k in best.tolist():
            ends = (left[k], right[k]) if left[k] < right[k] else (right[k], left[k])
            counts[ends] = counts.get(ends, 0) + 1
            if counts[ends] <= share:
                out.append(k)
        return np.array(out)
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for k, a, b in zip(best.tolist(), left[best].tolist(), right[best].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            top[a] = b
            out.append(k)
    return np.array(out)


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= percent * (len(left) + len(right) - common)


def _feature_udf(bands: int):
    @arrow_udf(from_arrow_type(FEATURES))
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher(bands)
        for texts in batches:
            for part in slices(texts):
                yield pa.array([hasher.features(t) for t in part], FEATURES)

    return features


def _candidate_pairs(needed: list[int], share: int | None):
    """Streams rows sorted by group; yields the pairs each group hands over."""
    names = ("bucket", "low", "high", "part", "node", "component")

    def pairs_of(bucket: int, low: int, high: int, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(rows["part"] == low)
        second = np.flatnonzero(rows["part"] == high)
        comp = rows["component"]
        open_ = comp[first][:, None] != comp[second][None, :]
        if low == high:
            open_ &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
        i, j, matches = survivors(rows["signature"][first], rows["signature"][second], needed, open_)
        i, j = first[i], second[j]
        bands = rows["bands"]
        own = (bands[i] == bands[j]).argmax(1) == (bands[i] == bucket).argmax(1)
        i, j, matches = i[own], j[own], matches[own]
        chosen = handed_over(comp[i], comp[j], matches, share)
        one, two = rows["node"][i[chosen]] if len(chosen) else i, rows["node"][j[chosen]] if len(chosen) else j
        return np.minimum(one, two), np.maximum(one, two)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def flush(rows: dict[str, np.ndarray], last: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
            key = np.stack([rows["bucket"], rows["low"], rows["high"]])
            edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [key.shape[1]]])
            done = len(edges) - 1 if last else len(edges) - 2
            found = []
            for start, stop in zip(edges[:done].tolist(), edges[1 : done + 1].tolist(), strict=True):
                if stop - start > 1:
                    part = {n: v[start:stop] for n, v in rows.items()}
                    found.append(pairs_of(int(key[0, start]), int(key[1, start]), int(key[2, start]), part))
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            rest = {n: v[edges[done] :] for n, v in rows.items()}
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), rest

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            now = {c: batch.column(c).to_numpy() for c in names}
            now["bands"] = batch.column("bands").flatten().to_numpy().reshape(n, -1)
            now["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            out, held = flush(held, False)
            yield out
        if held is not None:
            yield flush(held, True)[0]

    return run


def _similar_udf(percent: int):
    @arrow_udf(from_arrow_type(pa.bool_()))
    def test(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()  # a centre meets many members in a row

        def set_of(data: bytes) -> np.ndarray:
            found = recent.get(data)
            if found is None:
                found = recent[data] = shingles(data)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return found

        for left, right in batches:
            pairs = zip(left.cast(pa.binary()), right.cast(pa.binary()), strict=True)
            yield pa.array([similar(set_of(a.as_py()), set_of(b.as_py()), percent) for a, b in pairs], pa.bool_())

    return test


def _handed_over(live: DataFrame, nodes: DataFrame, how: Similarity, share: int | None) -> DataFrame:
    """Pairs (a, b) to verify among the members (bucket, n, node, component) of shared buckets."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = live.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # for a forest, a block is compared with itself and with block 0
    near = F.when(F.col("part") == 0, every).otherwise(F.array(F.lit(0), F.col("part")))
    grouped = placed.withColumn("other", F.explode(near if share == 0 else every)).join(nodes, "node").select(
        "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node",
        "component", "bands", "signature",
    )
    key = ["bucket", "low", "high"]
    needed = least_matches(how.percent / 100, how.batch_miss)
    return grouped.repartition(*key).sortWithinPartitions(*key).mapInArrow(_candidate_pairs(needed, share), "a long, b long")


def _among(rows: DataFrame, wanted: DataFrame, on: str = "node") -> DataFrame:
    """``rows`` whose node is ``wanted``, picked where they are read as long as the ids can be sent to all tasks."""
    ids = wanted.select(F.col("node").alias(on))
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, on, "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # only the texts of these pairs are shuffled, so rounds with few pairs cost little at any size
    texts = _among(texts, kept(ends, "neardup-ends"))
    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}")) for n in "ab")
    return kept(
        pairs.join(two, "b").join(one, "a").where(_similar_udf(how.percent)("ta", "tb")).select("a", "b"), "neardup-links"
    )


def link_components(nodes: DataFrame, texts_of, how: Similarity) -> DataFrame | None:
    """(node, component) of every linked node; ``nodes`` has node, bands and signature, one row per node."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = kept(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "neardup-buckets")
    if shared.isEmpty():
        return None
    sent = F.broadcast(shared) if shared.count() <= SENT_IDS else shared
    live = kept(members.join(sent, "bucket").select("bucket", "band", "node", "n"), "neardup-members")
    wanted = kept(live.select("node").distinct(), "neardup-wanted")
    texts = texts_of(wanted)
    # each round shuffles the signatures: those of nodes that share no bucket stay behind
    nodes = kept(_among(nodes, wanted), "neardup-nodes")
    live = live.withColumn("component", F.col("node"))
    found: DataFrame | None = None
    tested: DataFrame | None = None
    for bands, share in ROUNDS:
        pairs = _handed_over(live if bands is None else live.where(F.col("band") < bands), nodes, how, share)
        pairs = kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "neardup-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _verified(pairs, texts, how)
        if not links.isEmpty():
            edges = links.select(F.col("a").alias("left"), F.col("b").alias("right"))
            if found is not None:
                edges = edges.unionByName(found.select(F.col("node").alias("left"), F.col("component").alias("right")))
            found = kept(components(edges), "neardup-components")
        if share is None:
            break
        members = live.drop("component")
        if found is not None:
            members = members.join(found, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
        else:
            members = members.withColumn("component", F.col("node"))
        members = kept(members, "neardup-named")
        low_high = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        unfinished = kept(low_high.where("low <> high").select("bucket"), "neardup-open")
        if unfinished.isEmpty():
            break
        live = kept(members.join(unfinished, "bucket"), "neardup-members")
    return found


def near_duplicates(docs: DataFrame, how: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_shingles``, ``component_id`` (the smallest id reachable over links) and ``kept``; texts are not returned."""
    bounded_batches(docs)
    columns = [c for c in without(docs, *RESULT, "id_").columns if c != text]
    rows = docs.withColumn("id_", F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST_ID)))
    seen = kept(
        rows.withColumn("f_", _feature_udf(how.bands)(F.col(text))).select(*columns, "id_", "f_.*"), "neardup-features"
    )
    classes = kept(
        seen.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("id_").alias("node"), F.min_by(F.struct("bands", "signature"), "id_").alias("f"))
        .select("set_key", "node", "f.bands", "f.signature"),
        "neardup-classes",
    )
    nodes = classes.select("node", "bands", "signature")
    # different sets of one id: only then are there nodes to drop, and whole rows to shuffle for it
    if not classes.groupBy("node").count().where("count > 1").isEmpty():
        nodes = kept(nodes.dropDuplicates(["node"]), "neardup-nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        found = _among(rows.select("id_", F.col(text).alias("text")).where("text IS NOT NULL"), wanted, "id_").withColumnRenamed("id_", "node")
        return kept(found.groupBy("node").agg(F.min("text").alias("text")), "neardup-texts", "zstd")

    linked = link_components(nodes, texts_of, how)
    member = classes.select("set_key", "node")
    if linked is not None:
        member = kept(
            member.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "neardup-named"
        )
    else:
        member = member.withColumnRenamed("node", "component")
    named = seen.where("n_shingles > 0").join(member, "set_key").unionByName(
        seen.where("n_shingles = 0").withColumn("component", F.col("id_")), allowMissingColumns=True
    )
    component = F.when(F.col("component") != LOWEST_ID, F.col("component"))
    return named.select(*columns, "n_shingles", component.alias("component_id"), (F.col("id_") == F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, how: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows sharing an id become one."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = kept(near_duplicates(slim, how), "neardup-result")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST_ID))
    gone = found.where("NOT kept").select(F.coalesce("doc_id", F.lit(LOWEST_ID)).cast("long").alias("id_")).distinct()
    left = docs.withColumn("id_", key).join(kept(gone, "neardup-gone"), "id_", "left_anti")
    stay = found.where("kept")
    repeated = stay.groupBy("doc_id").count().where("count > 1").isEmpty() is False
    return (left.dropDuplicates(["id_"]) if repeated else left).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Similarity(percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
