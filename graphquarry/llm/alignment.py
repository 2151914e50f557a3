"""Cross-tokenizer alignment: where a byte-level BPE (A) and a sentencepiece BPE (B) cut the same text alike.

Both tokenize a space and the text (B adds that space by itself). The spans that the libraries report are the coarse cuts:
character offsets of tokenizers, byte spans of sentencepiece's proto (the package has dropped the older immutable
proto; this one carries the same spans). Where tokens share a character, or B falls back to single bytes, those spans are
too wide or empty, and the decoded bytes of the tokens say where inside the character each ends. Places where tokens
of both end cut them into groups; the last tokens of a group are linked. How often an id pair is linked is counted over
the whole corpus, and every document is told how many of its links are the most frequent for their B id.

A text is cut in front of a space between a visible and any other character but a space. Neither vocabulary has a token
across such a place, which is checked when it is loaded (otherwise texts stay whole), so pieces are aligned once
per worker and looked up afterwards. Pair counts are combined before they are shuffled; their table meets the documents' links
by a broadcast only if it has at most ``SENT_PAIRS`` rows, else by a join on the pair.

Defined cases: null and empty texts, and texts whose tokens do not give back their bytes (such as a literal U+2581),
have no tokens and zeros; repeated rows count and are reported each; strings of special tokens are plain text; result
columns replace input columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, kept, slices, table, without

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Rows of the pair table that are sent to every task; a larger one is joined by its key.
SENT_PAIRS = 1 << 20
CACHED_PIECES = 250_000
LINE_CHARS = 4000

IDS = pa.list_(pa.int32())
SPANS = pa.struct([("a_ids", IDS), ("a_ends", IDS), ("b_ids", IDS), ("b_ends", IDS)])
LINKED = pa.struct([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
    ("links", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))),
])
RESULT = tuple(f.name for f in LINKED)

_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_ENDS = ".,;:!?"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)


def _byte_of() -> dict[str, int]:
    """Byte-level entries write visible Latin-1 bytes as themselves and the others, in order, from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Spans:
    """Tokens of one text by both vocabularies; ends count bytes of a space and the text."""

    def __init__(self, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> None:
        self.a_ids, self.a_ends, self.b_ids, self.b_ends = a_ids, a_ends, b_ids, b_ends
        self.cuts, self.a_last, self.b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)

    def groups(self) -> list[str]:
        """Each group as ``a1,a2|b1``."""
        a, b = list(map(str, self.a_ids.tolist())), list(map(str, self.b_ids.tolist()))
        if len(a) == len(self.a_last) == len(b):
            return list(map("|".join, zip(a, b, strict=True)))
        out, i, j = [], 0, 0
        for x, y in zip((self.a_last + 1).tolist(), (self.b_last + 1).tolist(), strict=True):
            left = a[i] if x == i + 1 else ",".join(a[i:x])
            right = b[j] if y == j + 1 else ",".join(b[j:y])
            out.append(f"{left}|{right}")
            i, j = x, y
        return out


def _refined(data: bytes, coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Byte ends of tokens: the coarse end where the bytes before it are complete, else inside a character by decoded sizes."""
    run = np.cumsum(sizes)
    if not len(run) or run[-1] != len(data):
        return None
    ends = np.where(coarse == run, coarse, run)
    inner = ends[coarse != run]  # all but a character's last byte end inside it
    return ends if all(data[e] & 0xC0 == 0x80 for e in inner.tolist()) else None


class Aligner:
    """Both vocabularies in one worker, and what is known of pieces of text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of, vocabulary = _byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(map(byte_of.get, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(_BYTE.match(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        rules = json.loads(self.a.to_str())
        level = rules["pre_tokenizer"] or {}
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        self.separable = (
            rules["normalizer"] is None and level.get("type") == "ByteLevel" and level.get("use_regex", True)
            and all(t["special"] for t in rules["added_tokens"])
            and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )
        #: No token joins a letter and a mark behind it, so marks at the end of a piece are looked up by themselves.
        self.marks_apart = self.separable and not any(a.isalpha() and b in _ENDS for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.pieces = Pieces(self)

    def spans(self, text: str) -> Spans | None:
        """Tokens and their byte ends, or None if the tokens of A or B do not give back a space and the text."""
        spaced = " " + text
        data = spaced.encode()
        found = self.a.encode(spaced, add_special_tokens=False)
        a_ids = np.array(found.ids, np.int64)
        if b"".join(map(self.a_bytes.__getitem__, found.ids)) != data:
            return None
        stops = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a_ids))[1::2]
        if len(data) != len(spaced):  # characters to bytes
            starts = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
            stops = np.append(np.flatnonzero(starts), len(data))[stops]
        a_ends = _refined(data, stops, self.a_sizes[a_ids])
        parts = self.b.encode(text, return_type="proto").pieces
        ids = [p.id for p in parts]
        if a_ends is None or b"".join(map(self.b_bytes.__getitem__, ids)) != data:
            return None
        b_ids = np.array(ids, np.int64)
        # spans of the proto leave out the space that B adds
        b_ends = _refined(data, np.array([p.end for p in parts], np.int64) + 1, self.b_sizes[b_ids])
        return None if b_ends is None else Spans(a_ids, a_ends, b_ids, b_ends)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text, each without the space in front of it."""
        if not self.separable:
            return [text]
        first, *rest = _CUT.split(" " + text)
        return [first[1:], *rest]

    def linked(self, texts: list[bytes | None]) -> pa.StructArray:
        """Sizes, groups and counted links of each text."""
        cut = [self.cut(t.decode()) if t else [] for t in texts]
        known = self.pieces
        gc.disable()  # spans make many small tuples and no cycles
        known.learn(set(chain.from_iterable(cut)))
        gc.enable()
        sizes = np.array(list(map(len, cut)), np.int64)
        at = np.fromiter(map(known.place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(cut)), sizes)
        n_a, n_b, n_groups, first = map(known.column, ("n_a", "n_b", "n_groups", "first"))
        whole = np.ones(len(cut), bool)
        whole[row[n_a[at] == 0]] = False  # one piece that does not give back its bytes spoils the text
        totals = [np.bincount(row, n[at], len(cut)).astype(np.int64) * whole for n in (n_a, n_b, n_groups)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        places = at.tolist()
        groups = [
            ";".join(map(known.groups.__getitem__, places[a:b])) if ok else ""
            for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), whole.tolist(), strict=True)
        ]
        at, row = at[whole[row]], row[whole[row]]
        every = n_groups[at]
        pairs = known.column("pairs")[_ranges(first[at], every)]
        span = len(self.a_bytes) * len(self.b_bytes)
        keys, times = np.unique(np.repeat(row, every) * span + pairs, return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(cut) + 1) * span).astype(np.int32)
        links = pa.ListArray.from_arrays(
            ends, pa.StructArray.from_arrays([pa.array(keys % span), pa.array(times.astype(np.int32))], fields=list(LINKED.field("links").type.value_type))
        )
        known.turn()
        return pa.StructArray.from_arrays([*map(pa.array, totals), pa.array(groups, pa.string()), links], fields=list(LINKED))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``first[k]``, ``first[k] + 1``, … of all ranges, one after the other."""
    skipped = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(skipped - first, sizes)


class Pieces:
    """Alignments of pieces, by place in parallel columns; what is not used between two turns is forgotten."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.older: Pieces | None = None
        self.place: dict[str | tuple[str], int] = {}
        self.groups: list[str] = []
        self.parts: dict[str, list[np.ndarray]] = {n: [np.zeros(0, np.int64)] for n in ("n_a", "n_b", "n_groups", "first", "pairs")}
        self.length = 0

    def column(self, name: str) -> np.ndarray:
        parts = self.parts[name]
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def add(self, pieces: list[str] | list[tuple[str]], n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True))
        self.groups += groups
        first = self.length + np.cumsum(n_groups) - n_groups
        for name, part in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("first", first), ("pairs", pairs)):
            self.parts[name].append(part)
        self.length += len(pairs)

    def turn(self) -> None:
        if len(self.place) > CACHED_PIECES:
            old = Pieces(self.aligner)
            old.place, old.groups, old.parts, old.length = self.place, self.groups, self.parts, self.length
            self.__init__(self.aligner)
            self.older = old

    def learn(self, pieces: set[str]) -> None:
        missing = pieces.difference(self.place)
        marked: dict[str, str] = {}
        if self.aligner.marks_apart:
            for piece in missing:
                if piece[-1] in _ENDS:
                    word = piece.rstrip(_ENDS)
                    if word and word[-1].isalpha():
                        marked[piece] = word
            missing.difference_update(marked)
            missing.update(w for w in marked.values() if w not in self.place)
        if self.older is not None:
            old, again = self.older, [p for p in missing if p in self.older.place]
            at = np.fromiter(map(old.place.__getitem__, again), np.int64, len(again))
            n_groups = old.column("n_groups")[at]
            self.add(again, old.column("n_a")[at], old.column("n_b")[at], n_groups, [old.groups[k] for k in at.tolist()],
                     old.column("pairs")[_ranges(old.column("first")[at], n_groups)])
            missing.difference_update(again)
        self._learn_words(missing)
        if marked:
            self._learn_marked(marked)

    def _learn_marked(self, marked: dict[str, str]) -> None:
        """Words with marks behind them, put together of both."""
        for marks in {p[len(w):] for p, w in marked.items()}:
            if (marks,) not in self.place:  # as they stand behind a letter; its own group is left out
                found = self.aligner.spans("a" + marks)
                pairs = found.a_ids[found.a_last] * len(self.aligner.b_bytes) + found.b_ids[found.b_last]
                one = np.ones(1, np.int64)
                self.add([(marks,)], (len(found.a_ids) - 1) * one, (len(found.b_ids) - 1) * one, (len(pairs) - 1) * one, [";".join(found.groups()[1:])], pairs[1:])
        words = np.fromiter((self.place[w] for w in marked.values()), np.int64, len(marked))
        marks = np.fromiter((self.place[p[len(w):],] for p, w in marked.items()), np.int64, len(marked))
        n_a, n_b, n_groups, first = map(self.column, ("n_a", "n_b", "n_groups", "first"))
        good = n_a[words] > 0
        both = np.stack([words, marks], 1)[good].ravel()
        total = lambda n: np.where(good, n[words] + n[marks], 0)
        groups = [f"{self.groups[w]};{self.groups[m]}" if ok else "" for w, m, ok in zip(words.tolist(), marks.tolist(), good.tolist(), strict=True)]
        self.add(list(marked), total(n_a), total(n_b), total(n_groups), groups, self.column("pairs")[_ranges(first[both], n_groups[both])])

    def _learn_words(self, missing: set[str]) -> None:
        line: list[str] = []
        size = 0
        for piece in missing:
            if piece[0].isspace() or piece[-1] == " " or not self.aligner.separable:
                self._learn_line([piece])
                continue
            line.append(piece)
            size += len(piece)
            if size > LINE_CHARS:
                self._learn_line(line)
                line, size = [], 0
        if line:
            self._learn_line(line)

    def _learn_line(self, line: list[str]) -> None:
        """Align pieces as one text; it is cut between them, as any text is."""
        text = " ".join(line)
        found = self.aligner.spans(text)
        if found is None:
            if len(line) == 1:
                none = np.zeros(1, np.int64)
                self.add(line, none, none, none, [""], none[:0])
            else:
                for piece in line:
                    self._learn_line([piece])
            return
        sizes = map(len, line) if text.isascii() else (len(p.encode()) for p in line)
        stops = np.cumsum(np.fromiter(sizes, np.int64, len(line)) + 1)
        last = np.searchsorted(found.cuts, stops)  # every end of a piece is a common cut
        each, ends = found.groups(), (last + 1).tolist()
        groups = [each[a] if b == a + 1 else ";".join(each[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        n_a, n_b, n_groups = (np.diff(x, prepend=-1) for x in (found.a_last[last], found.b_last[last], last))
        self.add(line, n_a, n_b, n_groups, groups, found.a_ids[found.a_last] * len(self.aligner.b_bytes) + found.b_ids[found.b_last])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two vocabularies, loaded once."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def align(docs: DataFrame, text: str = "text", spans: str = "spans", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Add ``spans``: ids of both tokenizations and the byte each token ends at, in a space and the text; null without tokens."""
    bounded_batches(docs)
    paths = vocabularies or default_vocabularies()

    @arrow_udf(from_arrow_type(SPANS))
    def spanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(*paths)
        for texts in batches:
            for part in slices(texts):
                found = [own.spans(t.decode()) if t else None for t in part]
                yield pa.array([f and {n.name: getattr(f, n.name).tolist() for n in SPANS} for f in found], SPANS)

    return without(docs, spans).withColumn(spans, spanned(F.col(text)))


def linked(docs: DataFrame, text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``groups`` (``a1,a2|b1;a3|b2,b3``) and ``links``: id pairs and how often each is linked.

    A pair is its A id times the size of vocabulary B, plus its B id.
    """
    bounded_batches(docs)
    paths = vocabularies or default_vocabularies()

    @arrow_udf(from_arrow_type(LINKED))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(*paths)
        for texts in batches:
            for part in slices(texts):
                yield own.linked(part)

    rows = without(docs, *RESULT, "linked_")
    return rows.withColumn("linked_", found(F.col(text))).select(*rows.columns, "linked_.*")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)`` over all rows: how often a pair is linked, and whether no pair with its B id is more often."""
    counts = kept(rows.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("n")), "align-counts")
    of_b = F.pmod("pair", F.lit(size_b)).alias("b_id")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))
    return counts.withColumn("b_id", of_b).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(rows: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Rows of :func:`linked` with ``n_links``, ``n_best`` and ``count_sum`` in place of ``links``."""
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=(vocabularies or default_vocabularies())[1]).get_piece_size()
    rows = without(rows, "row_", "n_links", "n_best", "count_sum")
    stored = kept(rows.withColumn("row_", F.monotonically_increasing_id()), "align-rows")
    counts = kept(pair_counts(stored, size_b), "align-pairs")
    sent = F.broadcast(counts) if counts.count() <= SENT_PAIRS else counts
    sums = (
        stored.select("row_", F.inline("links")).join(sent, "pair").groupBy("row_")
        .agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
             F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    added = ["n_links", "n_best", "count_sum"]
    names = [c for c in rows.columns if c != "links"]
    return stored.drop("links").join(sums, "row_", "left").select(*names, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in added])


def query(spark, sf_dir: str) -> DataFrame:
    rows = linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return counted(rows.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"))
