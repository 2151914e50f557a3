"""Byte-level BPE: texts to token numbers and back, with offsets in code points.

Arrow batches of text go through the tokenizers library. Text is first cut in front of every space
that a visible character follows, which the vocabulary's pattern always does too, so each piece
can be encoded alone and common pieces are encoded once per worker. Token strings are written
in the vocabulary's stand-in characters for bytes; decoding reverses that table and joins bytes, so
a character that was split over several tokens comes back whole.

Defined cases: a null or empty text has no tokens; null token lists decode to null; a token list that
ends inside a character decodes to exactly its bytes, and as text to a replacement character.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, slices, table

VOCABULARY = "byte_bpe_50k.json"
CACHED_PIECES = 60_000
LONGEST_CACHED = 64
DECODED_ROWS = 256
IDS = pa.list_(pa.int32())
OFFSETS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

_LINE = 500
_ENDS = ".,;:!?#$%&*|-"
_CUT = re.compile(r" (?=\S)")
#: A space that no visible character follows: such texts are cut by pattern, others at every space.
_ODD = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_table() -> dict[str, int]:
    """The vocabulary's stand-in characters: visible Latin-1 stands for itself, other bytes follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Codec:
    """One vocabulary in one worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        table = byte_table()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.pieces[number] = bytes(map(table.get, token)) if all(c in table for c in token) else token.encode()
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.spaced = np.array([p[:1] == b" " for p in self.pieces])
        self.heads: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Token numbers of each text."""
        firsts, rests = [], []
        for data in texts:
            text = data.decode() if data else ""
            odd = any(pair in text for pair in _ODD)
            first, *rest = _CUT.split(text) if odd else text.split(" ")
            firsts.append(first)
            rests.append(rest)
        self._learn_each(self.heads, firsts, "")
        self._learn_words(chain.from_iterable(rests))
        out = [
            np.frombuffer(self.heads[first] + b"".join(map(self.known.__getitem__, rest)), np.int32)
            for first, rest in zip(firsts, rests, strict=True)
        ]
        for piece in self.long:
            self.heads.pop(piece, None)
            self.known.pop(piece, None)
        self.long.clear()
        # what was used since the last turn stays at hand for another turn
        if len(self.known) > CACHED_PIECES:
            self.older, self.known = self.known, {}
        if len(self.heads) > CACHED_PIECES:
            self.heads = {}
        return out

    def _learn_words(self, pieces: Iterable[str]) -> None:
        """Encode the pieces ``known`` lacks; a space was cut off in front of each.

        Letters or digits and the punctuation behind them never share a token, so both are looked up
        by themselves. Words go to the library many at a time, as one spaced line: a token that
        begins with a space then begins a word.
        """
        known = self.known
        missing = set(filterfalse(known.__contains__, pieces))
        known.update((p, self.older[p]) for p in missing if p in self.older)
        missing = {p for p in missing if p not in self.older}
        ends: dict[str, str] = {}
        for piece in missing:
            word = piece.rstrip(_ENDS)
            if word and word != piece and word[-1].isalnum():
                ends[piece] = word
        words = {ends.get(p, p) for p in missing if ends.get(p, p) not in known}
        self._learn_each(self.heads, (p[len(w):] for p, w in ends.items()), "")
        spaced = {w for w in words if w.split() != [w]}
        self._learn_each(known, spaced, " ")
        line = list(words - spaced)
        groups = [line[i : i + _LINE] for i in range(0, len(line), _LINE)]
        for group, found in zip(
            groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True
        ):
            ids = np.array(found.ids, np.int32)
            raw, places = ids.tobytes(), [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            known.update((w, raw[a:b]) for w, a, b in zip(group, places[:-1], places[1:], strict=True))
        self.long += [w for w in words if len(w) > LONGEST_CACHED]
        for piece, word in ends.items():
            known[piece] = known[word] + self.heads[piece[len(word):]]
            if len(piece) > LONGEST_CACHED:
                self.long.append(piece)

    def _learn_each(self, cache: dict[str, bytes], pieces: Iterable[str], before: str) -> None:
        missing = list(set(filterfalse(cache.__contains__, pieces)))
        encoded = self.tokenizer.encode_batch_fast([before + p for p in missing], add_special_tokens=False)
        for piece, found in zip(missing, encoded, strict=True):
            cache[piece] = np.array(found.ids, np.int32).tobytes()
            if len(piece) > LONGEST_CACHED:
                self.long.append(piece)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> list[dict]:
        """Code points each token touches; tokens that share a split character all report it."""
        starts = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        char = np.cumsum(starts) - 1
        stop = np.cumsum(self.lengths[ids])
        first = stop - self.lengths[ids]
        return [{"start": int(char[a]), "stop": int(char[b - 1]) + 1} for a, b in zip(first, stop, strict=True)]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary, loaded once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, np.int32))


def encoder(path: str):
    @arrow_udf(from_arrow_type(IDS))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            for part in slices(texts):
                yield _lists(own.encode(part))

    return encode


@arrow_udf(from_arrow_type(pa.string()))
def _as_text(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else d.decode("utf-8", "replace") for d in data.to_pylist()], pa.string())


def decoder(path: str):
    @arrow_udf(from_arrow_type(pa.binary()))
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for lists in batches:
            numbers, ends, valid = lists.values.to_numpy(), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            for k in range(0, len(lists), DECODED_ROWS):
                rows = range(k, min(k + DECODED_ROWS, len(lists)))
                yield pa.array(
                    [own.decode(numbers[ends[i] : ends[i + 1]].tolist()) if valid[i] else None for i in rows], pa.binary()
                )

    return decode


def locator(path: str):
    @arrow_udf(from_arrow_type(OFFSETS))
    def locate(texts: pa.Array, lists: pa.Array) -> pa.Array:
        own = codec(path)
        pairs = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        return pa.array([own.offsets(t or "", np.array(x or [], np.int64)) for t, x in pairs], OFFSETS)

    return locate


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, offsets: str | None = None) -> DataFrame:
    """Add the token numbers of ``text`` as ``ids``; with ``offsets``, also the code points of each token."""
    bounded_batches(docs)
    path = vocabulary or default_vocabulary()
    out = docs.withColumn(ids, encoder(path)(F.col(text)))
    return out.withColumn(offsets, locator(path)(F.col(text), F.col(ids))) if offsets else out


def decode(tokens: DataFrame, ids: str = "ids", data: str = "data", vocabulary: str | None = None, as_text: bool = False) -> DataFrame:
    """Add the bytes, or the text, that token numbers stand for."""
    bounded_batches(tokens)
    path = vocabulary or default_vocabulary()
    found = decoder(path)(F.col(ids))
    return tokens.withColumn(data, _as_text(found) if as_text else found)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
