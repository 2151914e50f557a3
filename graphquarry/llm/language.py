"""Language identification by compression: the language whose dictionary shortens a text most.

Each language's dictionary is raw text: pieces of labelled documents, folded to lower-case letters
and single spaces. A text is folded the same way, cut into blocks, and every block is compressed with
zstandard once per dictionary; the smallest total wins. Blocks keep the dictionary's weight equal all
along a long text. A prediction is rejected when the runner-up is within ``min_margin`` of it.

The dictionaries are fitted on a bounded sample: ``SAMPLE_DOCUMENTS`` distinct texts per language, the
ones with the smallest hash, and ``SAMPLE_CHARS`` characters of each from a place the hash picks.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; so is every
text when nothing was learned. Equal sizes go to the language with more labelled texts, and are rejected
unless the text is too short for any dictionary to shorten it, which is no evidence either way. Rows with a null label or text teach nothing. Columns named like results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, crc_of_id, kept, slices, table, without

UNDETERMINED = "und"
SAMPLE_DOCUMENTS = 120
SAMPLE_CHARS = 1000
BLOCK_BYTES = 4096
LEVEL = 5
MIN_MARGIN = 0.001
#: A relative margin of this size multiplies the odds of the winner by e.
MARGIN_SCALE = 0.01
RESULT = ("lang_pred", "score", "margin", "shortened", "rejected")
PREDICTION = pa.struct([
    ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()),
    ("shortened", pa.bool_()),
])

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTERS = frozenset(range(0x61, 0x7B))


def fold(data: bytes | None) -> bytes:
    """Lower-case letters with single spaces; empty if there is no letter."""
    if not data:
        return b""
    text = data.decode()
    folded = b" ".join(text.lower().encode().translate(_FOLD).split())
    return folded if not _LETTERS.isdisjoint(folded) or any(map(str.isalpha, text)) else b""


class Identifier:
    """One compressor per language."""

    def __init__(self, samples: dict[str, bytes], level: int = LEVEL, block: int = BLOCK_BYTES) -> None:
        import zstandard

        self.block = block
        self.coders = {}
        for lang, sample in samples.items():
            made = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(
                level, source_size=block, dict_size=len(sample), write_content_size=0, write_checksum=0, write_dict_id=0
            )
            made.precompute_compress(compression_params=options)
            self.coders[lang] = zstandard.ZstdCompressor(dict_data=made, compression_params=options)

    def sizes(self, folded: bytes) -> dict[str, int]:
        blocks = [folded[i : i + self.block] for i in range(0, len(folded), self.block)]
        return {lang: sum(len(coder.compress(b)) for b in blocks) for lang, coder in self.coders.items()}

    def predict(self, data: bytes | None) -> dict:
        folded = fold(data)
        if not folded or not self.coders:
            return {"lang_pred": UNDETERMINED, "score": 0.0, "margin": 0.0, "shortened": False}
        sizes = self.sizes(folded)
        best = min(sizes, key=sizes.get)
        least = sizes[best]
        others = [(n - least) / least for lang, n in sizes.items() if lang != best]
        score = 1 / (1 + sum(math.exp(-min(m / MARGIN_SCALE, 700)) for m in others))
        return {"lang_pred": best, "score": score, "margin": min(others, default=1.0), "shortened": least < len(folded)}


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang",
    documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Dictionary content per language, the commonest first, from a bounded sample: at most ``documents * chars`` characters each.

    Copies of a text count once. Only hashes are shuffled; the chosen ones then pick their pieces.
    """
    usable = labelled.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang_"), F.col(text).alias("text_"), F.xxhash64(text).alias("hash_")
    )
    place = Window.partitionBy("lang_").orderBy("hash_")
    distinct = kept(usable.select("lang_", "hash_").distinct(), "language-texts")
    common = [r["lang_"] for r in distinct.groupBy("lang_").count().orderBy(F.desc("count"), "lang_").collect()]
    chosen = (
        distinct.withColumn("place_", F.row_number().over(place)).where(F.col("place_") <= documents)
    )
    spare = F.greatest(F.length("text_") - chars, F.lit(0)) + 1
    piece = F.substring("text_", (F.pmod("hash_", spare.cast("long")) + 1).cast("int"), F.lit(chars))
    pieces = (
        usable.join(F.broadcast(chosen), ["lang_", "hash_"])  # at most ``documents`` rows a language
        .groupBy("lang_", "hash_").agg(F.min(piece).alias("piece_"))
        .orderBy("lang_", "hash_").collect()
    )
    out: dict[str, list[bytes]] = {name: [] for name in common}
    for row in pieces:
        out[row["lang_"]].append(fold(row["piece_"].encode()))
    return {name: b" ".join(p) for name, p in out.items() if any(p)}


def predictor(spark, samples: dict[str, bytes]):
    sent = spark.sparkContext.broadcast(samples)

    @arrow_udf(from_arrow_type(PREDICTION))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Identifier(sent.value)
        for texts in batches:
            for part in slices(texts):
                yield pa.array([own.predict(t) for t in part], PREDICTION)

    return predict


def identify(
    docs: DataFrame, samples: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """Add the predicted language, its score, the margin to the runner-up, and whether it is rejected."""
    bounded_batches(docs)
    docs = without(docs, *RESULT)
    found = docs.withColumn("guess_", predictor(docs.sparkSession, samples)(F.col(text))).select(*docs.columns, "guess_.*")
    rejected: Column = (F.col("lang_pred") == UNDETERMINED) | (F.col("shortened") & (F.col("margin") < min_margin))
    return found.withColumn("rejected", rejected).drop("shortened")


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(column), F.lit(4)) == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), samples).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )
