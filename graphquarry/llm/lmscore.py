"""Log10 probabilities of texts under a log-bilinear neural model, with a unigram base beside it.

Tokens are lower-cased words and one end per text. The model predicts a token's class from the classes of the
two tokens before it, and the token from its class by smoothed counts. The commonest words are classes of
their own; other words share classes by their last byte and whether they are ASCII, so unknown words have
a class too. Each class keeps the mass of half a count for one unknown word; all probabilities after
a context sum to one.

The class model is log-bilinear: each of the two context positions has a matrix that maps class vectors to a predicted
vector, whose products with the output vectors plus biases are scores. It is trained in numpy by
noise-contrastive estimation: observed tokens against noise from the class frequencies. Data and noise
terms are taken in expectation, as counts of class triples over all training texts, which have a fixed bound
of ``CLASSES`` cubed; scoring normalises the products by a softmax.

Word counts are exact over all training texts. Counts of the commonest words, up to ``SENT_WORDS``, go to all
tasks; what remains of each text, its rare words, meets their counts in one join, so the vocabulary may
grow without bound and no frequent word is ever a join key.

Defined cases: null and empty texts are one end token; repeated rows each get a row; a null id is
hashed as the empty text; an empty training set gives base scores of 0 and a uniform class model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, crc_of_id, kept, slices, table

CLASSES = 128
FORMS = 32
HEAD = CLASSES - FORMS - 1  # words that are classes of their own; class 0 is the end
WIDTH = 24
NOISE = 10
STEPS = 250
#: A prior on vectors and matrices that counts like so many tokens; it matters for small corpora only.
DECAY = 30.0
SENT_WORDS = 300_000
COUNTED_WORDS = 200_000
LONGEST_WORD = 40
END = b""

_GROUPS = [b"e", b"s", b"n", b"t", b"r", b"d", b"a", b"iouy", b"lmh", b"bcfgjkpqvwxz", b"0123456789", b".", b",;:", b"!?"]
_LAST = np.full(256, 14, np.int64)  # other ASCII
_LAST[128:] = 15
for _i, _group in enumerate(_GROUPS):
    _LAST[list(_group)] = _i


def words(data: bytes | None) -> list[bytes]:
    return data.lower().split() if data else []  # of bytes: A-Z, and the six ASCII white-space characters


def form(word: bytes) -> int:
    """The class of a word that is none of its own."""
    return CLASSES - FORMS + int(_LAST[word[-1]]) * 2 + (not word.isascii())


def stored(word: bytes) -> bytes:
    """The word, or for long ones a longer key than any short word, of the same form."""
    if len(word) <= LONGEST_WORD:
        return word
    from xxhash import xxh3_128_hexdigest

    mark = b"........" if word.isascii() else "éééé".encode()
    return xxh3_128_hexdigest(word).encode() + mark + word[-1:]


def key_of(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word) - (1 << 63)


class Model(NamedTuple):
    """Log10 class probabilities by their parameters; the unigram statistics behind both scores."""

    vectors: np.ndarray
    first: np.ndarray
    second: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    def table(self) -> np.ndarray:
        """log10 P(class | two classes before), as [CLASSES * CLASSES, CLASSES]."""
        left = self.vectors @ self.first @ self.outputs.T
        right = self.vectors @ self.second @ self.outputs.T + self.biases
        score = left[:, None, :] + right[None, :, :]
        score -= score.max(2, keepdims=True)
        score -= np.log(np.exp(score).sum(2, keepdims=True))
        return (score / math.log(10)).reshape(CLASSES * CLASSES, CLASSES).astype(np.float32)


def train_nce(triples: np.ndarray, steps: int = STEPS, width: int = WIDTH, noise: int = NOISE, rate: float = 0.05) -> Model:
    """Noise-contrastive estimation on counts [CLASSES, CLASSES, CLASSES] of (before last, last, token)."""
    total = max(triples.sum(), 1)
    data = (triples / total).astype(np.float32)
    contexts = data.sum(2, keepdims=True)
    unigram = (triples.sum((0, 1)) + 0.5) / (triples.sum() + 0.5 * CLASSES)
    shift = np.log(noise * unigram).astype(np.float32)
    rival = contexts * (noise * unigram).astype(np.float32)
    rng = np.random.default_rng(5)
    p = [rng.normal(0, 0.1, s).astype(np.float32) for s in ((CLASSES, width), (width, width), (width, width), (CLASSES, width))]
    p.append(np.log(unigram).astype(np.float32))
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    seen = np.flatnonzero(contexts.reshape(-1))
    one, two = seen // CLASSES, seen % CLASSES
    data, rival = data.reshape(-1, CLASSES)[seen], rival.reshape(-1, CLASSES)[seen]
    for step in range(1, steps + 1):
        vectors, first, second, outputs, biases = p
        left, right = vectors @ first, vectors @ second
        score = (left @ outputs.T)[one] + (right @ outputs.T + biases - shift)[two]
        true = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        slope = data * (1 - true) - rival * true  # of the objective by the score
        by_one, by_two = np.zeros((CLASSES, CLASSES), np.float32), np.zeros((CLASSES, CLASSES), np.float32)
        np.add.at(by_one, one, slope)
        np.add.at(by_two, two, slope)
        d_left, d_right = by_one @ outputs, by_two @ outputs
        grads = [
            d_left @ first.T + d_right @ second.T, vectors.T @ d_left, vectors.T @ d_right,
            by_one.T @ left + by_two.T @ right, slope.sum(0),
        ]
        grads = [g - DECAY / total * x for g, x in zip(grads, p[:4], strict=False)] + grads[4:]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            p[i] = p[i] + pace * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    return Model(*p)


class Lexicon(dict):
    """Numbers of words: the sent ones in order, then one number per form for all others."""

    def __init__(self, sent: list[bytes]) -> None:
        super().__init__(zip(sent, range(len(sent)), strict=True))
        self.size = len(sent)

    def __missing__(self, word: bytes) -> int:
        return self.size + form(word) - (CLASSES - FORMS)


def class_numbers(sent: list[bytes], head: list[bytes]) -> np.ndarray:
    """The class of each lexicon number."""
    own = {END: 0} | {w: 1 + i for i, w in enumerate(head)}
    return np.array([own[w] if w in own else form(w) for w in sent] + list(range(CLASSES - FORMS, CLASSES)), np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences in the column ``text``, the end as the empty word; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = [stored(w) for w in seen]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in slices(batch.column(0)):
                for data in part:
                    seen.update(words(data))
                seen[END] += len(part)
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_triples(texts: DataFrame, head: list[bytes]) -> np.ndarray:
    """Counts of class triples over all texts, two ends before each; the table has a fixed bound."""
    lexicon_words = [END, *head]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, classes = Lexicon(lexicon_words), class_numbers(lexicon_words, head)
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                codes = [np.zeros(2, np.int64)]
                for data in part:
                    found = words(data)
                    codes.append(classes[np.fromiter(map(lexicon.__getitem__, found), np.int64, len(found))])
                    codes.append(np.zeros(1, np.int64))
                    codes.append(np.full(2, -1, np.int64))  # the next text starts anew
                line = np.concatenate(codes)
                # two ends stand before every text; marks after a text keep its last tokens out of the next one's
                starts = np.flatnonzero(line == -1)
                line[starts] = 0
                triple = (line[:-2] * CLASSES + line[1:-1]) * CLASSES + line[2:]
                use = np.ones(len(triple), bool)
                use[np.intersect1d(starts - 2, np.arange(len(triple)), assume_unique=True)] = False
                total += np.bincount(triple[use], minlength=CLASSES**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    rows = texts.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.float64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


KEYED = pa.struct([("key", pa.int64()), ("form", pa.int32())])


@arrow_udf(from_arrow_type(KEYED))
def _keyed(found: pa.Array) -> pa.Array:
    return pa.array([{"key": key_of(w), "form": form(w) if w else 0} for w in found.to_pylist()], KEYED)


SCORED = pa.struct([
    ("n_tokens", pa.int64()), ("known", pa.int64()), ("counts_log", pa.float64()), ("classes_log", pa.float64()),
    ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])


class Statistics(NamedTuple):
    """What every task needs to score: bounded by ``SENT_WORDS`` and ``CLASSES``."""

    total: int
    distinct: int
    sent: list[bytes]
    counts: np.ndarray
    head: list[bytes]
    class_total: np.ndarray
    class_distinct: np.ndarray
    model: Model


def learn(train: DataFrame, text: str = "text", sent_words: int = SENT_WORDS) -> tuple[Statistics, DataFrame]:
    """Statistics from all training texts, and the table (key, n) of words that are not sent to tasks."""
    bounded_batches(train)
    texts = train.select(F.col(text).alias("text"))
    counts = kept(
        count_words(texts).withColumn("k", _keyed("word")).select("word", "n", "k.key", "k.form"), "lm-words"
    )
    # logarithmic steps of the counts show from which count on the words fit
    size = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(size.alias("size"), "form").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    by_size: Counter[int] = Counter()
    for r in steps:
        by_size[r["size"]] += r["words"]
    least, fit = max(by_size, default=0) + 1, 0
    for step in sorted(by_size, reverse=True):
        if fit + by_size[step] > sent_words:
            break
        least, fit = step, fit + by_size[step]
    is_sent = ((size >= least) & (F.length("word") <= LONGEST_WORD)) | (F.length("word") == 0)
    rows = counts.where(is_sent).select("word", "n").toArrow().to_pylist()
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    sent = [r["word"] for r in rows]
    head = [w for w in sent if w][:HEAD]
    total, distinct = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in steps:
        class_total[r["form"]] += r["n"]
        class_distinct[r["form"]] += r["words"]
    own = set(head)
    for r in rows:
        if r["word"] in own:
            class_total[form(r["word"])] -= r["n"]
            class_distinct[form(r["word"])] -= 1
    model = train_nce(count_triples(texts, head))
    found = Statistics(total, distinct, sent, np.array([r["n"] for r in rows], float), head, class_total, class_distinct, model)
    return found, counts.where(~is_sent).select("key", "n")


class Scorer:
    """Scores texts in one worker."""

    def __init__(self, s: Statistics) -> None:
        self.lexicon = Lexicon(s.sent)
        self.classes = class_numbers(s.sent, s.head)
        self.table = s.model.table()
        self.logs = np.concatenate([np.log10(s.counts + 0.5), np.zeros(FORMS)])
        self.end = self.lexicon.get(END)
        with np.errstate(divide="ignore"):
            self.class_logs = np.log10(s.class_total + 0.5 * (s.class_distinct + 1))
        self.class_logs[: CLASSES - FORMS] = 0
        # a word that is its own class has probability one within it: its count cancels
        self.alone = np.where(self.classes < CLASSES - FORMS, self.logs, 0.0)

    def score(self, data: bytes | None) -> dict:
        found = words(data)
        ids = np.empty(len(found) + 1, np.int64)
        ids[:-1] = np.fromiter(map(self.lexicon.__getitem__, found), np.int64, len(found))
        ids[-1] = self.end if self.end is not None else -1
        line = np.zeros(len(ids) + 2, np.int64)
        if self.end is None:
            line[2:-1] = self.classes[ids[:-1]]
            ids = ids[:-1]
        else:
            line[2:] = self.classes[ids]
        classes = line[2 : 2 + len(ids)]
        rare = Counter(key_of(stored(found[k])) for k in np.flatnonzero(ids >= self.lexicon.size).tolist())
        chance = self.table[line[:-2] * CLASSES + line[1:-1], line[2:]].sum(dtype=np.float64)
        return {
            "n_tokens": len(found) + 1, "known": int((ids < self.lexicon.size).sum()),
            "counts_log": float(self.logs[ids].sum()),
            "classes_log": float(chance - self.class_logs[classes].sum() - self.alone[ids].sum()),
            "rare": list(rare), "times": list(rare.values()),
        }


def score(docs: DataFrame, learned: tuple[Statistics, DataFrame], text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score; ``text`` is not returned."""
    statistics, rare_counts = learned
    sent = docs.sparkSession.sparkContext.broadcast(statistics)

    @arrow_udf(from_arrow_type(SCORED))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(sent.value)
        for texts in batches:
            for part in slices(texts):
                yield pa.array([own.score(t) for t in part], SCORED)

    taken = {"n_tokens", "n_known", "train_tokens", "base_score", "score", "row_", text.lower()}
    columns = [c for c in docs.columns if c.lower() not in taken]
    # numbered as written: from here on every row has a name of its own
    rows = kept(
        docs.withColumn("s_", scored(F.col(text))).select(*columns, F.monotonically_increasing_id().alias("row_"), "s_.*"), "lm-scored"
    )
    missing = math.log10(0.5)
    each = rows.select("row_", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row_", "r.rare", "r.times")
    met = each.join(rare_counts.select(F.col("key").alias("rare"), "n"), "rare")
    sums = kept(
        met.groupBy("row_").agg(
            F.sum("times").alias("rare_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - missing)).alias("rare_log")
        ),
        "lm-rare",
    )
    tokens_out = F.aggregate("times", F.lit(0).cast("long"), lambda n, t: n + t)
    slim = rows.select(*columns, "row_", "n_tokens", "known", "counts_log", "classes_log", tokens_out.alias("rare_tokens"))
    both = slim.join(sums, "row_", "left").select(
        *columns, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), "classes_log",
        (F.col("counts_log") + F.col("rare_tokens") * missing + F.coalesce("rare_log", F.lit(0.0))).alias("log_"),
    )
    norm = math.log10(statistics.total + 0.5 * (statistics.distinct + 1))
    if statistics.total == 0:  # the end was never seen, so no task counted its half
        both = both.withColumn("log_", F.col("log_") + missing)
    return both.select(
        *columns, "n_tokens", "n_known", F.lit(statistics.total).cast("long").alias("train_tokens"),
        (F.col("log_") - F.col("n_tokens") * norm).alias("base_score"), (F.col("classes_log") + F.col("log_")).alias("score"),
    )


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(column), F.lit(5)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return score(docs, learn(docs.where("NOT held_out")))
