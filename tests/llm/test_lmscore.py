import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from graphquarry.llm import lmscore as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), "</s>"]


def corpus(n=160):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "ÉTÉ", "été", "x" * 60, "y" * 60, "a\x00b", "q r"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        pieces = []
        for _ in range(rng.randrange(0, 50)):
            pieces += ["The", "of"] if rng.random() < 0.3 else [rng.choice(vocabulary)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(pieces)))
    return rows + [(900, None), (901, ""), (901, ""), (None, "the of"), (902, "unseen " * 40), (903, rows[0][1])]


def check(spark, rows, sent_words):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", L.held_out())
    learned = L.learn(docs.where("NOT held_out"), sent_words=sent_words)
    out = L.score(docs, learned).collect()
    train = Counter()
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update(tokens(text))
    total, distinct = sum(train.values()), len(train)
    expected = sorted(
        (
            str(i), len(t), sum(w in train for w in t), total,
            round(sum(math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 6),
        )
        for i, text in rows for t in [tokens(text)]
    )
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == expected
    return out, learned[0], train


def test_base_is_exact_and_the_model_beats_it_whether_words_are_sent_or_joined(spark):
    first, _, _ = check(spark, corpus(), 100_000)
    second, statistics, _ = check(spark, corpus(), 20)
    assert len(statistics.sent) <= 21
    plain = lambda rows: sorted((str(r["doc_id"]), r["held_out"], round(r["base_score"], 6)) for r in rows)
    assert plain(first) == plain(second)
    held = [r for r in first if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in corpus(60)]
    _, s, train = check(spark, rows, 100_000)
    assert np.allclose((10.0 ** s.model.table().astype(float)).sum(1), 1, atol=1e-4)
    scorer = L.Scorer(s)
    known = [w.encode() for w in train if w != "</s>"]
    mass = Counter()
    for w in known:
        number = scorer.lexicon[w]
        cls = int(scorer.classes[number])
        count = train[w.decode()]
        mass[cls] += 1.0 if cls < L.CLASSES - L.FORMS else (count + 0.5) / 10 ** scorer.class_logs[cls]
    for cls in range(L.CLASSES - L.FORMS, L.CLASSES):  # and one unknown word
        assert abs(mass[cls] + 0.5 / 10 ** scorer.class_logs[cls] - 1) < 1e-9


def test_triples_start_anew_with_each_text(spark):
    texts = spark.createDataFrame([("a b",), (None,), ("b",)], "text string").coalesce(1)
    counts = L.count_triples(texts, [b"a", b"b"])
    assert {tuple(map(int, k)): counts[tuple(k)] for k in np.argwhere(counts)} == {
        (0, 0, 1): 1, (0, 1, 2): 1, (1, 2, 0): 1, (0, 0, 0): 1, (0, 0, 2): 1, (0, 2, 0): 1}


def test_empty_training_set_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = L.score(docs, L.learn(none)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert L.score(none, L.learn(docs)).collect() == []
