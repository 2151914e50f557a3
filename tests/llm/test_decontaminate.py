import random
import re

import pytest
from pyspark.sql import functions as F

from graphquarry.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        names.add("" if name is None else str(name))
        out.append((str(i), len(w), len(hit), sorted(names)))
    return sorted(out)


def tables(spark):
    rng = random.Random(2)
    vocabulary = ["The", "of", "É", "x1", "a", "b-c", "ß", "9"] + [f"q{i}" for i in range(12)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 25]))) for i in range(14)] + [(3, "again a of"), (None, "q1 q2"), (50, None), (51, ""), (52, "!!")]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)]
    docs += [(100 + k, text(30) + "; " + items[k][1].upper() + " . " + text(9)) for k in range(14)] + [(200, None), (201, ""), (201, "")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_chars", [10**9, 150])
def test_matches_brute_force_in_one_or_many_blocks(spark, block_chars):
    docs, items, d, b = tables(spark)
    rows = D.contamination(d, b, block_chars=block_chars).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["item_ids"])) for r in rows) == brute(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) == bool(r["spans"]) for r in rows)
    text = dict((i, t) for i, t in docs)
    for r in rows:
        assert sum(len(words(text[r["doc_id"]][s["start"] : s["stop"]])) for s in r["spans"]) == r["n_hit"]


def test_removal_of_documents_or_spans(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"é before {passage.upper()}! after", 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, n_words int")
    assert sorted(r["doc_id"] for r in D.decontaminate(d, b).collect()) == [2, 3]
    cut = {r["doc_id"]: (r["text"], r["n_words"]) for r in D.decontaminate(d, b, remove="spans").collect()}
    assert cut == {1: ("é before ! after", 5), 2: ("clean", 6), 3: (None, 7)}
    with pytest.raises(ValueError):
        D.decontaminate(d, b, remove="x")


def test_empty_tables(spark):
    docs, items, d, b = tables(spark)
    assert D.contamination(d, b.limit(0)).agg(F.max("n_hit")).first()[0] == 0
    assert D.contamination(d.limit(0), b).collect() == []
