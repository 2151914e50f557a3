import random
import re

import numpy as np
import pytest

from graphquarry.llm import neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = WORD.findall((text or "").translate(UPPER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    found = [(i, sets(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, s) in enumerate(found):
        for j, t in found[:a]:
            common = len(s & t)
            if s and t and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in found)


def corpus(n_near=60):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    rows = []
    for i in range(n_near):  # one large group whose members are near each other to different degrees
        own = base[:]
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(own)))
    for i in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        rows.append((2000 + 2 * i, " ".join(text)))
        rows.append((2001 + 2 * i, "\n".join(text).upper() if i % 2 else " ".join(text[: len(text) * 9 // 10])))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "é " * 500), (7, "é " * 700)]


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)  # many blocks in a bucket
    rows = corpus()
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Similarity(percent)).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert got == brute(rows, percent)


def test_null_ids_repeats_extra_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x", 1), (3, "a b c d e f", "y", 2), (3, "a b c d e f", "y", 2), (9, "other words stand in here", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_shingles int")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect())
    assert got == [("3", None, False), ("3", None, False), ("9", 9, True), ("None", None, True)]
    left = N.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["9", "None"] and left[0].asDict().keys() == {"doc_id", "text", "kept", "n_shingles"}
    assert N.near_duplicates(docs.limit(0)).collect() == [] and N.deduplicate(docs.limit(0)).collect() == []


def test_posterior_bounds_rise_and_rarely_drop_similar_pairs():
    needed = N.least_matches(0.85, 1e-4)
    assert needed == sorted(needed) and needed[0] < 0.85 * N.BATCH
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (4000, N.BATCH * N.BATCHES), dtype=np.uint8)
    same = rng.random(left.shape) < 0.85
    right = np.where(same, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
    alive = [len(N.survivors(left[k : k + 1], right[k : k + 1], needed, np.ones((1, 1), bool))[0]) for k in range(len(left))]
    assert sum(alive) >= len(left) - 3
    far = np.where(rng.random(left.shape) < 0.5, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
    assert not any(len(N.survivors(left[k : k + 1], far[k : k + 1], needed, np.ones((1, 1), bool))[0]) for k in range(500))


def test_rounds_read_only_nodes_and_texts_that_can_be_linked(spark, monkeypatch):
    rows = corpus()
    tables, joined = {}, []

    def kept(df, name, *more, write=N.kept):
        out = write(df, name, *more)
        tables.setdefault(name, []).append(out)
        return out

    def udf_of(percent, make=N._similar_udf):
        joined.append(percent)
        return make(percent)

    monkeypatch.setattr(N, "kept", kept)
    monkeypatch.setattr(N, "_similar_udf", udf_of)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Similarity(85)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows, 85)
    ids = lambda df: {r["node"] for r in df.select("node").collect()}
    wanted = ids(tables["neardup-wanted"][0])
    assert [ids(t) for t in tables["neardup-nodes"]] == [wanted] and len(wanted) < tables["neardup-classes"][0].count()
    ends = [ids(t) for t in tables["neardup-ends"]]
    assert len(ends) == len(joined) == len(tables["neardup-pairs"])
    for pairs, own in zip(tables["neardup-pairs"], ends, strict=True):
        assert own == {i for r in pairs.collect() for i in (r["a"], r["b"])} and own <= wanted


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_rows_of_one_id_with_different_texts_are_one_node(spark, monkeypatch, sent):
    monkeypatch.setattr(N, "SENT_IDS", sent)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "something else that has nothing to do with it"), (2, text + " more"), (3, text), (None, "five other words stand here")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Similarity(85)).collect()
    assert len(out) == len(rows) and {r["component_id"] for r in out if r["doc_id"]} <= {1, 2}
    assert [r["kept"] for r in out if r["doc_id"] is None] == [True]
