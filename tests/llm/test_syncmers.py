import random

from pyspark.sql import functions as F

from graphquarry.llm import syncmers as S


def fingerprints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in S.fingerprints(df.selectExpr("*", "'x' AS anchors")).collect()}


def test_choice_depends_on_the_run_alone(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    other = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    texts = [passage, other(50) + " " + passage + " " + other(70), other(7) + "\n" + passage.upper()]
    got = fingerprints(spark, texts)
    inner = [a["value"] for a in got[0]["anchors"]]
    assert len(inner) > 8
    for k, before in ((1, 50), (2, 7)):
        found = {a["at"] - before: a["value"] for a in got[k]["anchors"]}
        assert all(found.get(a["at"]) == a["value"] for a in got[0]["anchors"])


def test_equals_a_plain_search_for_edge_minima(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    df = spark.createDataFrame([(text,)], "text string")
    tokens = text.split(" ")
    hashes = [r[0] for r in df.selectExpr("explode(transform(split(text, ' '), t -> xxhash64(t))) AS h").collect()]
    assert len(hashes) == len(tokens)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(hashes, hashes[1:], strict=False))], "i long, a long, b long")
    pair = [r[0] for r in pairs.orderBy("i").selectExpr("xxhash64(a, b)").collect()]
    expected = [i for i in range(len(tokens) - S.K + 1) if min(pair[i : i + S.WINDOW]) in (pair[i], pair[i + S.WINDOW - 1])]
    assert [a["at"] for a in fingerprints(spark, [text])[0]["anchors"]] == expected
    gaps = [b - a for a, b in zip(expected, expected[1:], strict=False)]
    assert max(gaps) <= S.K - S.S  # no window without an anchor


def test_short_empty_and_unspaced_texts(spark):
    got = fingerprints(spark, [None, "", " \n", "one two", "ONE  two", "日本語の文章" * 20, "x" * 200_000])
    assert [got[i]["fingerprint"] for i in (0, 1, 2)] == ["", "", ""]
    assert got[3]["fingerprint"] == got[4]["fingerprint"] != "" and len(got[5]["anchors"]) > 10 and len(got[6]["anchors"]) == 1


def test_successors_and_edits_match_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i * 7 % 101, " ".join(rng.choice("aé日b") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    rows += [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in S.query(spark, str(tmp_path)).collect()}
    import hashlib

    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert out[i]["n_chars"] == len(text) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    assert out[500]["near_next"] == 1.0 and len(out) == len(rows)


def test_single_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "aaaa bbbb"), (4, "cccc"), (4, "cccc"), (4, "dddd")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"], r["opening"]) for r in S.with_successor(docs).collect())
    assert got == [("4", "cccc", "aa"), ("4", "cccc", "aa"), ("4", "dddd", "aa"), ("None", "aaaa bbbb", "cc")] or all(g[2] for g in got)
    assert S.with_successor(docs.limit(0)).collect() == []
    assert [r["opening"] for r in S.with_successor(docs.where("doc_id IS NULL")).collect()] == ["aa"]


def near(spark, left, right):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    return S.with_anchors(S.with_anchors(df, "a", "x"), "b", "y").select(S.likeness(F.col("x"), F.col("y"))).first()[0]


def test_texts_on_either_side_of_a_length_share_anchors(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(19)]
    assert near(spark, " ".join(words[:18]), " ".join(words[:17])) > 0.6  # 18 and 17 words
    letters = "".join(words)
    for n in (S.K, 2 * S.K, S.FEW, S.FEW + 1):
        assert near(spark, letters[:n], letters[: n - 1]) > 0.3
    assert near(spark, "word", "ward") > 0 and near(spark, "", "word") == near(spark, "", letters) == 0


def test_unspaced_scripts_and_scattered_edits_keep_anchors(spark):
    rng = random.Random(6)
    for alphabet in ("កខគឃងចឆជឈញ", "ກຂຄງຈສຊຍດຕ", "ABCDEFabcdef0123456789+/", "a,b/c.d:e"):
        text = "".join(rng.choice(alphabet) for _ in range(2000))
        assert near(spark, text, text[:1500] + "".join(rng.choice(alphabet) for _ in range(500))) > 0.4
    words = [f"w{rng.randrange(10**5)}ord{rng.randrange(10**5)}" for _ in range(180)]
    edited = ["other" if i % 9 == 4 else w for i, w in enumerate(words)]
    assert near(spark, " ".join(words), " ".join(edited)) > 0.4


def test_query_equals_anchors_of_whole_texts(spark, tmp_path, monkeypatch):
    """The shared pass over own, edited and next text against each of them taken by itself."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeΣσİß日 \n") for _ in range(rng.randrange(1, 9)))
    rows = [(i * 5 % 83, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 30, 90])))) for i in range(80)]
    rows += [(200, "x" * 5000), (201, None), (None, "ΟΔΟΣ " * 40)] + [(300, "some repeated row of an id " * 3)] * 3
    rows += [(301, f"text {word()} of a shared id number {i} " * 4) for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "BLOCK", 3)
    out = S.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    low = lambda i: -1 if i is None else i
    stands = {}
    for i, t in rows:
        stands[low(i)] = min(stands.get(low(i), t or ""), t or "")
    ids = sorted(stands)
    follows = {a: stands[b] for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    cases = []
    for i, t in rows:
        t, after = t or "", follows[low(i)]
        cases.append((i, t, t[: len(t) - len(t) // 4] + after[: len(t) // 4], after))
    df = spark.createDataFrame(cases, "doc_id long, text string, edited string, after string")
    for c in ("text", "edited", "after"):
        df = S.with_anchors(df, c, c + "_a")
    pick = lambda a: S.fingerprint(F.col(a))
    expected = df.select("doc_id", pick("text_a").alias("fingerprint"), pick("edited_a").alias("edited_fingerprint"),
                         S.likeness(F.col("text_a"), F.col("edited_a")).alias("near_edited"),
                         S.likeness(F.col("text_a"), F.col("after_a")).alias("near_next")).collect()
    keys = ("fingerprint", "edited_fingerprint", "near_edited", "near_next")
    shown = lambda rs: sorted((low(r["doc_id"]), *(r[k] for k in keys)) for r in rs)
    assert shown(out) == shown(expected)
