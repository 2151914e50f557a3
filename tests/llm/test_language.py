from graphquarry.llm import language as L

EN = "the cat and the dog of this house were with that man who has been there before the rain "
DE = "der Hund und die Katze aus dem Haus waren mit dem Mann der schon vor dem Regen nicht da war "
FR = "le chien et la chatte de cette maison étaient avec un homme qui était là avant la pluie "


def labelled(spark):
    rows = [(i, t * (3 + i % 4), lang, "x") for i in range(40) for t, lang in ((EN, "en"), (DE, "de"), (FR, "fr"))]
    rows += [(900 + i, EN * 6, "en", "x") for i in range(50)]  # copies count once
    rows += [(1, None, "en", "x"), (2, "text", None, "x"), (3, "1234 !!", "zz", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_predicts_rejects_and_replaces_clashing_columns(spark):
    samples = L.learn(labelled(spark))
    assert list(samples) == ["de", "en", "fr"]  # as many distinct texts each
    docs = spark.createDataFrame(
        [(1, EN, "q"), (2, DE.upper(), "q"), (3, FR, "q"), (4, None, "q"), (5, "12 !? 99", "q"), (6, "", "q"), (7, EN * 3000, "q"), (8, "日本", "q"), (1, EN, "q")],
        "doc_id long, text string, score string",
    )
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"], r["score"]) for r in L.identify(docs, samples).collect()}
    assert [got[i][0] for i in (1, 2, 3, 7)] == ["en", "de", "fr", "en"] and not any(got[i][1] for i in (1, 2, 3, 7))
    assert all(got[i] == ("und", True, 0.0) for i in (4, 5, 6)) and got[8][0] in samples
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_bounded_sample_and_nothing_learned(spark):
    docs = labelled(spark)
    samples = L.learn(docs, documents=2, chars=50)
    assert all(len(s) <= 2 * (50 * 2) for s in samples.values())
    assert L.learn(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.identify(docs.limit(0), samples).collect() == []


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = L.learn(docs.where(~L.held_out()))
    rows = L.identify(docs.where(L.held_out()).select("text", "lang"), samples).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)
