import corpus_pipeline as C
from graphquarry.llm import decontaminate, language, neardup, pii
from graphquarry.llm.common import bounded_batches
from tests.llm.test_neardup import brute as groups


def test_stages_match_brute_force_on_their_own_input(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for (name, stage), step in zip(C.STAGES, range(5), strict=True):
        out = stage(spark, docs, source)
        out.write.parquet(str(tmp_path / str(step)))
        out = spark.read.parquet(str(tmp_path / str(step)))
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert step == 4 or out.columns == list(C.COLUMNS)
        if step == 0:
            own = language.Identifier(language.learn(docs))
            found = {i: own.predict(r["text"].encode() if r["text"] else None) for i, r in before.items()}
            assert set(after) == {
                i for i, p in found.items() if p["lang_pred"] != "und" and not (p["shortened"] and p["margin"] < language.MIN_MARGIN)}
            assert len(after) > 0.97 * len(before)
        elif step == 1:
            assert set(after) == {g[0] for g in groups([(i, r["text"]) for i, r in before.items()], 80) if g[3]}
            assert all(after[i]["text"] == before[i]["text"] for i in after)
        elif step == 2:
            index = decontaminate.Windows(
                [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()], 10)
            hit = {i for i, r in before.items() if index.scan([r["text"].encode()])[0]["item_ids"]}
            assert hit and set(after) == set(before) - hit
        elif step == 3:
            assert set(after) == set(before)
            for i, r in after.items():
                assert not [m for m in pii.base_matches(r["text"]) if m.base and m.kind != 2] and r["n_chars"] == len(r["text"])
            clean = [i for i, r in before.items() if not pii.candidates(r["text"])]
            assert clean and all(after[i]["text"] == before[i]["text"] for i in clean)
        else:
            assert set(after) == set(before) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in after.values())
        docs = out


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    text = "the cat and the dog of this house were with that man who has been there before the rain"
    rows = [(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "y"),
            (None, text + " mail a@b.com", "en", None, 3, "z"), (4, "12 34", "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "zz yy")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(str(r["doc_id"]) for r in C.run(spark, str(tmp_path)).collect()) == ["1", "None"] or \
        [str(r["doc_id"]) for r in C.run(spark, str(tmp_path)).collect()] == ["None"]
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty.select(*C.COLUMNS), str(tmp_path)).collect() == []
    assert neardup.Similarity().percent == 80


def test_text_operators_lower_the_rows_per_batch(spark):
    own = spark.newSession()
    arrow, reader = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    for before, after in (("10000", "1000"), ("64", "64")):
        own.conf.set(arrow, before)
        own.conf.set(reader, before)
        bounded_batches(own.range(1))
        assert own.conf.get(arrow) == own.conf.get(reader) == after


def test_texts_between_the_steps_are_compressed_more(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call a@b.com " * 9, "en", "s", 9), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    files = {}

    def kept(df, name, *more, write=C.kept):
        out = write(df, name, *more)
        files[name] = out.inputFiles()
        assert name != "pipeline-ids" or "text" not in out.columns
        return out

    monkeypatch.setattr(C, "kept", kept)
    monkeypatch.setattr(pii, "kept", kept)
    masked = C.masked(spark, docs, "")
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == ["call [EMAIL] " * 9, None]
    assert all(r["exact"] for r in C.tokenized(spark, masked, "").collect())
    assert set(files) == {"pii-candidates", "pipeline-ids"} and all(f.endswith(".zstd.parquet") for own in files.values() for f in own)
