import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from graphquarry.llm import alignment as A
from graphquarry.llm.common import table


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = A.default_vocabularies()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=b)


def brute(libraries, text):
    """(a tokens, b tokens) as (id, byte end) by decoding alone, or two empty lists."""
    first, second = libraries
    if not text:
        return [], []
    whole = (" " + text).encode()
    letters = A._byte_of()
    found = []
    for ids, data in (
        (first.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in first.id_to_token(i))),
        (second.encode(text), lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()),
    ):
        joined, tokens = b"", []
        for i in ids:
            joined += data(i)
            tokens.append((i, len(joined)))
        if joined != whole:
            return [], []
        found.append(tokens)
    return tuple(found)


def groups_of(a, b):
    common = {e for _, e in a} & {e for _, e in b}
    number = {e: k for k, e in enumerate(sorted(common))}
    out = [([], []) for _ in common]
    for side, tokens in enumerate((a, b)):
        k = 0
        for i, end in tokens:
            out[k][side].append(str(i))
            k = number.get(end, k - 1) + 1
    return out


def brute_rows(libraries, rows):
    tokens = {text: brute(libraries, text) for _, text in rows}
    links = {}
    for t, (a, b) in tokens.items():
        at = {e: i for i, e in a}
        links[t] = [(at[e], i) for i, e in b if e in at]
    count = Counter(p for _, t in rows for p in links[t])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, t in rows:
        a, b = tokens[t]
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups_of(a, b))
        out.append((i, len(a), len(b), len(groups_of(a, b)), len(links[t]), sum(count[p] == best[p[1]] for p in links[t]),
                    sum(count[p] for p in links[t]), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\n b", "a \nb\n\n c", "\t x\ty ", "x\r\n y", "  b　c   d", "naïve 嗨𐍈 x", "嗨 你好，世界。 𐍈",
       "piece ▁ sign", "▁", "a▁b", "<|endoftext|> <s> </s> <unk> <0x0A>", "é é ﬁ", "\x00 nul \x01", "👩‍👩‍👧 family", "_, __. $5.00 it's we'll", "\x1c b \x1f c", "Привет, мир!", "مرحبا بالعالم", "a" * 300, "word " * 50, "﻿bom", "1234567 89"]


def query(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = A.query(spark, str(folder)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_query_matches_brute_force(spark, tmp_path, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (5, "a b c"), (5, "a b c")]
    assert query(spark, tmp_path, rows) == brute_rows(libraries, rows)


def test_pair_table_joined_by_key_gives_the_same(spark, tmp_path, libraries, monkeypatch):
    monkeypatch.setattr(A, "SENT_PAIRS", 10)
    rows = [(i, t) for i, t in enumerate(ODD * 2)]
    assert query(spark, tmp_path, rows) == brute_rows(libraries, rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_random_texts_and_forgetting_pieces(libraries, monkeypatch):
    monkeypatch.setattr(A, "CACHED_PIECES", 40)
    rng = random.Random(13)
    own = A.Aligner(*A.default_vocabularies())
    assert own.separable
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "嗨", "𐍈", "\t", ".", ",", "'s", "12", "word", " ", "_"]) for _ in range(rng.randrange(1, 40))) for _ in range(5)]
        got = own.linked([t.encode() for t in texts]).to_pylist()
        for text, row in zip(texts, got, strict=True):
            a, b = brute(libraries, text)
            assert row["groups"] == ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups_of(a, b)), repr(text)
            assert (row["n_a"], row["n_b"], row["n_groups"], sum(x["times"] for x in row["links"])) == (len(a), len(b), len(groups_of(a, b)), len(groups_of(a, b)))


def test_spans_are_whole_texts(spark, libraries):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    for r in A.align(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect():
        a, b = brute(libraries, r["text"])
        s = r["spans"]
        found = ([], []) if s is None else (list(zip(s["a_ids"], s["a_ends"], strict=True)), list(zip(s["b_ids"], s["b_ends"], strict=True)))
        assert found == (a, b)


def test_texts_stay_whole_without_separable_vocabularies(libraries):
    own = A.Aligner(*A.default_vocabularies())
    texts = [t.encode() if t else None for t in ODD]
    cut = own.linked(texts)
    other = A.Aligner(*A.default_vocabularies())
    other.separable = False
    assert other.linked(texts).equals(cut)


def test_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three " * 60_000, 9, "k"), (2, "", 9, "k")], "doc_id long, text string, n_a int, keep string")
    got = {r["doc_id"]: r for r in A.counted(A.linked(docs)).collect()}
    assert got[1]["n_a"] == 180_001 and got[1]["keep"] == "k" and got[2]["n_a"] == 0 and got[2]["count_sum"] == 0
    assert pa.types.is_struct(A.LINKED)
