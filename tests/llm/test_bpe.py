import base64

import public_tokenizers
import tiktoken

from graphquarry.llm import bpe as B

RANKS = {
    base64.b64decode(a): int(b)
    for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = [
    "", " ", "  ", " a", "a ", "  a  b\n\n c", "x\n y", "\n x", " \n x", "don't  'll 's we'VE", "<|endoftext|> x", "日本語 テキスト 😀 é",
    "a\x1c b \x1f c \x85 d 　e  f", " " * 50 + "x", "\t\t x", "a" * 5000, "x   ", "word. word, (word) z-. - é. ü&&&", "1234567 12.5 ½ ²x", "é ​ z",
    "\x00 \x00a", "a\r\n b",
]


def test_ids_equal_the_rank_encoder(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()
    texts = HARD + [r["text"] for r in rows]
    own = B.Codec(B.default_vocabulary())
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        for text, ids in zip(part, own.encode([t.encode() for t in part]), strict=True):
            assert ids.tolist() == PLAIN.encode_ordinary(text), text[:80]
            assert own.decode(ids.tolist()) == text.encode()


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "CACHED_PIECES", 2)
    monkeypatch.setattr(B, "LONGEST_CACHED", 3)
    own = B.Codec(B.default_vocabulary())
    for _ in range(3):
        for text in HARD:
            assert own.encode([text.encode()])[0].tolist() == PLAIN.encode_ordinary(text)


def test_round_trip_nulls_and_split_characters(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(900, None), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids").repartition(2)
    out = B.decode(B.encode(df, offsets="places"))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in rows:
        assert bytes(got[i]["data"]).decode() == (text or "")
        assert len(got[i]["places"]) == len(got[i]["ids"]) == len(PLAIN.encode_ordinary(text or ""))
    emoji = spark.createDataFrame([("😀",)], "text string")
    ids = B.encode(emoji, offsets="places").first()
    assert len(ids["ids"]) > 1 and {(p["start"], p["stop"]) for p in ids["places"]} == {(0, 1)}
    cut = spark.createDataFrame([(ids["ids"][:1],), (None,), ([],)], "ids array<int>")
    texts = [r["data"] for r in B.decode(cut, as_text=True).collect()]
    assert "�" in texts[0] and texts[1] is None and texts[2] == ""
    assert B.encode(df.limit(0)).collect() == []


def test_worker_keeps_few_pieces():
    """A worker that meets ever new words holds a bounded number of them, and still encodes each text like a fresh one."""
    own, fresh = B.Codec(B.default_vocabulary()), B.Codec(B.default_vocabulary())
    texts = [" ".join(f"w{i}x{j}q" for j in range(20_000)).encode() for i in range(8)]
    for text in texts:
        assert own.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()
        fresh = B.Codec(B.default_vocabulary())
    assert len(own.known) + len(own.older) <= 150_000
