import random
import re
import time

from graphquarry.llm import pii as P

BASE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def checks(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        total = sum(n - 9 if (n := int(c) * (2 if i % 2 else 1)) > 9 else n for i, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text or "") if checks(k, m.group()))


def test_base_matches_equal_the_plain_patterns():
    rng = random.Random(1)
    alphabet = "ab@.-+0123456789 ()%@@..é"
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert sorted((m.start, m.kind, m.stop) for m in P.base_matches(text) if m.base) == brute(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("x" * 300_000, "1" * 300_000, "a@" * 150_000, "+1 " * 100_000, "1." * 150_000, " at x.y" * 40_000, "+1 (212) 555-0100 " * 5000):
        P.decide(P.candidates(text), None)
    assert time.time() - began < 30


def documents(spark):
    rows = [(i, f"mail bob{i}@example.com or call +1 (212) 555-01{i:02d} from 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"phone: 212-555-01{i:02d} please") for i in range(20)]
    rows += [(200 + i, f"write to ann{i} [at] example [dot] org now") for i in range(20)]
    rows += [(300 + i, f"order 4111 1111 1111 111{i % 10} and v1.2.3.{300 + i}") for i in range(20)]
    rows += [(400, None), (401, ""), (402, "plain text, nothing here at all"), (402, "plain text, nothing here at all")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS spans")


def test_labelers_agree_and_the_classifier_adds_spans(spark):
    rows, docs = documents(spark)
    got = {r["doc_id"]: r for r in P.find(docs).collect()}
    for i, text in rows:
        base = [(s["start"], P.KINDS.index(s["kind"]), s["stop"]) for s in got[i]["base_spans"]]
        assert base == brute(text)
        assert {tuple(s) for s in got[i]["base_spans"]} <= {tuple(s) for s in got[i]["spans"]}
    assert [s["kind"] for s in got[105]["spans"]] == ["phone"] and [s["kind"] for s in got[205]["spans"]] == ["email"]
    assert all(not got[i]["spans"] for i in (302, 400, 401, 402))
    masked = {r["doc_id"]: r["text"] for r in P.mask(docs).collect()}
    assert masked[3] == "mail [EMAIL] or call [PHONE] from [IP]" and masked[205] == "write to [EMAIL] now" and masked[400] is None


def test_reliabilities_separate_good_from_bad_labelers(spark):
    _, docs = documents(spark)
    found = docs.select("doc_id", P.candidate_spans("text").alias("candidates"))
    model = P.train(found)
    validity = model["reliability"]["card"]["validity"]
    assert validity["true"][2] > validity["false"][2]
    assert P.train(found.limit(0))["weights"] is None
    assert P.find(docs.limit(0)).collect() == []
