import hashlib
import random

from graphquarry.llm import linededup as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=2, min_chars=10):
    """(id, text) rows to (id, n_lines, n_dropped, kept text), by plain loops."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    small = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(small(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < min_docs or min(holders[key(x)]) == small(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in L.deduplicate(docs, **options).select("doc_id", *L.RESULT).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(11)
    pool = [f"{w} line number {i}" for i in range(40) for w in ("The", "THE", " the\t")]
    pool += ["", " ", "short", "exactly te", "nine char", "ÄÖÜ große Straße", "äöü GROSSE Straße", "İstanbul ve ǅ ⅠⅡⅢ", "\x0btab\x0c and feed \r", "  kept edge space", "Русский ТЕКСТ здесь", "русский ТЕКСТ здесь"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, min_docs=9, min_chars=17) == brute(rows, 9, 17)


def test_null_empty_repeated_and_shared_ids(spark):
    rows = [(None, "a shared line here\nx"), (3, None), (4, ""), (5, "\n\n"), (6, "A SHARED line here  \n"), (6, "A SHARED line here  \n"),
            (6, "another text of the id\na shared line here"), (7, "only in one row\nonly in one row"), (8, "another text of the id\nlast")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_very_long_text_and_a_line_in_every_document(spark):
    rows = [(i, f"the same notice in all\nline of {i} alone") for i in range(3000)]
    rows.append((-1, "\n".join(f"row {i % 70_000} of a long text" for i in range(150_000)) + "\n" + "x" * 3_000_000))
    rows.append((9000, "\n".join(f"row {i} of a long text" for i in range(0, 70_000, 2)) + "\nend of it"))
    assert found(spark, rows) == brute(rows)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "same line of text", "x", 5), (2, "same line of text", None, 6)], "doc_id long, text string, kept_text string, note int")
    got = sorted(tuple(r) for r in L.deduplicate(docs).select("doc_id", "text", "note", "n_lines", "n_dropped", "kept_text").collect())
    assert got == [(1, "same line of text", 5, 1, 0, "same line of text"), (2, "same line of text", 6, 1, 1, "")]


def test_plan_is_native(spark):
    plan = L.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan


def test_query_hash(spark, tmp_path):
    rows = [(1, "first long line\nb"), (2, "FIRST LONG LINE\nc\n"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in L.query(spark, str(tmp_path)).collect())
    assert got == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
