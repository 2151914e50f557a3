import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphquarry.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """Root of a list of digests, and for each the (left, right) pairs up to it."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // arity * arity : at // arity * arity + arity]
            paths[i].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        nodes = [H(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        where = [at // arity for at in where]
    return nodes[0], paths


def brute(rows, arity):
    """(doc_id, source, lang, n_chars, text) rows to (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for name in names:
        lower[name] = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    found = {name: climb([d for _, d in lower[name]], arity) for name in names}
    root, over = climb([found[name][0] for name in names], arity)
    out = []
    for name, upper in zip(names, over, strict=True):
        sub, paths = found[name]
        out += [(i, d, sub, root, tuple(p + upper)) for (i, d), p in zip(lower[name], paths, strict=True)]
    return sorted(out, key=repr)


ROWS = (
    [(i, "big", "en", 3, f"text {i}\nof it") for i in range(200)]
    + [(1000 + i, f"s{i % 7}", None, i, "ü" * i) for i in range(60)]
    + [(5, None, "de", None, None), (None, None, "", 0, ""), (7, "", "fr", 1, "\n"), (9, "alone", "es", 9, "x\ny"), (2000, "é", "en", 1, "z"), (2001, "z", "en", 1, "z")]
    + [(3, "big", "en", 3, "same id, other text"), (4, "big", "en", 3, "text 4\nof it")]
)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_matches_brute_force(spark, arity):
    got = M.manifest(spark.createDataFrame(ROWS, SCHEMA), arity=arity).collect()
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["path"])) for r in got]
    assert sorted(found, key=repr) == brute(ROWS, arity)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(None, None, None, None, None)], [(i, f"g{i:02}", "en", 1, "x") for i in range(11)]])
def test_small_tables(spark, rows):
    got = M.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["path"])) for r in got]
    assert sorted(found, key=repr) == (brute(rows, 3) if rows else [])


def test_query_rows_and_tampering(spark, tmp_path):
    rows = [(i, "s", "en", 5, "a\nb" if i % 3 else "ab") for i in range(40)] + [(77, None, "en", None, None), (78, "t", "en", 3_000_000, "long\n" * 600_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", leaf string, path string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in M.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for i, digest, sub, root, path in brute(rows, 3):
        row, r = by_id[i], got[i]
        text = row[4].replace("\n", "") if row[4] is not None and zlib.crc32(str(i).encode()) % 2 == 0 else row[4]
        folded = leaf((*row[:4], text))
        for left, right in path:
            folded = H(left, folded, right)
        siblings = "".join(x + y for x, y in path)
        assert tuple(r) == (i, digest, sub, root, H(siblings), folded, folded == root)
    assert {r["verified"] for r in got.values()} == {True, False}


def test_siblings_are_equi_joins_on_computed_places(spark):
    nodes = spark.createDataFrame([("g", i, 4, str(i)) for i in range(4)], "group string, at long, n long, digest string")
    plan = M._siblings(nodes, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
    pairs = {r["at"]: (r["left"], r["right"]) for r in M._siblings(nodes, 2).collect()}
    assert pairs == {0: ("", "1"), 1: ("0", ""), 2: ("", "3"), 3: ("2", "")}
    assert {r["at"]: (r["left"], r["right"]) for r in M._siblings(nodes, 3).collect()} == {0: ("", "12"), 1: ("0", "2"), 2: ("01", ""), 3: ("", "")}


def test_bad_arity(spark):
    with pytest.raises(ValueError, match="arity"):
        M.manifest(spark.createDataFrame(ROWS, SCHEMA), arity=1)


def test_many_groups_join_by_key(spark, monkeypatch):
    rows = [(i, f"g{i % 9}", "en", 1, "x") for i in range(50)]
    monkeypatch.setattr(M, "SENT_GROUPS", 2)
    got = M.manifest(spark.createDataFrame(rows, SCHEMA)).where(F.col("doc_id") >= 0).collect()
    assert sorted((r["doc_id"], r["root"]) for r in got) == sorted((x[0], x[3]) for x in brute(rows, 3))


def test_levels_are_written_in_as_many_files_as_their_rows_need(spark, monkeypatch):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "16")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(M, "TASK_ROWS", 100, raising=False)
    written = []

    def kept(df, name, *more, write=M.kept):
        out = write(df, name, *more)
        if name == "merkle-level":
            written.append((out.count(), len(out.inputFiles())))
        return out

    monkeypatch.setattr(M, "kept", kept)
    got = M.manifest(own.createDataFrame(ROWS, SCHEMA), arity=3)
    assert got.rdd.getNumPartitions() <= 1 + len(ROWS) // 100
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["path"])) for r in got.collect()]
    assert sorted(found, key=repr) == brute(ROWS, 3)
    groups = len({r[1] for r in ROWS})
    assert len(written) > 4 and all(files <= 1 + (rows + groups) // 100 for rows, files in written)
