"""Commit logs, co-change and blame."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from graphquarry.operators import cochange, ownership
from graphquarry.operators.ordered import dense_index, fill_forward, heavy_keys
from graphquarry.sources import blame, commit_log
from pyspark.sql import functions as F

LOG = """COMMIT_START
abc123def456abc123def456abc123def456abc1
Alice
alice@example.com
1700000000
Initial commit
A\tsrc/main.rs
A\tCargo.toml
COMMIT_START
def456abc123def456abc123def456abc123def4
Bob
bob@example.com
1699999000
Second commit

M\tsrc/main.rs
D\told_file.txt
R100\told name.rs\tnew name.rs
nonsense
COMMIT_START
short
record
COMMIT_START
hash3
Cy
cy@example.com
zz
COMMIT_START marks a commit
C75\ta.rs\tb\tc.rs
R\tonly_old.rs
"""


def test_commit_log_file(spark, rows, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    commits = commit_log.parse_commits(commit_log.read_commit_log(spark, str(tmp_path)))
    assert rows(commits, "author", "email", "timestamp", "message") == [
        ("Alice", "alice@example.com", 1700000000, "Initial commit"),
        ("Bob", "bob@example.com", 1699999000, "Second commit"),
        ("Cy", "cy@example.com", 0, "COMMIT_START marks a commit"),
    ]
    assert rows(commit_log.changes(commits), "path", "kind") == sorted([
        ("src/main.rs", "Added"), ("Cargo.toml", "Added"), ("src/main.rs", "Modified"), ("old_file.txt", "Deleted"),
        ("new name.rs", "Modified"), ("b\tc.rs", "Modified"), ("only_old.rs", "Modified"),
    ], key=repr)
    assert [r.author for r in commit_log.newest_commits(commits, 2).collect()] == ["Alice", "Bob"]


def test_line_ends_and_several_files(spark, rows, tmp_path):
    (tmp_path / "a.log").write_bytes(LOG.replace("\n", "\r\n").encode())
    (tmp_path / "b.log").write_text("COMMIT_START\nhash9\nDee\nd@example.com\n5\nno changes")
    (tmp_path / "c.log").write_text("COMMIT_START\nhash8\nEve\ne@example.com\n6\nlast\nM\tx.rs\n")
    both = commit_log.parse_commits(commit_log.read_commit_log(spark, str(tmp_path)))
    assert rows(both, "author", "message") == [
        ("Alice", "Initial commit"), ("Bob", "Second commit"), ("Cy", "COMMIT_START marks a commit"), ("Dee", "no changes"), ("Eve", "last")]
    only = commit_log.parse_commits(commit_log.read_commit_log(spark, str(tmp_path / "a.log")))
    assert rows(only, "author") == [("Alice",), ("Bob",), ("Cy",)]
    assert ("only_old.rs", "Modified") in rows(commit_log.changes(only), "path", "kind")
    mixed = spark.createDataFrame([("h\na\ne\n1\nm\nCOMMIT_START\nh2",)], "record string")
    with pytest.raises(Exception, match="marker line inside"):
        commit_log.parse_commits(mixed).collect()


def test_records_are_parsed_once(spark, rows):
    text = [(r.removesuffix("\n"),) for r in ("COMMIT_START\nh\na\ne\n5\nm\nA\tx\n\n", "h2\r\na\r\ne\r\nzz\r\nm\r\nR\to\tn\r\n", "short")]
    records = spark.createDataFrame(text, "record string").repartition(2)
    found = commit_log.changes(commit_log.parse_commits(records))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error") == 1  # no filter or join condition has the text read again
    assert rows(found) == [("h", "x", "Added"), ("h2", "n", "Modified")]


def test_no_limit_keeps_all_commits(spark):
    commits = spark.range(12_000).selectExpr("cast(id AS string) AS hash", "id AS timestamp", "array(id) AS files_changed")
    assert commit_log.newest_commits(commits).count() == 12_000
    assert commit_log.newest_commits(commits, 11_000).count() == 11_000


def test_merges_are_left_out(spark):
    commits = spark.createDataFrame([("a", 2, ["x", "y"]), ("b", 1, ["x"]), ("c", 0, [])],
                                    "hash string, timestamp long, parents array<string>")
    assert [r.hash for r in commit_log.newest_commits(commits).collect()] == ["b", "c"]


def changes(spark, commits):
    listed = [(h, p) for h, files in commits for p in files]
    return spark.createDataFrame(listed, "hash string, path string")


def test_cochange_frequency_and_confidence(spark, rows):
    commits = [(h, ["a.rs", "b.rs"]) for h in "abcde"] + [("f", ["c.rs", "a.rs"])]
    scored = cochange.cochange_confidence(cochange.cochange_pairs(changes(spark, commits)))
    assert rows(scored) == [("a.rs", "b.rs", 5, 1.0), ("a.rs", "c.rs", 1, 0.2)]
    first = cochange.ranked_cochanges(scored).first()
    assert (first.file_a, first.file_b) == ("a.rs", "b.rs")


def test_cochange_of_nothing(spark):
    none = spark.createDataFrame([], "hash string, path string")
    assert cochange.cochange_confidence(cochange.cochange_pairs(none)).isEmpty()


def test_cochange_blocks_equal_position_pairs(spark):
    """A commit with a third of all rows, repeated paths and tiny blocks against a brute force."""
    rng = random.Random(7)
    commits = [(str(i), [f"f{rng.randrange(60)}" for _ in range(rng.randrange(1, 7))]) for i in range(80)]
    commits.append(("hot", [f"f{rng.randrange(90)}" for _ in range(140)]))
    want = Counter()
    for _, files in commits:
        want.update(tuple(sorted(pair)) for pair in combinations(files, 2))
    for block in (2048, 16, 3):
        got = cochange.cochange_pairs(changes(spark, commits), block).collect()
        assert {(r.file_a, r.file_b): r["count"] for r in got} == dict(want)


def test_numbered_paths_give_the_same_pairs_and_edges(spark, rows):
    """Codes stand for paths in pairs, strong pairs and edges; null paths and commits pair with nothing."""
    rng = random.Random(11)
    listed = [(str(i), f"{'aB/'[rng.randrange(3)]}{rng.randrange(30)}") for i in range(25) for _ in range(6)]
    listed += [("1", None), ("1", None), (None, "a1"), (None, "a2")]
    table = spark.createDataFrame(listed, "hash string, path string")
    names = sorted({p for _, p in listed if p})
    entities = spark.createDataFrame([(f"e{i}", "File", p, p, None) for i, p in enumerate(names) if i % 3], "id string, kind string, name string, path string, language string")
    codes = cochange.path_codes(table)
    assert rows(codes, "path", "code") == sorted(((p, i) for i, p in enumerate(names)), key=repr)
    for block, part in ((2048, table), (3, table.where("path IS NOT NULL"))):
        by_path, by_code = cochange.cochange_pairs(part, block), cochange.cochange_pairs(part, block, codes)
        assert dict(by_code.dtypes)["file_a"] == "bigint"  # no path moves with a pair
        assert rows(by_path) == sorted(((names[a], names[b], n) for a, b, n in by_code.collect()), key=repr)
    plain = cochange.cochange_edges(cochange.strong_pairs(table, 0.4), entities)
    assert rows(plain) == rows(cochange.cochange_edges(cochange.strong_pairs(table, 0.4, codes=codes), entities, codes))


def test_hot_files_and_big_commits_count_the_same(spark, rows, monkeypatch):
    """Slices, hot files' pairs and blocks of big commits add up, with and without numbers."""
    rng = random.Random(13)
    commits = [(str(i), [f"f{rng.choice((0, 1, rng.randrange(40)))}" for _ in range(rng.randrange(1, 9))]) for i in range(60)]
    table = changes(spark, commits).unionByName(spark.createDataFrame([(None, "f0"), (None, "f1")], "hash string, path string"))
    want = Counter()
    for _, files in commits:
        want.update(tuple(sorted(pair)) for pair in combinations(files, 2))
    codes = cochange.path_codes(table)
    names = {r.code: r.path for r in codes.collect()}
    for hot, block in ((1 << 14, 2048), (20, 2048), (20, 4), (0, 1)):
        monkeypatch.setattr(cochange, "HOT_CHANGES", hot)
        assert {(r.file_a, r.file_b): r["count"] for r in cochange.cochange_pairs(table, block).collect()} == dict(want)
        got = cochange.cochange_pairs(table, block, codes).collect()
        assert {(names[r.file_a], names[r.file_b]): r["count"] for r in got} == dict(want) and len(got) == len(want)


def test_pairs_move_as_slices_and_meet_their_ids_where_they_are_counted(spark):
    """Two shuffles of changes and slices; the join with the first file's id adds none to the pairs."""
    table = changes(spark, [(str(i), [f"f{i % 7}", f"f{i % 5}", "x"]) for i in range(50)])
    codes = cochange.path_codes(table)
    pairs = cochange.cochange_pairs(table, codes=codes)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    ids = codes.select(F.col("code").alias("file_a"), F.lit("id").alias("id"))
    met = pairs.join(ids.hint("merge"), "file_a")._jdf.queryExecution().executedPlan().toString()
    assert met.count("Exchange") == 3  # the third is the ids'


def test_shares_need_one_shuffle_of_lines(spark, rows):
    lines = [("a", "Ann", "a@x")] * 6 + [("a", "Bob", "b@x")] * 2 + [("b", "Bob", "b@x")] + [(None, "Bob", "b@x")]
    blamed = spark.createDataFrame(lines, "path string, author string, email string")
    want = [("a", "Ann", 6, 75.0), ("a", "Bob", 2, 25.0), ("b", "Bob", 1, 100.0)]
    shares = ownership.ownership_share(ownership.line_counts(blamed))
    assert rows(shares, "path", "author", "line_count", "percentage") == want
    plan = shares.groupBy("path", "email").agg(F.sum("percentage"))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"path#\d+", keys) for keys in dealt)  # equal shuffles run once
    hot = ownership.ownership_share(ownership.line_counts(blamed, 3))
    assert rows(hot, "path", "author", "line_count", "percentage") == want


SHA1, SHA2 = "1" * 40, "2" * 40
DUMP = f"""{SHA1} 1 1 2
author Ann
author-mail <ann@x.org>
summary author of things
filename a.rs
\tfirst
{SHA1} 2 2
\tauthor Nobody
{SHA2} 3 3 1
author Bob
author-mail <bob@x.org>
filename a.rs
\tthird
{SHA1} 4 4 1
\tfourth
"""


@pytest.mark.parametrize("chunk", [1 << 17, 3, 1])
def test_blame_attribution(spark, rows, chunk):
    lines = blame.blame_lines(spark.createDataFrame([("a.rs", DUMP), ("-x.rs", DUMP)], "path string, dump string"))
    by_commit = ownership.ownership_share(ownership.blamed_lines(lines, "by_commit", chunk))
    assert rows(by_commit, "path", "author", "line_count", "percentage") == [("a.rs", "Ann", 3, 75.0), ("a.rs", "Bob", 1, 25.0)]
    carried = ownership.ownership_share(ownership.blamed_lines(lines, "carry_forward", chunk))
    assert rows(carried, "author", "line_count", "percentage") == [("Ann", 2, 50.0), ("Bob", 2, 50.0)]


def test_blame_dump_files(spark, rows, tmp_path):
    (tmp_path / "src dir").mkdir()
    (tmp_path / "src dir" / "a+b.rs.blame").write_text(DUMP)
    dumps = blame.read_blame_dumps(spark, str(tmp_path))
    counted = ownership.blamed_from_dumps(dumps)
    assert rows(counted) == [("src dir/a+b.rs", "Ann", "ann@x.org", 3), ("src dir/a+b.rs", "Bob", "bob@x.org", 1)]


def test_owner_ranks_and_edge_merge(spark, rows):
    counts = spark.createDataFrame(
        [("a.rs", "Ann", "x@x", 6), ("a.rs", "Anne", "x@x", 2), ("a.rs", "Bob", "b@x", 2)],
        "path string, author string, email string, line_count long")
    shares = ownership.ownership_share(counts)
    assert rows(ownership.ranked_owners(shares), "author", "rank") == [("Ann", 1), ("Anne", 3), ("Bob", 2)]
    entities = spark.createDataFrame(
        [("f", "File", "a.rs", "a.rs"), ("x", "Person", "Ann", "x@x"), ("b", "Person", "Bob", "b@x")],
        "id string, kind string, name string, path string")
    entities = entities.withColumn("language", F.lit(None).cast("string"))
    edge = lambda merge: rows(ownership.ownership_edges(shares, entities, merge), "to_id", "confidence")
    assert edge("sum") == [("b", 0.2), ("x", 0.8)]
    assert edge("last") == [("b", 0.2), ("x", 0.2)]
    people = ownership.persons(counts, entities.where("id <> 'x'"))
    assert rows(people, "name", "path") == [("Ann", "x@x")]


def test_fill_forward_over_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot", i, f"v{i}" if rng.random() < 0.05 else None) for i in range(3000)]
    data += [(f"g{g}", i, f"w{i}" if rng.random() < 0.3 else None) for g in range(5) for i in range(20)]
    df = spark.createDataFrame(data, "g string, pos long, v string")
    got = {(r.g, r.pos): r.v for r in fill_forward(df, "g", "pos", ["v"], 64).collect()}
    last, want = {}, {}
    for g, pos, value in data:
        last[g] = value or last.get(g)
        want[g, pos] = last[g]
    assert got == want


def test_heavy_keys(spark):
    rng = random.Random(5)
    keys = [rng.choice("abcdefgh") if rng.random() < 0.5 else f"k{rng.randrange(400)}" for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    for most, buckets in ((100, 1 << 16), (100, 7), (5, 50)):
        assert {r.k for r in heavy_keys(df, "k", most, buckets).collect()} == {k for k, n in Counter(keys).items() if n > most}
    assert heavy_keys(df, "k", 3000) is None and heavy_keys(df, "k", 2000, 1) is None


def test_rows_without_position_are_filled_among_themselves(spark, rows):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, None), ("a", 2, "y"), ("a", 3, None)], "g string, pos long, v string")
    assert rows(fill_forward(df, "g", "pos", ["v"])) == sorted([("a", None, "x"), ("a", 1, None), ("a", 2, "y"), ("a", 3, "y")], key=repr)


@pytest.mark.parametrize("mode", ["by_commit", "carry_forward"])
def test_blamed_lines_move_once(spark, mode):
    """Files of ordinary length are filled and summed in one task each, however far apart their lines are."""
    lines = spark.createDataFrame([("a.rs", i << 20, line) for i, line in enumerate(DUMP.split("\n"))], "path string, pos long, line string")
    found = ownership.blamed_lines(lines, mode)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {"Ann": 3, "Bob": 1} if mode == "by_commit" else {"Ann": 2, "Bob": 2}
    assert {r.author: r.line_count for r in found.collect()} == want


def test_dense_index(spark):
    names = [f"n{i:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(7)
    got = {r.name: r.idx for r in dense_index(df, [F.asc("name")], "idx").collect()}
    assert got == {n: i for i, n in enumerate(names)}
