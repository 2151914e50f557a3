"""Stored upserts, hidden names in source trees and support-bounded pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphquarry import session
from graphquarry.operators import cochange, ownership
from graphquarry.plans import report, requests
from graphquarry.schemas import REQUEST
from graphquarry.sources import blame, source_tree, tables
from graphquarry.streaming.requests import answer_streams
from workload.testbed import Testbed

EDGES = "from_id string, to_id string, kind string, confidence double"
NODES = "kind string, name string, path string, language string"


def files_of(root, kind):
    folder = os.path.join(root, "edges", f"kind={kind}")
    return {n: os.stat(os.path.join(folder, n)).st_mtime_ns for n in os.listdir(folder)} if os.path.isdir(folder) else {}


@pytest.fixture
def stored_graph(spark, tmp_path):
    entities = tables.new_entities(spark.createDataFrame([("File", "a", "a.rs", "rust")], NODES))
    edges = spark.createDataFrame([("a", "b", "imports", 1.0), ("a", "c", "imports", 1.0), ("a", "b", "calls", 1.0), ("p", "q", "owned_by", 0.5)], EDGES)
    tables.write_graph(entities, tables.new_edges(edges), str(tmp_path))
    return str(tmp_path)


def test_upsert_rewrites_touched_kinds_only(spark, stored_graph, rows):
    before = {k: files_of(stored_graph, k) for k in ("imports", "calls", "owned_by")}
    writes = spark.createDataFrame(
        [("a", "b", "imports", 0.1, 1), ("a", "b", "imports", 0.2, 2), ("x", "y", "imports", 0.3, 1), ("a", "b", "depends_on", 0.4, 1)], EDGES + ", seq int")
    assert tables.upsert_edges(spark, stored_graph, writes, "seq") == ["depends_on", "imports"]
    assert rows(tables.read_edges(spark, stored_graph), "from_id", "to_id", "kind", "confidence") == [
        ("a", "b", "calls", 1.0), ("a", "b", "depends_on", 0.4), ("a", "b", "imports", 0.2), ("a", "c", "imports", 1.0),
        ("p", "q", "owned_by", 0.5), ("x", "y", "imports", 0.3)]
    after = {k: files_of(stored_graph, k) for k in before}
    assert after["calls"] == before["calls"] and after["owned_by"] == before["owned_by"] and after["imports"] != before["imports"]


def test_upsert_of_nothing_and_of_bad_edges(spark, stored_graph):
    before = files_of(stored_graph, "imports")
    assert tables.upsert_edges(spark, stored_graph, spark.createDataFrame([], EDGES)) == []
    for bad in (("a", "b", "sings", 1.0), ("a", "b", None, 1.0), (None, "b", "imports", 1.0)):
        with pytest.raises(ValueError, match="unknown kinds|without an end"):
            tables.upsert_edges(spark, stored_graph, spark.createDataFrame([bad], EDGES))
    assert files_of(stored_graph, "imports") == before


def write(root, names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as file:
            file.write(f"// {name} ü\n")
    return str(root)


NAMES = ["_app.tsx", "_a.ts", ".b.rs", "src/_x/.y/z.rs", "src/_x/one.ts", "src/types.d.ts", "src/readme.md", ".rs", "target/t.rs", "a/dist/n.ts",
         ".hidden/c.rs", "web/.next/d.ts", "with space+é/%41.ts", "src/targets/e.rs"]
SEEN = sorted(n for n in NAMES if n not in ("src/types.d.ts", "src/readme.md", ".rs", "target/t.rs", "a/dist/n.ts", "web/.next/d.ts"))


def test_source_tree_reads_hidden_names(spark, tmp_path):
    root = write(tmp_path / "tree", NAMES)
    got = {r.path: r.source for r in source_tree.read_source_tree(spark, root).collect()}
    assert got == {n: f"// {n} ü\n" for n in SEEN}
    assert sorted(r.path for r in source_tree.read_source_tree(spark, f"file://{root}/").collect()) == SEEN
    listed = {r.path for r in source_tree.read_source_tree(spark, root, hidden=False).collect()}
    assert listed == {"with space+é/%41.ts", "src/targets/e.rs"}


def test_source_folders_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    root = write(tmp_path / "many", [f"d{i}/s{j}/f{k}.rs" for i in range(4) for j in range(3) for k in range(5)] + [f"r{i}.ts" for i in range(7)])
    spark.dataSource.register(source_tree.SourceFolders)
    for opened in (1, 3, 100):
        frame = spark.read.format(source_tree.FORMAT).option("openedFolders", opened).load(root)
        assert frame.count() == 67 == frame.select("path").distinct().count()
    monkeypatch.setattr(source_tree, "FILES_PER_TASK", 3)
    parts = source_tree.SourceFoldersReader(root, 1).partitions()
    assert [(p.below, p.whole, p.turn, p.of) for p in parts] == [("", False, 0, 3), ("", False, 1, 3), ("", False, 2, 3)] + [(f"d{i}", True, 0, 1) for i in range(4)]
    reader = source_tree.SourceFoldersReader(root, 1)
    assert len({name for p in parts for name, _ in reader.read(p)}) == 67


def test_empty_and_missing_source_tree(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert source_tree.read_source_tree(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="missing"):
        source_tree.read_source_tree(spark, str(tmp_path / "missing")).collect()


def skewed_changes(spark):
    """A few files that change together often, and many that change once beside them."""
    rng = random.Random(3)
    rows = []
    for commit in range(300):
        hot = rng.sample(range(12), 4)
        rows += [(f"c{commit}", f"hot{i}") for i in hot] + [(f"c{commit}", f"cold{commit}_{k}") for k in range(20)]
    return spark.createDataFrame([*rows, ("c0", "hot1"), ("c0", "hot1"), ("c1", "cold1_3"), (None, "hot1"), ("c5", "hot2")], "hash string, path string")


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.6, 1.0])
@pytest.mark.parametrize("seeds", [1, 5, 500])
def test_strong_pairs_are_the_strong_ones_of_all_pairs(spark, rows, threshold, seeds):
    changes = skewed_changes(spark)
    every = cochange.cochange_confidence(cochange.cochange_pairs(changes)).where(F.col("confidence") >= threshold)
    assert rows(cochange.strong_pairs(changes, threshold, seed_files=seeds)) == rows(every)


def test_strong_pairs_make_fewer_pairs(spark):
    changes = skewed_changes(spark)
    bounds = {r.path: r.bound for r in cochange.pair_bounds(cochange._listed(changes)).collect()}
    pairs = cochange.cochange_pairs(changes).collect()
    assert all(p["count"] <= min(bounds[p.file_a], bounds[p.file_b]) for p in pairs)
    top = max(p["count"] for p in pairs)
    made = [p for p in pairs if min(bounds[p.file_a], bounds[p.file_b]) >= 0.25 * top]
    assert len(pairs) > 60_000 and len(made) < 100


def test_strong_pairs_of_no_changes(spark):
    assert cochange.strong_pairs(spark.createDataFrame([], "hash string, path string"), 0.25).collect() == []
    with pytest.raises(ValueError, match="share"):
        cochange.strong_pairs(spark.createDataFrame([], "hash string, path string"), 2.0)


def blame_dump(rng, lines, commits):
    """A porcelain dump; a commit is described where it first occurs, and contents may look like headers."""
    out, seen, want = "", set(), {}
    for i in range(1, lines + 1):
        k = rng.randrange(commits)
        sha, author, mail = f"{k + 10:x}" * 40, f"Author {k % 3}", f"a{k % 3}@example.com"
        out += f"{sha} {i} {i} 1\n"
        if sha not in seen:
            seen.add(sha)
            out += f"author {author}\nauthor-mail <{mail}>\nauthor-time 1\nsummary author nobody\nfilename f\n"
        content = rng.choice(["let x = 1;", "", f"{'ab' * 20} 1 1 1", "author nobody", "\tindented", "author-mail <x@y>"])
        out += f"\t{content}\n"
        want[author, mail] = want.get((author, mail), 0) + 1
    return out, [(a, m, n) for (a, m), n in want.items()]


def test_blame_records_need_no_order_and_split(spark, tmp_path, rows):
    rng = random.Random(8)
    want = []
    for name, lines, commits in (("src/a.rs", 4000, 6), ("one.rs", 1, 1), ("src/deep/b.ts", 200, 3)):
        dump, owners = blame_dump(rng, lines, commits)
        path = tmp_path / "blame" / f"{name}.blame"
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(dump)
        want += [(name, *o) for o in owners]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = blame.read_blame_records(spark, str(tmp_path / "blame"))
        assert records.rdd.getNumPartitions() > 5
        found = rows(ownership.blamed_from_records(records.orderBy(F.rand(3))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted(want, key=repr) == rows(ownership.blamed_from_dumps(blame.read_blame_dumps(spark, str(tmp_path / "blame"))))


def test_sketched_sizes_make_no_pairs(spark):
    hub = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(3001, 3040)]
    files = spark.createDataFrame([(i,) for i in range(3041)], "idx long")
    links = spark.createDataFrame([("imports", a, b) for a, b in hub], "kind string, source long, target long")
    plan = report.blast_size_estimate(files, links)
    got = {r.idx: r.blast for r in plan.collect()}
    assert all(abs(got[i] - 3000) < 300 for i in range(3001))
    assert [got[i] for i in (3001, 3010, 3040)] == [3, 6, 3]
    assert report.blast_size_estimate(files.limit(0), links.limit(0)).collect() == []


def test_one_hop_stream_joins_stored_answers(spark, tmp_path):
    entities = spark.createDataFrame(
        [("a", "File", "a.rs", "src/a.rs", "rust"), ("b", "File", "b.rs", "src/b.rs", "rust"), ("p", "Person", "Pat", "p@x", "")], "id string, " + NODES)
    edges = spark.createDataFrame([("a", "b", "imports", 1.0), ("a", "p", "owned_by", 0.5), ("a", "b", "co_changes_with", None)], EDGES)
    asked = [(str(i), tool, entity, None, way, None) for i, (tool, entity, way) in enumerate(
        [("dependencies", "src/a.rs", None), ("dependencies", "src/b.rs", "upstream"), ("who_owns", "src/a.rs", None), ("co_changes", "src/b.rs", None),
         ("dependencies", "src/none.rs", None), ("who_owns", None, None), ("co_changes", "../x", None), ("sing", "src/a.rs", None), (None, None, None)])]
    rows = spark.createDataFrame(asked, REQUEST)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in")
    prepared = requests.Prepared(entities, edges)
    answered = requests.one_hop_answers(stream, prepared.ids, requests.one_hop_table(entities, edges))
    plan = answered._jdf.queryExecution().analyzed().toString()
    assert answered.isStreaming and plan.count("Join LeftOuter") == 2 and "StreamingRelation" in plan
    for running in answer_streams(stream, entities, edges, f"{tmp_path}/out", f"{tmp_path}/progress"):
        running.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/one-hop").collect()), key=repr)
    assert got == sorted(map(tuple, requests.answer(rows, entities, edges).collect()), key=repr)
    assert len(got) == len(asked) and not os.path.exists(f"{tmp_path}/progress/one-hop-batch")


def test_tasks_of_the_views_read_bounded_parts(spark, tmp_path):
    own = spark.newSession()
    size, part, first = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
                         "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for name, value in ((size, "64m"), (part, "128MB"), (first, "4")):
        own.conf.set(name, value)
    Testbed(own, str(tmp_path))
    assert [own.conf.get(n) for n in (size, part, first)] == [str(16 << 20), str(64 << 20), "200"]
    for name, value in ((size, "1m"), (part, "2MB"), (first, "500")):  # what is finer already stays
        own.conf.set(name, value)
    Testbed(own, str(tmp_path))
    assert [session._bytes(own.conf.get(n)) for n in (size, part)] == [1 << 20, 2 << 20]
    assert own.conf.get(first) == "500"


def small_tables(spark, folder):
    """Parts, orders and line items with repeated and missing keys and values."""
    rng = random.Random(21)
    some = lambda *values: rng.choice(values)
    written = {
        "nation": ([(0, "A", 0), (1, "B", 0), (2, None, 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(c, f"C{c}", some(0, 1, 2, None)) for c in (*range(6), 3, None)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(p, some("x y", None), some("Brand#1", None), some("PROMO", "SMALL", None), some(1, 30, None)) for p in (*range(6), 2, None)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(o, some(*range(6), None), some("1998", "1999", None), "5-LOW") for o in (*range(20), 4, None)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(some(*range(20), None), some(*range(6), None), 0, some(1, 2, None), "A") for _ in range(150)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"),
        "supplier": ([(0, "S", 1.0)], "s_suppkey long, s_name string, s_acctbal double"),
        "events": ([], "event_id long"), "documents": ([], "doc_id long"), "labels": ([], "doc_id long"),
    }
    for name, (listed, schema) in written.items():
        table = spark.createDataFrame(listed, schema)
        if name == "orders":
            table = table.withColumn("o_orderdate", F.to_timestamp("o_orderdate", "yyyy"))
        table.write.parquet(f"{folder}/{name}.parquet")
    return Testbed(spark, str(folder))


@pytest.mark.parametrize("view", ["tb_hunks", "tb_first_hunks", "tb_blame_lines", "tb_dumps"])
def test_held_hunks_are_the_views(spark, tmp_path, view):
    t = small_tables(spark, tmp_path)
    want, got = t.sql(f"SELECT * FROM {view}"), t.held_hunks(view)
    assert got.columns == want.columns and want.count() > 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["struct", "changes", "blame"])
def test_held_lines_are_the_views(spark, tmp_path, name):
    t = small_tables(spark, tmp_path)
    got = t.held_lines()[name]
    want = t.sql(f"SELECT {', '.join(got.columns)} FROM tb_{name}")
    assert want.count() > 5
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jsparkSession.sparkContext().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "shuffle_" in x}

    before = files()
    kept = session.stored(spark.range(1000).repartition(5, "id"), "kept")
    assert files() <= before and kept.count() == 1000
    assert spark.conf.get(session.CLEANUP_CONF, "false") == "false"
    assert all(".zstd." in f for f in kept.inputFiles())
