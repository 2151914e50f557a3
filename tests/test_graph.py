"""The graph end to end: index, load, queries, requests, report and stream."""

import json
import random
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphquarry import CodeGraph
from graphquarry.operators import blast, neighbors, ownership, resolve
from graphquarry.plans import requests
from graphquarry.plans.report import Report
from graphquarry.sources import commit_log, source_tree, tables
from graphquarry.streaming.requests import answer_stream

RUST_REPO = {
    "src/main.rs": "mod auth;\nuse sample::billing;\n\nfn main() {\n    auth::login();\n}\n",
    "src/lib.rs": "pub mod billing;\n",
    "src/auth.rs": "pub fn login() -> bool {\n    validate()\n}\n\nfn validate() -> bool {\n    true\n}\n\npub struct Session {}\n",
    "src/billing.rs": "pub fn charge() -> bool {\n    true\n}\n\npub struct Invoice {}\n",
    "Cargo.toml": "[package]\n",
    "target/debug/gen.rs": "fn generated() {}\n",
}
TS_REPO = {
    "src/main.ts": 'import { helper } from "./utils.js";\nimport type { Config } from "./types.js";\n',
    "src/utils.ts": 'import type { Config } from "./types.js";\n',
    "src/types.ts": "export interface Config { name: string }\n",
    "src/index.ts": 'export * from "./main.js";\n',
    "src/external.ts": 'import { describe } from "vitest";\nimport fs from "node:fs";\nimport cp from "node:child_process";\n',
    "src/types.d.ts": "declare const x: number;\n",
}


def write_tree(root: Path, tree: dict) -> str:
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def indexed(spark, tmp_path, tree):
    files = source_tree.read_source_tree(spark, write_tree(tmp_path / "repo", tree))
    return CodeGraph.index(str(tmp_path / "graph"), files)


def test_rust_repository(spark, rows, tmp_path):
    graph = indexed(spark, tmp_path, RUST_REPO)
    assert rows(graph.entities.where("kind = 'File'"), "path", "language") == [
        (p, "rust") for p in ("src/auth.rs", "src/billing.rs", "src/lib.rs", "src/main.rs")]
    assert rows(graph.entities.where("kind <> 'File'"), "kind", "path") == [
        ("Function", "src/auth.rs::login"), ("Function", "src/auth.rs::validate"), ("Function", "src/billing.rs::charge"),
        ("Function", "src/main.rs::main"), ("Struct", "src/auth.rs::Session"), ("Struct", "src/billing.rs::Invoice")]
    assert rows(graph.blast_radius("src/main.rs"), "path", "depth", "edge_kind") == [("src/auth.rs", 1, "imports")]
    assert rows(graph.dependencies("src/billing.rs", "upstream"), "path", "edge_kind") == [("src/lib.rs", "imports")]
    assert {r.path: r.edge_count for r in graph.hotspots().collect()} == {
        "src/auth.rs": 1, "src/billing.rs": 1, "src/lib.rs": 1, "src/main.rs": 1,
        "src/auth.rs::login": 0, "src/auth.rs::validate": 0, "src/billing.rs::charge": 0, "src/main.rs::main": 0,
        "src/auth.rs::Session": 0, "src/billing.rs::Invoice": 0}
    assert graph.blast_radius("src/auth.rs::login").isEmpty() and graph.blast_radius("nope.rs").isEmpty()


def test_typescript_repository(spark, rows, tmp_path):
    graph = indexed(spark, tmp_path, TS_REPO)
    assert graph.entities.count() == 5
    assert rows(graph.dependencies("src/main.ts"), "path") == [("src/types.ts",), ("src/utils.ts",)]
    assert rows(graph.blast_radius("src/types.ts"), "path", "depth") == [
        ("src/index.ts", 2), ("src/main.ts", 1), ("src/utils.ts", 1)]
    assert [(r.path, r.edge_count) for r in graph.hotspots().collect()] == [
        ("src/main.ts", 3), ("src/types.ts", 2), ("src/utils.ts", 2), ("src/index.ts", 1), ("src/external.ts", 0)]
    assert [r.path for r in graph.hotspots(2).collect()] == ["src/main.ts", "src/types.ts"]


def test_mixed_repository_and_rebuild(spark, rows, tmp_path):
    first = indexed(spark, tmp_path, {"src/lib.rs": "pub fn hello() {}\n", "src/index.ts": "export const x = 1;\n"})
    assert rows(first.entities.where("kind = 'File'"), "path", "language") == [
        ("src/index.ts", "typescript"), ("src/lib.rs", "rust")]
    assert rows(first.entities.where("kind = 'Function'"), "name") == [("hello",)] and first.edges.isEmpty()
    files = spark.createDataFrame([("a.rs", "mod b;"), ("a/b.rs", "")], "path string, source string")
    again = CodeGraph.index(str(tmp_path / "graph"), files)
    assert rows(again.entities, "path") == [("a.rs",), ("a/b.rs",)] and again.edges.count() == 1


def test_index_with_history(spark, rows, tmp_path):
    sha = {"ann": "a" * 40, "bob": "b" * 40}
    log = "".join(
        f"COMMIT_START\n{i}\nAnn\nann@x\n{100 + i}\nmsg\n\nM\tsrc/a.rs\nM\tsrc/b.rs\n" for i in range(4)
    ) + "COMMIT_START\n9\nBob\nbob@x\n200\nmsg\n\nM\tsrc/a.rs\nM\tgone.md\n"
    head = lambda who, n: f"{sha[who]} {n} {n} 1\nauthor {who.title()}\nauthor-mail <{who}@x>\n\ttext\n"
    dumps = spark.createDataFrame(
        [("src/a.rs", head("ann", 1) + head("bob", 2) + f"{sha['ann']} 3 3\n\ttext\n{sha['ann']} 4 4\n\ttext\n"),
         ("gone.md", head("bob", 1))], "path string, dump string")
    (tmp_path / "log.txt").write_text(log)
    commits = commit_log.parse_commits(commit_log.read_commit_log(spark, str(tmp_path / "log.txt")))
    files = spark.createDataFrame([("src/a.rs", "fn a() {}"), ("src/b.rs", "")], "path string, source string")
    graph = CodeGraph.index(str(tmp_path / "graph"), files, commits, ownership.blamed_from_dumps(dumps))
    assert rows(graph.co_changes("src/a.rs"), "path", "confidence") == [("src/b.rs", 1.0)]
    assert graph.co_changes("src/b.rs").isEmpty()
    assert rows(graph.co_changes("src/b.rs", symmetric=True), "path") == [("src/a.rs",)]
    assert rows(graph.who_owns("src/a.rs"), "name", "path", "confidence") == [("Ann", "ann@x", 0.75), ("Bob", "bob@x", 0.25)]
    assert rows(graph.entities.where("kind = 'Person'"), "path") == [("ann@x",), ("bob@x",)]
    assert rows(graph.edges.select(F.size("evidence"), "evidence_count", "decay_half_life").distinct()) == [(0, 1, 180.0)]


def small_graph(spark):
    """Three files in a row, a co-change pair and an owner without a path."""
    entities = spark.createDataFrame(
        [("a", "File", "a.rs", "src/a.rs"), ("b", "File", "b.rs", "src/b.rs"), ("c", "File", "c.rs", "src/c.rs"),
         ("p", "Person", "dev@test.com", None)], "id string, kind string, name string, path string")
    entities = entities.withColumn("language", F.lit(None).cast("string"))
    edges = spark.createDataFrame(
        [("a", "b", "imports", 1.0), ("b", "c", "imports", None), ("a", "c", "co_changes_with", 0.8), ("a", "p", "owned_by", 0.9)],
        "from_id string, to_id string, kind string, confidence double")
    return CodeGraph(entities, edges)


def test_small_graph_queries(spark, rows):
    graph = small_graph(spark)
    assert rows(graph.blast_radius("src/a.rs", 3), "path", "depth") == [("src/b.rs", 1), ("src/c.rs", 2)]
    assert rows(graph.blast_radius("src/c.rs", 1), "path", "depth") == [("src/b.rs", 1)]
    assert graph.blast_radius("src/a.rs", 0).isEmpty()
    assert rows(graph.reachable("src/a.rs", 2), "path") == [("src/b.rs",), ("src/c.rs",)]
    assert rows(graph.reachable("src/a.rs", 1), "path") == [("src/b.rs",)]
    assert graph.reachable("src/c.rs", 5).isEmpty()
    assert rows(graph.co_changes("src/a.rs"), "path", "confidence") == [("src/c.rs", 0.8)]
    assert graph.co_changes("src/c.rs").isEmpty()
    assert rows(graph.who_owns("src/a.rs"), "name", "confidence") == [("dev@test.com", 0.9)]
    assert rows(graph.hotspots(10), "path", "edge_count") == [("src/a.rs", 3), ("src/b.rs", 2), ("src/c.rs", 2)]
    assert rows(graph.neighbors("src/a.rs"), "id") == [("b",), ("c",), ("p",)]
    assert rows(graph.find("src/b.rs"), "id") == [("b",)]
    kinds = neighbors.edges_of_kind(graph.find("src/b.rs"), graph.edges, graph.entities, "imports")
    shown = kinds.select(neighbors.display_key(), neighbors.confidence_text(F.col("confidence")))
    assert rows(shown) == [("src/c.rs", "1.00")]


def brute_reach(edges, start, limit, kinds):
    """Depth and discovering kind by plain breadth-first search."""
    order = {k: i for i, k in enumerate(kinds)}
    near = {}
    for a, b, kind in edges:
        if kind in order:
            near.setdefault(a, []).append((b, order[kind]))
            near.setdefault(b, []).append((a, order[kind] + len(kinds)))
    depth, rank, queue = {start: 0}, {}, deque([start])
    while queue:
        node = queue.popleft()
        if depth[node] == limit:
            continue
        for other, r in near.get(node, []):
            if other not in depth:
                depth[other] = depth[node] + 1
                queue.append(other)
            if depth[other] == depth[node] + 1:
                rank[other] = min(rank.get(other, 99), r)
    return {n: (d, kinds[rank[n] % len(kinds)]) for n, d in depth.items() if n != start}


@pytest.mark.parametrize("hub_edges, broadcast_rows", [(50_000, 100_000), (50_000, 0), (5, 0), (5, 40)])
def test_reach_with_hubs_equals_search(spark, hub_edges, broadcast_rows):
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(60)]
    kinds = list(blast.STRUCTURAL_KINDS) + ["owned_by"]
    edges = {(rng.choice(nodes), rng.choice(nodes), rng.choice(kinds)) for _ in range(70)}
    edges |= {("n0", n, "imports") for n in nodes[30:55]} | {(n, "n1", "calls") for n in nodes[5:25]}
    df = spark.createDataFrame(sorted(edges), "from_id string, to_id string, kind string")
    limits = {n: i % 5 for i, n in enumerate(nodes)}
    starts = spark.createDataFrame(list(limits.items()), "source string, max_depth int")
    got = {n: {} for n in nodes}
    for r in blast.reach(starts, df, hub_edges=hub_edges, broadcast_rows=broadcast_rows).select("source", "node", "depth", blast.rank_kind(F.col("rank")).alias("k")).collect():
        assert r.node not in got[r.source]
        got[r.source][r.node] = (r.depth, r.k)
    for n in nodes:
        assert got[n] == brute_reach(edges, n, limits[n], blast.STRUCTURAL_KINDS)


def test_table_checks(spark, rows, tmp_path):
    graph = small_graph(spark)
    bad = graph.edges.unionByName(spark.createDataFrame(
        [("a", "zz", "imports", 1.0), ("yy", "b", "calls", 1.0), ("yy", "zz", "calls", 1.0), ("a", "b", "likes", 1.0)],
        graph.edges.schema))
    assert tables.valid_edges(bad, graph.entities).count() == 4
    assert rows(tables.dangling_edges(bad, graph.entities), "from_id", "to_id", "missing") == [
        ("a", "zz", "to"), ("yy", "b", "from"), ("yy", "zz", "both")]
    tables.require_endpoints(graph.edges, graph.entities)
    with pytest.raises(ValueError, match="entity not found"):
        tables.require_endpoints(bad, graph.entities)
    writes = spark.createDataFrame([("a", "b", "imports", 0.1, 1), ("a", "b", "imports", 0.7, 3), ("a", "b", "imports", 0.9, 2),
                                    ("a", "b", "calls", 0.5, 1)], "from_id string, to_id string, kind string, confidence double, seq int")
    assert rows(tables.last_write_wins(writes, "seq")) == [("a", "b", "calls", 0.5), ("a", "b", "imports", 0.7)]
    raw = spark.createDataFrame([("1", "Struct", "x", '{"a": 1}'), ("2", "Widget", "y", "not json"), (None, "File", "z", "{}"),
                                 ("4", "File", "w", None)], "id string, kind string, name string, metadata string")
    assert rows(tables.lenient_entities(raw)) == [("1", "Struct", "x", '{"a": 1}'), ("2", "File", "y", "{}")]


def test_stored_edges_prune_by_kind(spark, tmp_path):
    graph = small_graph(spark)
    entities = graph.entities.withColumns({"metadata": F.lit("{}"), "last_indexed": F.current_timestamp()})
    tables.write_graph(entities, tables.new_edges(graph.edges), str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "edges").glob("kind=*")) == ["kind=co_changes_with", "kind=imports", "kind=owned_by"]
    plan = neighbors.structural(tables.read_edges(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [kind" in plan
    loaded = CodeGraph.load(spark, str(tmp_path))
    assert loaded.edges.count() == 4
    assert CodeGraph.load(spark, str(tmp_path), validate=False).edges.count() == 4
    plan = loaded.dependencies("src/a.rs")._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(from_id,a)" in plan or "EqualTo(from_id,a)" in plan
    assert [r.path for r in loaded.dependencies(["src/a.rs", "src/b.rs"]).orderBy("path").collect()] == ["src/b.rs", "src/c.rs"]


REQUESTS = [
    ("1", "blast_radius", "src/a.rs", None, None, None),
    ("2", "blast_radius", "src/a.rs", 1, None, None),
    ("3", "blast_radius", "none.rs", 99, None, None),
    ("4", "dependencies", "src/a.rs", None, None, None),
    ("5", "dependencies", "src/a.rs", None, "upstream", None),
    ("6", "dependencies", "none.rs", None, "sideways", None),
    ("7", "co_changes", "src/a.rs", None, None, None),
    ("8", "co_changes", "src/c.rs", None, None, None),
    ("9", "who_owns", "src/a.rs", None, None, None),
    ("10", "who_owns", "src/b.rs", None, None, None),
    ("11", "hotspots", None, None, None, 2),
    ("12", "hotspots", None, None, None, -1),
    ("13", "who_owns", None, None, None, None),
    ("14", "who_owns", "../x", None, None, None),
    ("15", "who_owns", "é" * 513, None, None, None),
    ("16", "explode", "src/a.rs", None, None, None),
    ("17", None, None, None, None, None),
    ("18", "hotspots", None, None, None, 0),
]
REQUEST_SCHEMA = "request_id string, tool string, entity string, depth long, direction string, limit long"
ANSWERS = {
    "1": [("ok", "src/b.rs", "imports", 1.0, None), ("ok", "src/c.rs", "imports", 2.0, None)],
    "2": [("ok", "src/b.rs", "imports", 1.0, None)],
    "3": [("empty", None, None, None, "No blast radius results for 'none.rs'")],
    "4": [("ok", "src/b.rs", "File", None, None)],
    "5": [("empty", None, None, None, "No upstream dependencies for 'src/a.rs'")],
    "6": [("empty", None, None, None, "Entity not found: none.rs")],
    "7": [("ok", "src/c.rs", None, 0.8, None)],
    "8": [("empty", None, None, None, "No co-change data for 'src/c.rs'")],
    "9": [("ok", "dev@test.com", None, 0.9, None)],
    "10": [("empty", None, None, None, "No ownership data for 'src/b.rs'")],
    "11": [("ok", "src/a.rs", None, 3.0, None), ("ok", "src/b.rs", None, 2.0, None)],
    "12": [("ok", "src/a.rs", None, 3.0, None), ("ok", "src/b.rs", None, 2.0, None), ("ok", "src/c.rs", None, 2.0, None)],
    "13": [("error", None, None, None, "missing required param: entity")],
    "14": [("error", None, None, None, "entity path must not contain '..'")],
    "15": [("error", None, None, None, "entity path too long (max 1024 chars)")],
    "16": [("error", None, None, None, "Unknown tool: explode")],
    "17": [("error", None, None, None, "Unknown tool: ")],
    "18": [("empty", None, None, None, "No hotspot data found. Run 'index' first.")],
}


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.request_id, []).append((r.status, r.result, r.detail, r.value, r.message))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_requests(spark):
    asked = spark.createDataFrame(REQUESTS, "request_id string, tool string, entity string, depth long, direction string, limit long")
    bounds = requests.Bounds(entity_bytes=1024)
    assert grouped(small_graph(spark).answer(asked, bounds)) == ANSWERS
    unbounded = grouped(small_graph(spark).answer(asked.where("request_id = '15'")))
    assert unbounded["15"][0][0] == "empty"


def test_bounds_answer_with_an_error_row(spark):
    asked = spark.createDataFrame(
        [("a", "blast_radius", "src/a.rs", 11, None, None), ("b", "hotspots", None, None, None, 501), ("c", "blast_radius", "src/a.rs", 10, None, None)],
        "request_id string, tool string, entity string, depth long, direction string, limit long",
    )
    got = grouped(small_graph(spark).answer(asked, requests.Bounds(depth=10, limit=500)))
    assert got["a"] == [("error", None, None, None, "depth too large (max 10)")]
    assert got["b"] == [("error", None, None, None, "limit too large (max 500)")]
    assert got["c"][0][0] == "ok"


def test_reach_and_hotspots_have_no_cap(spark):
    n = 26
    entities = spark.createDataFrame([(f"n{i}", "File", f"n{i}", f"n{i}.rs") for i in range(n)], "id string, kind string, name string, path string").withColumn("language", F.lit("rust"))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "imports", 1.0) for i in range(n - 1)], "from_id string, to_id string, kind string, confidence double")
    graph = CodeGraph(entities, edges)
    assert graph.blast_radius("n0.rs", 20).count() == 20
    assert graph.blast_radius("n0.rs", None).agg(F.max("depth")).first()[0] == n - 1
    assert graph.reachable("n3.rs", None).count() == n - 4
    many = spark.createDataFrame([("h", "hotspots", None, None, None, 5000), ("i", "hotspots", None, None, None, 7)], REQUEST_SCHEMA)
    wide = spark.range(4500).selectExpr("concat('m', id) AS id", "'File' AS kind", "concat('m', id) AS name", "concat('m', id) AS path", "'rust' AS language")
    got = requests.answer(many, wide, edges).groupBy("request_id").agg(F.count(F.lit(1)), F.countDistinct("rank"), F.max("rank")).collect()
    assert sorted(tuple(r) for r in got) == [("h", 4500, 4500, 4500), ("i", 7, 7, 7)]


def test_lookups_take_tables_of_paths(spark):
    graph = small_graph(spark)
    paths = spark.createDataFrame([("src/a.rs",), ("src/c.rs",), (None,)], "path string")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = graph.dependencies(paths)
    owners = graph.who_owns(paths)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert found.count() == graph.dependencies(["src/a.rs", "src/c.rs"]).count() > 0
    assert owners.count() == 1


def test_hub_join_is_split(spark):
    """A third of the edges at one node: the final adaptive plan splits them."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(300_000).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hub' ELSE concat('n', id) END AS from_id", "concat('n', id + 1) AS to_id", "'imports' AS kind", "1.0D AS confidence")
        files = spark.range(300_002).selectExpr("concat('n', id) AS path")
        wanted = spark.range(300_000).selectExpr("concat('n', id) AS id").union(spark.createDataFrame([("hub",)], "id string"))
        entities = wanted.selectExpr("id", "'File' AS kind", "id AS name", "id AS path")
        uses = spark.range(300_000).selectExpr("concat('p', id) AS path", "CASE WHEN id % 3 = 0 THEN 'crate::hub' ELSE concat('crate::n', id) END AS specifier")
        known = files.selectExpr("concat('src/', path, '.rs') AS path").union(spark.createDataFrame([("src/hub.rs",)], "path string"))
        for df in (neighbors.all_neighbors(wanted, edges, entities), resolve.crate_use_edges(uses, known)):
            df.write.format("noop").mode("overwrite").save()
            df.count()
            plan = df._jdf.queryExecution()
            rows = df.collect()
            text = plan.executedPlan().toString()
            assert "skew=true" in text, text[:3000]
            assert len(rows) > 200_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_request_lines(spark, tmp_path):
    def call(i, tool, **arguments):
        return json.dumps({"id": i, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})

    lines = [call(i, f"any_{tool}" if tool in requests.TOOLS else tool, entity=e, depth=d, direction=w, limit=n)
             for i, tool, e, d, w, n in REQUESTS if tool]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("\n".join(lines + ["", "   ", "{broken", '{"id": "big", "x": "' + "y" * (1 << 20) + '"}']))
    graph = small_graph(spark)
    bounds = requests.Bounds(entity_bytes=1024, request_bytes=1 << 20)
    stream = requests.decode_requests(spark.readStream.text(str(tmp_path / "in")), bounds)
    answer_stream(stream, graph.entities, graph.edges, str(tmp_path / "out"), str(tmp_path / "cp"), bounds=bounds).awaitTermination()
    got = grouped(spark.read.parquet(str(tmp_path / "out")))
    bad = got.pop(None)
    assert sorted(b[-1] for b in bad) == [requests.BAD_JSON, requests.TOO_LARGE]
    assert got == {k: v for k, v in ANSWERS.items() if k != "17"}


def test_report_document(spark, tmp_path):
    """The written parts, concatenated, are one JSON document that a plain search agrees with."""
    rng = random.Random(5)
    paths = ["crates/x/a.rs", "crates/x/b.rs", "src/c.ts", "top.rs", "src/sub/d.ts"] + [f"m{i % 3}/f{i}.rs" for i in range(30)]
    rows = [(p, "File", p.split("/")[-1], p) for p in paths]
    rows += [("u1", "Person", "Ann \"A\"", "ann@x"), ("u2", "Person", "Bob", "bob@x"), ("d", "Document", "d", None)]
    entities = spark.createDataFrame(rows, "id string, kind string, name string, path string")
    edges = {(rng.choice(paths), rng.choice(paths), rng.choice(["imports", "depends_on", "calls"])): 1.0 for _ in range(45)}
    edges |= {(rng.choice(paths), rng.choice(paths), "co_changes_with"): rng.choice([0.1, 0.25, 0.5, 0.66666, 1.0]) for _ in range(40)}
    edges |= {(p, rng.choice(["u1", "u2"]), "owned_by"): rng.random() for p in paths[:20]}
    edges |= {(paths[25], "ghost", "owned_by"): 0.4, (paths[0], "d", "imports"): 1.0}
    df = spark.createDataFrame([(*k, v) for k, v in edges.items()], "from_id string, to_id string, kind string, confidence double")
    Report.build(entities, df).write_json('re"po', str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    doc = json.loads(text)

    order = sorted(paths)
    at = {p: i for i, p in enumerate(order)}
    links = [(at[a], at[b]) for a, b, k in edges if k in ("imports", "depends_on") and b in at]
    pairs = {}
    for (a, b, k), c in edges.items():
        if k == "co_changes_with" and c >= 0.25:
            key = tuple(sorted((at[a], at[b])))
            pairs[key] = max(pairs.get(key, 0), c)
    assert doc["repo"] == 're"po'
    assert [n["path"] for n in doc["nodes"]] == order and [n["id"] for n in doc["nodes"]] == list(range(len(order)))
    assert sorted((s["source"], s["target"]) for s in doc["struct_links"]) == sorted(links)
    assert {tuple(sorted((c["source"], c["target"]))): c["confidence"] for c in doc["cochange_links"]} == {
        k: round(v, 3) for k, v in pairs.items()}
    near = {i: set() for i in range(len(order))}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in near:
        seen, edge = {i}, {i}
        for _ in range(3):
            edge = {m for n in edge for m in near[n]} - seen
            seen |= edge
        assert doc["blast"][str(i)] == sorted(seen - {i})
    degree = [0] * len(order)
    for a, b in links + [(at[a], at[b]) for (a, b, k), c in edges.items() if k == "co_changes_with" and c >= 0.25]:
        degree[a] += 1
        degree[b] += 1
    assert [n["degree"] for n in doc["nodes"]] == degree
    top = sorted(range(len(order)), key=lambda i: (-degree[i], order[i]))[:10]
    assert [h["id"] for h in doc["hotspots"]] == top
    best = {}
    for (p, who, k), c in edges.items():
        if k == "owned_by" and c > best.get(p, (-1,))[0]:
            best[p] = (c, {"u1": 'Ann "A"', "u2": "Bob"}.get(who, "unknown"))
    assert {n["path"]: n["owner"] for n in doc["nodes"]} == {p: best[p][1] if p in best else "unowned" for p in order}
    assert doc["crates"] == ["(root)", "m0", "m1", "m2", "src", "x"]
    assert sum(o["count"] for o in doc["owners"]) == len(best) and doc["owners"] == sorted(doc["owners"], key=lambda o: (-o["count"], o["name"]))
    assert doc["stats"] == {"files": len(order), "struct_edges": len(links), "cochange_edges": len(pairs),
                            "owners": len(doc["owners"]), "crates": 6}


def test_answers_are_described_before_requests_repeat_them(spark, monkeypatch):
    """Forty equal questions about a node with thirty edges: no table on the way holds a row for each answer."""
    entities = spark.createDataFrame(
        [(f"n{i}", "File", f"n{i}", f"n{i}", "rust") for i in range(31)], "id string, kind string, name string, path string, language string")
    edges = spark.createDataFrame(
        [("n0", f"n{i}", "imports", 1.0) for i in range(1, 31)] + [("n1", "gone", "imports", 1.0)],
        "from_id string, to_id string, kind string, confidence double")
    asked = spark.createDataFrame(
        [(f"{tool}{i}", tool, "n0", 1, None, 5) for tool in ("dependencies", "blast_radius") for i in range(40)]
        + [("far", "dependencies", "n30", None, "upstream", None), ("none", "co_changes", "n0", None, None, None),
           ("away", "dependencies", "n1", None, None, None)] + [(f"h{i}", "hotspots", None, None, None, 31) for i in range(20)],
        "request_id string, tool string, entity string, depth long, direction string, limit long")
    held = []
    keep = requests.stored

    def counted(df, name):
        out = keep(df, name)
        held.append((name, out.count()))
        return out

    monkeypatch.setattr(requests, "stored", counted)
    monkeypatch.setattr(requests, "TASK_ROWS", 100)
    got = requests.answer(asked, entities, edges)
    counts = {r[0]: (r[1], r[2]) for r in got.groupBy("request_id").agg(F.count(F.lit(1)), F.max("status")).collect()}
    assert counts == {
        **{f"{t}{i}": (30, "ok") for t in ("dependencies", "blast_radius") for i in range(40)},
        "far": (1, "ok"), "none": (1, "empty"), **{f"h{i}": (31, "ok") for i in range(20)},
    }
    assert max(n for _, n in held) <= asked.count(), held
    hot = got.where("tool = 'hotspots'").groupBy(F.spark_partition_id()).count()
    assert hot.count() >= 5


def test_rewritten_entities_are_sorted_whole(spark, tmp_path):
    rows = spark.range(400).repartition(8).selectExpr(
        "concat('n', id) AS id", "'File' AS kind", "concat('n', id) AS name", "concat('p', id) AS path", "'rust' AS language")
    loose = spark.createDataFrame([("n1", "n2", "imports", 1.0)], "from_id string, to_id string, kind string, confidence double")
    tables.write_graph(tables.new_entities(rows), tables.new_edges(loose), str(tmp_path))
    for file in (tmp_path / "entities").glob("*.parquet"):
        found = [r["path"] for r in spark.read.parquet(str(file)).collect()]
        assert found == sorted(found)
    assert spark.read.parquet(str(tmp_path / "entities")).count() == 400
