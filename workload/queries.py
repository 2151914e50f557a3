"""Every operator as a query over the testbed, next to plain SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphquarry.functions import paths
from graphquarry import CodeGraph
from graphquarry.operators import blast, cochange, extract, neighbors, ownership, resolve
from graphquarry.plans import index, report, requests
from graphquarry.plans.report import Report, blast_size, link_degree, symmetric_adjacency
from graphquarry.schemas import COCHANGE_REPORT_THRESHOLD, EDGE_KINDS, REPORT_LINK_KINDS, STRUCTURAL_KINDS
from graphquarry.session import checkpointed, scratch_path, stored
from graphquarry.sources import commit_log, source_tree, tables
from graphquarry.streaming.requests import answer_stream, answer_streams
from workload.testbed import VIEWS, Testbed, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _in(kinds: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


# Statements used by several oracles; they run in DuckDB only.
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(STRUCTURAL_KINDS)) + " END"
_KIND = "CASE rank % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(STRUCTURAL_KINDS)) + " END"

SQL_VIEWS = VIEWS | {
    "sql_writes": """
        SELECT concat('f:', l_partkey) AS from_id, concat('d:', l_suppkey) AS to_id,
               CASE l_returnflag WHEN 'A' THEN 'imports' ELSE 'calls' END AS kind, l_discount AS confidence,
               row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag
                                  ORDER BY l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS latest
        FROM lineitem WHERE l_returnflag <> 'N'""",
    "sql_degree": """
        SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM tb_edges UNION ALL SELECT to_id FROM tb_edges)
        GROUP BY id""",
    "sql_listed": "SELECT hash, path, row_number() OVER (PARTITION BY hash) AS i FROM tb_changes",
    "sql_pairs": """
        SELECT least(a.path, b.path) AS file_a, greatest(a.path, b.path) AS file_b, count(*) AS "count"
        FROM sql_listed a JOIN sql_listed b ON a.hash = b.hash AND a.i < b.i GROUP BY 1, 2""",
    "sql_scored": """
        SELECT file_a, file_b, "count", "count" / CAST((SELECT max("count") FROM sql_pairs) AS DOUBLE) AS confidence
        FROM sql_pairs""",
    "sql_together": """
        SELECT a.id AS from_id, b.id AS to_id, 'co_changes_with' AS kind, confidence
        FROM sql_scored JOIN tb_entities a ON a.path = file_a JOIN tb_entities b ON b.path = file_b""",
    "sql_counts": "SELECT path, author, email, count(*) AS line_count FROM tb_blame GROUP BY path, author, email",
    "sql_share": """
        SELECT path, author, email, line_count,
               line_count / CAST(sum(line_count) OVER (PARTITION BY path) AS DOUBLE) * 100.0 AS percentage
        FROM sql_counts""",
    "sql_owned": """
        SELECT f.id AS from_id, p.id AS to_id, 'owned_by' AS kind, percentage / 100.0 AS confidence
        FROM sql_share s JOIN tb_entities f ON s.path = f.path JOIN tb_entities p ON s.email = p.path""",
    "sql_graph": """
        SELECT * FROM tb_struct UNION ALL SELECT * FROM sql_together UNION ALL SELECT * FROM sql_owned""",
    "sql_adjacent": f"""
        SELECT from_id AS node, to_id AS next, {_RANK} AS rank FROM tb_edges WHERE kind IN {_in(STRUCTURAL_KINDS)}
        UNION ALL
        SELECT to_id, from_id, {_RANK} + 6 FROM tb_edges WHERE kind IN {_in(STRUCTURAL_KINDS)}""",
    "sql_b1": "SELECT node AS source, next AS node, min(rank) AS rank FROM sql_adjacent WHERE node <> next GROUP BY 1, 2",
    "sql_b2": """
        SELECT source, a.next AS node, min(a.rank) AS rank FROM sql_b1 JOIN sql_adjacent a USING (node)
        WHERE source <> a.next AND (source, a.next) NOT IN (SELECT (source, node) FROM sql_b1) GROUP BY 1, 2""",
    "sql_b3": """
        SELECT source, a.next AS node, min(a.rank) AS rank FROM sql_b2 JOIN sql_adjacent a USING (node)
        WHERE source <> a.next AND (source, a.next) NOT IN (SELECT (source, node) FROM sql_b1)
          AND (source, a.next) NOT IN (SELECT (source, node) FROM sql_b2) GROUP BY 1, 2""",
    "sql_reach": f"""
        SELECT source, node, 1 AS depth, {_KIND} AS edge_kind FROM sql_b1
        UNION ALL SELECT source, node, 2, {_KIND} FROM sql_b2
        UNION ALL SELECT source, node, 3, {_KIND} FROM sql_b3""",
    "sql_out": f"""
        SELECT id AS source, id AS node, 0 AS depth FROM tb_files
        UNION
        SELECT source, to_id, depth + 1 FROM sql_out JOIN tb_edges ON node = from_id
        WHERE depth < 3 AND kind IN {_in(STRUCTURAL_KINDS)}""",
    "sql_indexed": "SELECT row_number() OVER (ORDER BY path, id) - 1 AS idx, id, path, name AS label FROM tb_files",
    "sql_links": f"""
        SELECT kind, a.idx AS source, b.idx AS target, confidence
        FROM sql_graph JOIN sql_indexed a ON from_id = a.id JOIN sql_indexed b ON to_id = b.id
        WHERE kind IN {_in(REPORT_LINK_KINDS)} OR (kind = 'co_changes_with' AND confidence >= 0.25)""",
    "sql_pair_links": """
        SELECT arg_max(source, (confidence, -source)) AS source, arg_max(target, (confidence, -source)) AS target,
               round(max(confidence), 3) AS confidence
        FROM sql_links WHERE kind = 'co_changes_with' GROUP BY least(source, target), greatest(source, target)""",
    "sql_link_degree": """
        SELECT idx, count(*) AS degree
        FROM (SELECT source AS idx FROM sql_links UNION ALL SELECT target FROM sql_links) GROUP BY idx""",
    "sql_near": f"""
        SELECT source AS node, target AS next FROM sql_links WHERE kind IN {_in(REPORT_LINK_KINDS)}
        UNION ALL SELECT target, source FROM sql_links WHERE kind IN {_in(REPORT_LINK_KINDS)}""",
    "sql_spread": """
        SELECT idx AS source, idx AS node, 0 AS depth FROM sql_indexed
        UNION
        SELECT source, next, depth + 1 FROM sql_spread JOIN sql_near USING (node) WHERE depth < 3""",
    "sql_blast": """
        SELECT source, node, min(depth) AS depth FROM sql_spread GROUP BY source, node HAVING min(depth) > 0""",
    "sql_primary": """
        SELECT from_id AS id, arg_min(name, (-confidence, path)) AS owner, arg_min(path, (-confidence, path)) AS owner_email
        FROM sql_owned JOIN tb_entities ON id = to_id GROUP BY from_id""",
    "sql_owners": """
        SELECT row_number() OVER (ORDER BY files DESC, owner) - 1 AS owner_idx, owner, files
        FROM (SELECT owner, count(*) AS files FROM sql_primary GROUP BY owner)""",
    "sql_crate_of": """
        SELECT idx, CASE WHEN path LIKE 'crates/%' THEN split_part(path, '/', 2)
                         WHEN path NOT LIKE '%/%' THEN '(root)' ELSE split_part(path, '/', 1) END AS crate
        FROM sql_indexed""",
    "sql_crates": """
        SELECT row_number() OVER (ORDER BY crate) - 1 AS crate_idx, crate FROM (SELECT DISTINCT crate FROM sql_crate_of)""",
    "sql_nodes": """
        SELECT n.idx, label, path, crate, crate_idx, coalesce(owner, 'unowned') AS owner,
               coalesce(owner_email, '') AS owner_email, coalesce(owner_idx, -1) AS owner_idx, coalesce(degree, 0) AS degree
        FROM sql_indexed n JOIN sql_crate_of USING (idx) JOIN sql_crates USING (crate)
        LEFT JOIN sql_primary USING (id) LEFT JOIN sql_owners USING (owner) LEFT JOIN sql_link_degree USING (idx)""",
    "sql_checked": f"""
        SELECT request_id, tool, entity,
               CAST(coalesce(depth, 3) AS BIGINT) AS depth,
               coalesce(direction, 'downstream') AS direction,
               CAST(coalesce("limit", 20) AS BIGINT) AS "limit",
               CASE WHEN tool NOT IN {_in(requests.TOOLS)} THEN concat('Unknown tool: ', tool)
                    WHEN tool = 'hotspots' THEN NULL
                    WHEN entity IS NULL THEN 'missing required param: entity'
                    WHEN contains(entity, '..') THEN 'entity path must not contain ''..''' END AS error
        FROM tb_requests""",
    "sql_asked": """
        SELECT r.*, e.id FROM sql_checked r LEFT JOIN tb_entities e ON r.entity = e.path WHERE error IS NULL""",
    "sql_wave": f"""
        SELECT DISTINCT id AS source, id AS node, 0 AS depth FROM sql_asked WHERE tool = 'blast_radius' AND id IS NOT NULL
        UNION
        SELECT source, next, depth + 1 FROM sql_wave JOIN sql_adjacent USING (node)
        WHERE depth < (SELECT max(depth) FROM sql_asked WHERE tool = 'blast_radius')""",
    "sql_wave_depth": "SELECT source, node, min(depth) AS depth FROM sql_wave GROUP BY source, node HAVING min(depth) > 0",
    "sql_wave_kind": f"""
        SELECT b.source, b.node, b.depth, min(rank) AS rank
        FROM sql_wave_depth b
        JOIN (SELECT source, node, depth FROM sql_wave_depth UNION ALL SELECT DISTINCT source, source, 0 FROM sql_wave_depth) p
          ON p.source = b.source AND p.depth = b.depth - 1
        JOIN sql_adjacent a ON a.node = p.node AND a.next = b.node
        GROUP BY 1, 2, 3""",
    "sql_top": """
        SELECT coalesce(path, name) AS result, CAST(coalesce(n, 0) AS DOUBLE) AS value,
               row_number() OVER (ORDER BY coalesce(n, 0) DESC, path) AS rank
        FROM tb_entities LEFT JOIN (
            SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM sql_graph UNION ALL SELECT to_id FROM sql_graph)
            GROUP BY id) USING (id)
        WHERE kind = 'File'""",
    "sql_found": f"""
        SELECT request_id, tool, entity, direction, id, to_id AS far, CAST(NULL AS STRING) AS detail, confidence AS value
        FROM sql_asked LEFT JOIN sql_graph ON id = from_id AND kind = CASE tool WHEN 'co_changes' THEN 'co_changes_with' ELSE 'owned_by' END
        WHERE tool IN ('co_changes', 'who_owns')
        UNION ALL
        SELECT request_id, tool, entity, direction, id, to_id, NULL, NULL
        FROM sql_asked LEFT JOIN tb_struct ON id = from_id WHERE tool = 'dependencies' AND direction <> 'upstream'
        UNION ALL
        SELECT request_id, tool, entity, direction, id, from_id, NULL, NULL
        FROM sql_asked LEFT JOIN tb_struct ON id = to_id WHERE tool = 'dependencies' AND direction = 'upstream'
        UNION ALL
        SELECT request_id, tool, entity, direction, id, w.node, {_KIND}, CAST(w.depth AS DOUBLE)
        FROM sql_asked q LEFT JOIN sql_wave_kind w ON q.id = w.source AND w.depth <= q.depth WHERE tool = 'blast_radius'""",
    "sql_answers": """
        SELECT request_id, tool, CASE WHEN far IS NULL THEN 'empty' ELSE 'ok' END AS status,
               CASE WHEN tool = 'who_owns' THEN e.name ELSE coalesce(e.path, e.name) END AS result,
               CASE tool WHEN 'dependencies' THEN e.kind WHEN 'blast_radius' THEN detail END AS detail,
               round(value, 6) AS value, CAST(NULL AS INTEGER) AS rank,
               CASE WHEN far IS NOT NULL THEN NULL
                    WHEN tool = 'blast_radius' THEN concat('No blast radius results for ''', entity, '''')
                    WHEN tool = 'co_changes' THEN concat('No co-change data for ''', entity, '''')
                    WHEN tool = 'who_owns' THEN concat('No ownership data for ''', entity, '''')
                    WHEN f.id IS NULL THEN concat('Entity not found: ', entity)
                    ELSE concat('No ', direction, ' dependencies for ''', entity, '''') END AS message
        FROM sql_found f LEFT JOIN tb_entities e ON far = e.id
        UNION ALL
        SELECT request_id, tool, 'ok', result, NULL, value, CAST(rank AS INTEGER), NULL
        FROM sql_asked JOIN sql_top ON rank <= "limit" WHERE tool = 'hotspots'
        UNION ALL
        SELECT request_id, tool, 'error', NULL, NULL, NULL, NULL, error FROM sql_checked WHERE error IS NOT NULL""",
}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states its result."""
    def register(build: Callable[[Testbed], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[build.__name__] = with_views(sql, SQL_VIEWS)
        return build
    return register


# --- Graph tables ---------------------------------------------------------------------------


@query(f"""
    SELECT from_id, to_id, kind, confidence FROM tb_raw_edges
    WHERE kind IN {_in(EDGE_KINDS)} AND from_id IN (SELECT id FROM tb_entities) AND to_id IN (SELECT id FROM tb_entities)""")
def valid_edges(t: Testbed) -> DataFrame:
    return tables.valid_edges(t.raw_edges, t.entities)


@query("""
    SELECT r.from_id, r.to_id, r.kind, confidence, 'to' AS missing FROM tb_raw_edges r
    WHERE to_id NOT IN (SELECT id FROM tb_entities)""")
def dangling_edges(t: Testbed) -> DataFrame:
    return tables.dangling_edges(t.raw_edges, t.entities)


@query("""
    SELECT concat(CASE WHEN l_returnflag = 'A' THEN 'x:' ELSE 'f:' END, l_partkey) AS from_id,
           concat(CASE WHEN l_returnflag = 'N' THEN 'f:' ELSE 'x:' END, l_partkey) AS to_id, 'imports' AS kind,
           CASE l_returnflag WHEN 'A' THEN 'both' ELSE 'to' END AS missing, count(*) AS n
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL
    UNION ALL
    SELECT concat('x:', l_partkey), concat('f:', l_partkey), 'calls', 'from', count(*) FROM lineitem GROUP BY ALL""")
def dangling_edges_each_end(t: Testbed) -> DataFrame:
    """Edges that miss their start, their end, or both."""
    edges = t.sql("""
        SELECT concat(CASE WHEN l_returnflag = 'A' THEN 'x:' ELSE 'f:' END, l_partkey) AS from_id,
               concat(CASE WHEN l_returnflag = 'N' THEN 'f:' ELSE 'x:' END, l_partkey) AS to_id, 'imports' AS kind FROM lineitem
        UNION ALL SELECT concat('x:', l_partkey), concat('f:', l_partkey), 'calls' FROM lineitem""")
    found = tables.dangling_edges(edges, t.entities)
    return found.groupBy("from_id", "to_id", "kind", "missing").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT from_id, to_id, kind, confidence FROM (
        SELECT concat('f:', l_partkey) AS from_id, concat('d:', l_suppkey) AS to_id,
               CASE l_returnflag WHEN 'A' THEN 'imports' WHEN 'R' THEN 'calls' ELSE 'depends_on' END AS kind,
               l_discount AS confidence,
               row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag
                                  ORDER BY l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS latest
        FROM lineitem) WHERE latest = 1""")
def edge_upsert_last_wins(t: Testbed) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "imports").when(F.col("l_returnflag") == "R", "calls").otherwise("depends_on")
    writes = t.table("lineitem").select(
        F.concat(F.lit("f:"), "l_partkey").alias("from_id"), F.concat(F.lit("d:"), "l_suppkey").alias("to_id"),
        kind.alias("kind"), F.col("l_discount").alias("confidence"), "l_orderkey", "l_linenumber",
    )
    return tables.last_write_wins(writes, "l_orderkey", "l_linenumber")


@query("""
    SELECT from_id, to_id, kind, confidence FROM sql_writes WHERE latest = 1
    UNION ALL SELECT from_id, to_id, kind, confidence FROM tb_edges e
    WHERE NOT EXISTS (SELECT 1 FROM sql_writes w WHERE w.from_id = e.from_id AND w.to_id = e.to_id AND w.kind = e.kind)""")
def edge_upsert_stored(t: Testbed) -> DataFrame:
    """Writes merged into a stored edge table, of which only the kinds written to are rewritten."""
    root = scratch_path(t.spark, "upsert-graph")
    tables.write_graph(tables.new_entities(t.entities), tables.new_edges(t.edges), root)
    kind = F.when(F.col("l_returnflag") == "A", "imports").otherwise("calls")
    writes = t.table("lineitem").where("l_returnflag <> 'N'").select(
        F.concat(F.lit("f:"), "l_partkey").alias("from_id"), F.concat(F.lit("d:"), "l_suppkey").alias("to_id"),
        kind.alias("kind"), F.col("l_discount").alias("confidence"), "l_orderkey", "l_linenumber",
    )
    tables.upsert_edges(t.spark, root, writes, "l_orderkey", "l_linenumber")
    return tables.read_edges(t.spark, root).select("from_id", "to_id", "kind", "confidence")


@query("""
    SELECT sha256(concat('=', kind, '|', CASE WHEN path IS NULL THEN '-' ELSE concat('=', path) END, '|=', name, '|0')) AS id, kind, name, path, language,
           '{}' AS metadata FROM tb_entities""")
def new_entities(t: Testbed) -> DataFrame:
    return tables.new_entities(t.entities).drop("last_indexed")


@query("""
    SELECT sha256(concat('=Function|=', path, '::', name, '|=', name, '|',
                         row_number() OVER (PARTITION BY path, name ORDER BY line) - 1)) AS id, path, name, line
    FROM (SELECT path, l_returnflag AS name, l_orderkey * 8 + l_linenumber AS line FROM lineitem JOIN tb_files ON l_partkey = k)""")
def repeated_item_entities(t: Testbed) -> DataFrame:
    """One entity for each item, also where a file repeats a name."""
    items = t.sql("SELECT path, 'Function' AS kind, l_returnflag AS name, l_orderkey * 8 + l_linenumber AS line "
                  "FROM lineitem JOIN tb_files ON l_partkey = k")
    rows = extract.item_entities(items)
    file = F.regexp_extract("path", "^(.*)::", 1)
    return tables.new_entities(rows, "line").select("id", file.alias("path"), "name", "line")


@query("""
    SELECT from_id, to_id, kind, confidence, CAST(1 AS INTEGER) AS evidence_count,
           CAST(180.0 AS DOUBLE) AS decay_half_life, 0 AS evidence
    FROM tb_edges""")
def new_edges(t: Testbed) -> DataFrame:
    return tables.new_edges(t.edges).withColumn("evidence", F.size("evidence")).drop("last_evidence")


def _raw_entities(t: Testbed) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Function").when(F.col("event_type") == "click", "Module").otherwise(
        F.col("event_type"))
    return t.table("events").select(
        F.col("event_id").cast("string").alias("id"), kind.alias("kind"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("name"),
        F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("language"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("metadata"),
    )


@query("""
    SELECT CAST(event_id AS STRING) AS id,
           CASE event_type WHEN 'view' THEN 'Function' WHEN 'click' THEN 'Module' ELSE 'File' END AS kind,
           event_type AS name, CAST(user_id AS STRING) AS path, CAST(NULL AS STRING) AS language,
           CASE event_type WHEN 'error' THEN '{}' ELSE props END AS metadata
    FROM events WHERE event_type <> 'signup'""")
def lenient_entity_load(t: Testbed) -> DataFrame:
    return tables.lenient_entities(_raw_entities(t))


@query("SELECT DISTINCT c.path, e.id, e.kind, e.name, e.language FROM tb_changes c JOIN tb_entities e ON c.path = e.path")
def find_by_path(t: Testbed) -> DataFrame:
    return resolve.find_by_path(t.changes, t.entities)


# --- Scan and extraction --------------------------------------------------------------------

_SKIP = "(^|/)(target|node_modules|dist|[.]next|build)/"


@query(f"""
    SELECT path FROM tb_tree WHERE regexp_matches(path, '[.](rs|ts|tsx)$') AND path NOT LIKE '%.d.ts'
      AND NOT regexp_matches(path, '{_SKIP}')""")
def scan_filter(t: Testbed) -> DataFrame:
    return source_tree.scannable(t.tree)


@query(f"""
    SELECT path, split_part(path, '/', -1) AS name,
           CASE WHEN path LIKE '%.rs' THEN 'rust' ELSE 'typescript' END AS language
    FROM tb_tree WHERE regexp_matches(path, '[.](rs|ts|tsx)$') AND path NOT LIKE '%.d.ts'
      AND NOT regexp_matches(path, '{_SKIP}')""")
def file_registration(t: Testbed) -> DataFrame:
    return extract.file_registration(t.tree)


@query("SELECT language, count(*) AS files FROM tb_files GROUP BY language")
def language_counts(t: Testbed) -> DataFrame:
    return extract.language_counts(extract.file_registration(t.files))


_ITEMS = """
    SELECT path, 'Struct' AS kind, concat('Item', d) AS name, breaks + 9 AS line FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Trait', concat('Load', d), breaks + 10 FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Impl', concat('Load', d), breaks + 11 FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Function', concat('run_', d), breaks + 12 FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Impl', concat('Item', d), breaks + 14 FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Function', concat('deep_', d), breaks + 15 FROM tb_texts WHERE lang = 'en'"""


@query(f"SELECT path, kind, name, CAST(line AS INTEGER) AS line FROM ({_ITEMS})")
def rust_items(t: Testbed) -> DataFrame:
    return extract.rust_items(t.sources)


@query(f"SELECT path, name, CAST(line AS INTEGER) AS line FROM ({_ITEMS}) WHERE kind = 'Impl'")
def rust_impl_names(t: Testbed) -> DataFrame:
    return extract.rust_items(t.sources).where("kind = 'Impl'").drop("kind")


@query("""
    SELECT path, 0 AS pos, concat('crate::d', d + 1, '::load') AS specifier FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 1, concat('crate::d', n_chars) FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 2, 'pub use std::fmt' FROM tb_texts WHERE lang = 'en'""")
def rust_use(t: Testbed) -> DataFrame:
    return extract.rust_uses(t.sources)


@query("""
    SELECT path, 0 AS pos, 'sub' AS name FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 1, concat('extra_', d) FROM tb_texts WHERE lang = 'en'""")
def rust_mod(t: Testbed) -> DataFrame:
    return extract.rust_mods(t.sources)


@query("""
    SELECT a.path, 0 AS pos, concat('./d', a.d + 1, '.js') AS specifier FROM tb_texts a WHERE a.lang <> 'en'
    UNION ALL SELECT a.path, 1, concat('../../', coalesce(b.dir, 'none'), '/d', a.d + 1)
        FROM tb_texts a LEFT JOIN tb_texts b ON b.d = a.d + 1 WHERE a.lang <> 'en'
    UNION ALL SELECT a.path, 2, './index' FROM tb_texts a WHERE a.lang <> 'en'
    UNION ALL SELECT a.path, 3, 'lodash' FROM tb_texts a WHERE a.lang <> 'en'
    UNION ALL SELECT a.path, 4, 'node:fs' FROM tb_texts a WHERE a.lang <> 'en'""")
def ts_specifiers(t: Testbed) -> DataFrame:
    return extract.ts_specifiers(t.sources)


@query("""
    SELECT path, 0 AS pos, concat('./c', d) AS specifier FROM tb_texts WHERE lang <> 'en'
    UNION ALL SELECT path, 1, concat('./e', d) FROM tb_texts WHERE lang <> 'en'
    UNION ALL SELECT path, 2, concat('./g', d) FROM tb_texts WHERE lang <> 'en'
    UNION ALL SELECT path, 3, concat('h', d) FROM tb_texts WHERE lang <> 'en'""")
def ts_specifiers_states(t: Testbed) -> DataFrame:
    return extract.ts_specifiers(t.hard_sources)


@query("""
    SELECT path, 'Function' AS kind, concat('seen_', d) AS name, CAST(3 + breaks AS INTEGER) AS line FROM tb_texts WHERE lang = 'en'
    UNION ALL SELECT path, 'Impl', concat('Inner', d), CAST(4 + breaks AS INTEGER) FROM tb_texts WHERE lang = 'en'""")
def rust_items_nested(t: Testbed) -> DataFrame:
    return extract.rust_items(t.hard_sources)


_MOD_EDGES = """
    SELECT path AS from_path, concat(dir, '/d', d, CASE WHEN quality = 1 THEN '/sub.rs' ELSE '/sub/mod.rs' END) AS to_path,
           'imports' AS kind, CAST(1.0 AS DOUBLE) AS confidence
    FROM tb_texts JOIN labels ON d = doc_id WHERE lang = 'en' AND (quality = 1 OR toxic = 1)"""
_USE_EDGES = """
    SELECT DISTINCT a.path AS from_path, b.path AS to_path, 'depends_on' AS kind, CAST(1.0 AS DOUBLE) AS confidence
    FROM tb_texts a JOIN tb_texts b ON b.d = a.d + 1 OR b.d = a.n_chars
    WHERE a.lang = 'en' AND b.lang = 'en' AND b.dir = 'src'"""
_SAME_DIR = """
    SELECT DISTINCT a.path AS from_path, f.path AS to_path, 'imports' AS kind, CAST(1.0 AS DOUBLE) AS confidence
    FROM tb_texts a JOIN tb_code_files f
      ON f.path IN (concat(a.dir, '/d', a.d + 1, '.ts'), concat(a.dir, '/d', a.d + 1, '.tsx'), concat(a.dir, '/index.ts'))
    WHERE a.lang <> 'en'"""
# '../../<dir of the next text>' reaches the next text from a two-level directory.
_TS_EDGES = f"""{_SAME_DIR}
    UNION
    SELECT a.path, b.path, 'imports', CAST(1.0 AS DOUBLE) FROM tb_texts a JOIN tb_texts b ON b.d = a.d + 1
    WHERE a.lang <> 'en' AND b.lang <> 'en' AND a.dir LIKE '%/%'"""


@query(_MOD_EDGES)
def resolve_mod(t: Testbed) -> DataFrame:
    return resolve.mod_edges(extract.rust_mods(t.sources), t.code_files)


@query(_USE_EDGES)
def resolve_crate_use(t: Testbed) -> DataFrame:
    return resolve.crate_use_edges(extract.rust_uses(t.sources), t.code_files)


@query(_TS_EDGES)
def resolve_ts_normalized(t: Testbed) -> DataFrame:
    return resolve.ts_edges(extract.ts_specifiers(t.sources), t.code_files)


@query(_SAME_DIR)
def resolve_ts_literal(t: Testbed) -> DataFrame:
    return resolve.ts_edges(extract.ts_specifiers(t.sources), t.code_files, "literal")


def _index_input(t: Testbed) -> DataFrame:
    """All source texts plus the empty files they refer to."""
    return t.code_files.join(t.sources, "path", "left").select("path", F.coalesce("source", F.lit("")).alias("source"))


@query(f"""
    SELECT kind, name, concat(path, '::', name) AS path, 'rust' AS language FROM ({_ITEMS})
    UNION ALL
    SELECT 'File', split_part(path, '/', -1), path, CASE WHEN path LIKE '%.rs' THEN 'rust' ELSE 'typescript' END
    FROM tb_code_files""")
def index_entities(t: Testbed) -> DataFrame:
    return index.structure(_index_input(t))[0].drop("line")


def _file_sha(path: str) -> str:
    return f"sha256(concat('=File|=', {path}, '|=', split_part({path}, '/', -1), '|0'))"


@query(f"""
    SELECT {_file_sha('from_path')} AS from_id, {_file_sha('to_path')} AS to_id, kind, confidence
    FROM ({_MOD_EDGES} UNION ALL {_USE_EDGES} UNION ALL ({_TS_EDGES}))""")
def index_edges(t: Testbed) -> DataFrame:
    return index.structure(_index_input(t))[1]


# --- History --------------------------------------------------------------------------------


@query("""
    SELECT hash, author, email, CASE message WHEN '5-LOW' THEN 0 ELSE custkey END AS "timestamp", message, x.path, x.kind
    FROM tb_commits JOIN (
        SELECT hash, path, CASE status WHEN 'A' THEN 'Added' ELSE 'Modified' END AS kind FROM tb_changes
        UNION ALL SELECT hash, concat('gone/', path), 'Deleted' FROM tb_changes
        UNION ALL SELECT hash, concat('copy/', path), 'Modified' FROM tb_changes) x USING (hash)""")
def commit_log_roundtrip(t: Testbed) -> DataFrame:
    commits = commit_log.parse_commits(t.log)
    return commits.select("hash", "author", "email", "timestamp", "message", F.explode("files_changed").alias("c")).select(
        "hash", "author", "email", "timestamp", "message", "c.path", "c.kind")


@query("""
    SELECT CASE WHEN status LIKE 'A%' THEN 'Added' ELSE 'Modified' END AS kind, path, count(*) AS changes
    FROM tb_changes GROUP BY 1, 2""")
def change_status(t: Testbed) -> DataFrame:
    kinds = t.changes.select(commit_log.change_kind(F.col("status")).alias("kind"), "path")
    return kinds.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("changes"))


@query("""
    SELECT hash, author, email, CAST(epoch(ts) AS BIGINT) AS "timestamp", message FROM tb_commits""")
def newest_commits(t: Testbed) -> DataFrame:
    return commit_log.newest_commits(_dated_commits(t))


@query("""
    SELECT hash, author, email, CAST(epoch(ts) AS BIGINT) AS "timestamp", message FROM tb_commits
    ORDER BY "timestamp" DESC, hash LIMIT 700""")
def commits_limited(t: Testbed) -> DataFrame:
    return commit_log.newest_commits(_dated_commits(t), 700)


def _dated_commits(t: Testbed) -> DataFrame:
    # Order times carry no zone; counting days and clock time keeps the session's zone out.
    seconds = F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.commits.select("hash", "author", "email", seconds.alias("timestamp"), "message")


@query("SELECT * FROM sql_pairs")
def cochange_pairs(t: Testbed) -> DataFrame:
    return cochange.cochange_pairs(t.changes)


@query("SELECT * FROM sql_pairs")
def cochange_pairs_blocks(t: Testbed) -> DataFrame:
    """The same pairs with commits of more than four paths cut into blocks."""
    return cochange.cochange_pairs(t.changes, block_files=4)


def _scored(t: Testbed) -> DataFrame:
    return cochange.cochange_confidence(checkpointed(cochange.cochange_pairs(t.changes)))


def _together(t: Testbed, changes: DataFrame | None = None) -> DataFrame:
    """Co-change edges from pairs of numbered paths."""
    changes = stored(t.changes.select("hash", "path"), "changes") if changes is None else changes
    codes = cochange.path_codes(changes)
    # not stored: the greatest count and the first join read the same shuffle, by the pairs' first file
    scored = cochange.cochange_confidence(cochange.cochange_pairs(changes, codes=codes))
    return cochange.cochange_edges(scored, t.entities, codes)


@query("SELECT * FROM sql_scored")
def cochange_confidence(t: Testbed) -> DataFrame:
    return cochange.ranked_cochanges(_scored(t))


@query("SELECT * FROM sql_together")
def cochange_edges(t: Testbed) -> DataFrame:
    return _together(t)


@query("SELECT path, author, email, line_count, round(percentage, 6) AS percentage FROM sql_share")
def ownership_share(t: Testbed) -> DataFrame:
    shares = ownership.ownership_share(ownership.line_counts(t.blame))
    return shares.withColumn("percentage", F.round("percentage", 6))


@query("""
    SELECT path, author, email, line_count,
           row_number() OVER (PARTITION BY path ORDER BY line_count DESC, email, author) AS rank
    FROM sql_share""")
def ownership_ranked(t: Testbed) -> DataFrame:
    shares = ownership.ownership_share(ownership.line_counts(t.blame))
    return ownership.ranked_owners(shares).drop("percentage")


@query("SELECT DISTINCT 'Person' AS kind, author AS name, email AS path, CAST(NULL AS STRING) AS language FROM tb_blame")
def person_table(t: Testbed) -> DataFrame:
    return ownership.persons(ownership.line_counts(t.blame), t.entities.where("kind = 'File'"))


@query("SELECT from_id, to_id, kind, round(confidence, 6) AS confidence FROM sql_owned")
def ownership_edges(t: Testbed) -> DataFrame:
    return _owned(t).withColumn("confidence", F.round("confidence", 6))


# Lines of a nation's customers under one mail address each, so that names share an address.
_BY_SEGMENT = """
    SELECT f.path, c_name AS author, concat('c', c_nationkey, '@example.com') AS email
    FROM lineitem JOIN tb_files f ON l_partkey = k JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


@query(f"""
    SELECT 'f:' || k AS from_id, 'p:' || e AS to_id, 'owned_by' AS kind, round(min(n / CAST(total AS DOUBLE)), 6) AS confidence
    FROM (SELECT path, author, email, count(*) AS n, substr(split_part(email, '@', 1), 2) AS e,
                 sum(count(*)) OVER (PARTITION BY path) AS total
          FROM ({_BY_SEGMENT}) GROUP BY path, author, email)
    JOIN tb_files USING (path) JOIN customer ON c_custkey = CAST(e AS BIGINT)
    GROUP BY 1, 2""")
def ownership_edges_last(t: Testbed) -> DataFrame:
    shares = ownership.ownership_share(ownership.line_counts(t.sql(_BY_SEGMENT)))
    return ownership.ownership_edges(shares, t.entities, "last").withColumn("confidence", F.round("confidence", 6))


@query("SELECT path, author, email, count(*) AS line_count FROM tb_hunks GROUP BY path, author, email")
def blame_dumps(t: Testbed) -> DataFrame:
    return ownership.blamed_from_dumps(t.held_hunks("tb_dumps"))


@query("SELECT path, author, email, count(*) AS line_count FROM tb_hunks GROUP BY path, author, email")
def blame_by_commit(t: Testbed) -> DataFrame:
    return ownership.blamed_lines(t.held_hunks("tb_blame_lines"))


@query("""
    SELECT path, author, email, count(*) AS line_count FROM (
        SELECT h.path, f.author, f.email FROM tb_hunks h ASOF JOIN tb_first_hunks f ON h.path = f.path AND h.pos >= f.pos)
    GROUP BY path, author, email""")
def blame_carry_forward(t: Testbed) -> DataFrame:
    return ownership.blamed_lines(t.held_hunks("tb_blame_lines"), "carry_forward")


def _owned(t: Testbed, counts: DataFrame | None = None) -> DataFrame:
    return ownership.ownership_edges(ownership.ownership_share(ownership.line_counts(t.blame) if counts is None else counts), t.entities)


def _graph(t: Testbed) -> DataFrame:
    """Structural, co-change and ownership edges together."""
    lines = t.held_lines()
    counts = ownership.line_counts(lines["blame"], sized=lines["sized"])
    return stored(lines["struct"].unionByName(_together(t, lines["changes"])).unionByName(_owned(t, counts)), "graph")


# --- Graph queries --------------------------------------------------------------------------


@query("""
    SELECT name, path, coalesce(n, 0) AS edge_count FROM tb_entities LEFT JOIN sql_degree USING (id)
    WHERE kind = 'File' ORDER BY edge_count DESC, path LIMIT 20""")
def hotspots_topk(t: Testbed) -> DataFrame:
    return neighbors.hotspots(t.entities, t.edges, 20)


@query("SELECT id, kind, path, coalesce(n, 0) AS edge_count FROM tb_entities LEFT JOIN sql_degree USING (id)")
def edge_degree(t: Testbed) -> DataFrame:
    return neighbors.entity_degree(t.entities, t.edges).select("id", "kind", "path", "edge_count")


def _hop_sql(near: str, far: str, where: str) -> str:
    return f"""
        SELECT {near} AS source_id, e.id, x.kind AS edge_kind, e.kind, e.name, e.path
        FROM tb_edges x JOIN tb_entities e ON {far} = e.id WHERE {where}"""


@query(_hop_sql("from_id", "to_id", f"x.kind IN {_in(STRUCTURAL_KINDS)}"))
def deps_downstream(t: Testbed) -> DataFrame:
    return neighbors.dependencies(t.entities, t.edges, t.entities)


@query(_hop_sql("to_id", "from_id", f"x.kind IN {_in(STRUCTURAL_KINDS)}"))
def deps_upstream(t: Testbed) -> DataFrame:
    return neighbors.dependencies(t.entities, t.edges, t.entities, "upstream")


@query(_hop_sql("to_id", "from_id", "true"))
def all_neighbors(t: Testbed) -> DataFrame:
    return neighbors.all_neighbors(t.entities, t.edges, t.entities, "upstream")


@query(_hop_sql("from_id", "to_id", "true"))
def all_neighbors_downstream(t: Testbed) -> DataFrame:
    return neighbors.all_neighbors(t.entities, t.edges, t.entities)


@query("""
    SELECT from_id AS source_id, coalesce(e.path, e.name) AS shown, printf('%.2f', coalesce(confidence, 1.0)) AS confidence
    FROM tb_edges x JOIN tb_entities e ON to_id = e.id WHERE x.kind = 'documented_in'""")
def display_columns(t: Testbed) -> DataFrame:
    """What a listing shows of each neighbour."""
    found = neighbors.edges_of_kind(t.entities, t.edges, t.entities, "documented_in")
    return found.select("source_id", neighbors.display_key().alias("shown"), neighbors.confidence_text(F.col("confidence")).alias("confidence"))


@query("""
    SELECT from_id AS source_id, e.id, x.kind AS edge_kind, coalesce(confidence, 1.0) AS confidence, e.kind, e.name, e.path
    FROM tb_edges x JOIN tb_entities e ON to_id = e.id WHERE x.kind = 'documented_in'""")
def edges_of_kind(t: Testbed) -> DataFrame:
    return neighbors.edges_of_kind(t.entities, t.edges, t.entities, "documented_in")


@query("SELECT from_id AS source_id, e.path, confidence FROM sql_together JOIN tb_entities e ON to_id = e.id")
def co_changes_of(t: Testbed) -> DataFrame:
    edges = _together(t)
    return neighbors.co_changes(t.entities, edges, t.entities).select("source_id", "path", "confidence")


@query("""
    SELECT from_id AS source_id, e.path, confidence FROM sql_together JOIN tb_entities e ON to_id = e.id
    UNION ALL SELECT to_id, e.path, confidence FROM sql_together JOIN tb_entities e ON from_id = e.id""")
def co_changes_symmetric(t: Testbed) -> DataFrame:
    edges = stored(_together(t), "together")
    return neighbors.co_changes(t.entities, edges, t.entities, True).select("source_id", "path", "confidence")


@query("SELECT from_id AS source_id, e.name, round(confidence, 6) AS confidence FROM sql_owned JOIN tb_entities e ON to_id = e.id")
def who_owns(t: Testbed) -> DataFrame:
    found = neighbors.owners(t.entities, _owned(t), t.entities)
    return found.select("source_id", "name", F.round("confidence", 6).alias("confidence"))


@query("SELECT source, node, min(depth) AS depth FROM sql_out GROUP BY source, node HAVING min(depth) > 0")
def blast_out(t: Testbed) -> DataFrame:
    starts = t.files.select(F.col("id").alias("source"), F.lit(3).alias("max_depth"))
    return blast.reach(starts, checkpointed(t.edges), "out").select("source", "node", "depth")


def _chained(t: Testbed) -> DataFrame:
    """Parts in chains of sixteen."""
    return t.table("part").where("p_partkey % 16 <> 15").selectExpr(
        "concat('f:', p_partkey) AS from_id", "concat('f:', p_partkey + 1) AS to_id", "'imports' AS kind", "1.0D AS confidence")


@query("""
    SELECT concat('f:', a.p_partkey) AS source, concat('f:', a.p_partkey + d) AS node, CAST(d AS INTEGER) AS depth
    FROM (SELECT p_partkey, unnest(range(1, 16)) AS d FROM part) a WHERE a.p_partkey % 16 + d <= 15
    AND a.p_partkey + d <= (SELECT max(p_partkey) FROM part) + 1""")
def blast_deep(t: Testbed) -> DataFrame:
    """Unbounded outgoing reach along chains longer than ten hops."""
    starts = t.table("part").selectExpr("concat('f:', p_partkey) AS source", "CAST(NULL AS INT) AS max_depth")
    return blast.reach(starts, _chained(t), "out").select("source", "node", "depth")


@query("""
    SELECT concat('f:', a.p_partkey) AS source, concat('f:', a.p_partkey - d) AS node, CAST(d AS INTEGER) AS depth
    FROM (SELECT p_partkey, unnest(range(1, 13)) AS d FROM part) a WHERE a.p_partkey % 16 >= d
    AND a.p_partkey - d >= (SELECT min(p_partkey) FROM part)""")
def blast_in(t: Testbed) -> DataFrame:
    """Incoming reach, twelve hops deep."""
    starts = t.table("part").selectExpr("concat('f:', p_partkey) AS source", "12 AS max_depth")
    return blast.reach(starts, _chained(t), "in").select("source", "node", "depth")


@query(f"""
    SELECT from_id, to_id, kind, confidence, (SELECT count(*) FROM tb_entities) AS n_entities FROM tb_raw_edges
    WHERE kind IN {_in(EDGE_KINDS)} AND from_id IN (SELECT id FROM tb_entities) AND to_id IN (SELECT id FROM tb_entities)""")
def rebuilt_graph(t: Testbed) -> DataFrame:
    """The stored graph replaced by one derived from itself, opened and validated."""
    root = scratch_path(t.spark, "rebuilt")
    entities = t.entities.withColumns({"metadata": F.lit("{}"), "last_indexed": F.current_timestamp()})
    raw = stored(t.raw_edges, "raw-edges")  # both graphs are made of them
    tables.write_graph(entities, tables.new_edges(raw.where("kind <> 'imports'")), root)
    tables.write_graph(tables.read_entities(t.spark, root), tables.new_edges(raw), root)
    graph = CodeGraph.load(t.spark, root)
    total = graph.all_entities().agg(F.count(F.lit(1)).alias("n_entities")).scalar()
    return graph.edges.select("from_id", "to_id", "kind", "confidence", total.alias("n_entities"))


@query("""
    SELECT s.path AS source_path, e.id, e.kind, e.name, e.path, r.depth, r.edge_kind
    FROM sql_reach r JOIN tb_entities s ON source = s.id JOIN tb_entities e ON node = e.id""")
def blast_undirected_depth_kind(t: Testbed) -> DataFrame:
    return blast.blast_radius(t.files.select("path"), checkpointed(t.edges), t.entities, 3)


# --- Report ---------------------------------------------------------------------------------


def _report(t: Testbed) -> Report:
    return Report.build(t.entities, _graph(t))


def _report_links(t: Testbed) -> tuple[DataFrame, DataFrame]:
    files = report.file_table(t.entities)
    return files, stored(report.indexed_links(_graph(t), files), "links")


@query("SELECT idx, id, path FROM sql_indexed")
def file_index(t: Testbed) -> DataFrame:
    return report.file_table(t.entities)


@query("SELECT id, owner, owner_email FROM sql_primary")
def primary_owner(t: Testbed) -> DataFrame:
    return report.primary_owner(_owned(t), t.entities)


@query("SELECT path, crate, label FROM sql_crate_of JOIN sql_indexed USING (idx)")
def crate_groups(t: Testbed) -> DataFrame:
    path = F.col("path")
    return t.files.select("path", paths.crate_of(path).alias("crate"), paths.basename(path).alias("label"))


@query("SELECT owner_idx, owner, files FROM sql_owners")
def owner_rank(t: Testbed) -> DataFrame:
    return report.owner_ranks(report.primary_owner(_owned(t), t.entities))


@query("SELECT crate_idx, crate FROM sql_crates")
def crate_index(t: Testbed) -> DataFrame:
    return report.crate_index(t.files)


@query("SELECT * FROM sql_nodes")
def report_nodes(t: Testbed) -> DataFrame:
    return _report(t).nodes


@query(f"SELECT kind, source, target FROM sql_links WHERE kind IN {_in(REPORT_LINK_KINDS)}")
def struct_links(t: Testbed) -> DataFrame:
    return report.struct_links(report.indexed_links(t.struct, report.file_table(t.entities)))


@query("SELECT source, target, confidence FROM sql_pair_links")
def cochange_links(t: Testbed) -> DataFrame:
    return report.cochange_links(_report_links(t)[1])


@query("SELECT source, target, confidence FROM sql_pair_links")
def cochange_links_mined(t: Testbed) -> DataFrame:
    """The report's co-change links from pairs that reach the threshold only."""
    changes = stored(t.changes.select("hash", "path"), "changes")
    codes = cochange.path_codes(changes)
    strong = cochange.strong_pairs(changes, COCHANGE_REPORT_THRESHOLD, codes=codes)
    edges = cochange.cochange_edges(strong, t.entities, codes)
    return report.cochange_links(report.indexed_links(edges, report.file_table(t.entities)))


@query("SELECT * FROM sql_scored WHERE confidence >= 0.6")
def cochange_strong_pairs(t: Testbed) -> DataFrame:
    return cochange.strong_pairs(t.changes, 0.6)


@query("SELECT idx, degree FROM sql_link_degree")
def report_degree(t: Testbed) -> DataFrame:
    return link_degree(_report_links(t)[1])


@query("SELECT node, next FROM sql_near")
def report_adjacency(t: Testbed) -> DataFrame:
    return symmetric_adjacency(report.indexed_links(t.struct, report.file_table(t.entities)))


def _struct_links(t: Testbed) -> tuple[DataFrame, DataFrame]:
    files = report.file_table(t.entities)
    return files, checkpointed(report.indexed_links(t.struct, files))


@query("SELECT source, node, depth FROM sql_blast")
def blast_all_sources(t: Testbed) -> DataFrame:
    return report.all_sources_blast(*_struct_links(t))


@query("""
    SELECT idx, coalesce(n, 0) AS blast FROM sql_indexed
    LEFT JOIN (SELECT source AS idx, count(*) AS n FROM sql_blast GROUP BY source) USING (idx)""")
def blast_all_sources_size(t: Testbed) -> DataFrame:
    files, links = _struct_links(t)
    return blast_size(files, report.all_sources_blast(files, links))


@query("""
    SELECT idx, coalesce(n, 0) AS blast, true AS close FROM sql_indexed
    LEFT JOIN (SELECT source AS idx, count(*) AS n FROM sql_blast GROUP BY source) USING (idx)""")
def blast_all_sources_estimate(t: Testbed) -> DataFrame:
    """Sizes by sketches beside the exact ones: within a tenth, or one file."""
    files, links = _struct_links(t)
    exact = blast_size(files, report.all_sources_blast(files, links))
    guessed = report.blast_size_estimate(files, links).withColumnRenamed("blast", "estimate")
    close = F.abs(F.col("estimate") - F.col("blast")) <= F.greatest(F.lit(1.0), F.col("blast") * 0.1)
    return exact.join(guessed, "idx").select("idx", "blast", close.alias("close"))


@query("SELECT idx, label, path, degree FROM sql_nodes ORDER BY degree DESC, path LIMIT 10")
def report_hotspots(t: Testbed) -> DataFrame:
    return _report(t).hotspots()


@query(f"""
    SELECT (SELECT count(*) FROM sql_nodes) AS files,
           (SELECT count(*) FROM sql_links WHERE kind IN {_in(REPORT_LINK_KINDS)}) AS struct_edges,
           (SELECT count(*) FROM sql_pair_links) AS cochange_edges,
           (SELECT count(*) FROM sql_owners) AS owners, (SELECT count(*) FROM sql_crates) AS crates""")
def report_stats(t: Testbed) -> DataFrame:
    return _report(t).stats()


@query("SELECT owner_idx, owner, files FROM sql_owners WHERE owner_idx < 8")
def top_contributors(t: Testbed) -> DataFrame:
    return report.top_contributors(report.owner_ranks(report.primary_owner(_owned(t), t.entities)))


@query("""
    SELECT idx, rank, partner, label, CAST(round(confidence * 100) AS INTEGER) AS percent FROM (
        SELECT idx, partner, confidence,
               CAST(row_number() OVER (PARTITION BY idx ORDER BY confidence DESC, partner) AS INTEGER) AS rank
        FROM (SELECT source AS idx, target AS partner, confidence FROM sql_pair_links
              UNION SELECT target, source, confidence FROM sql_pair_links)) x
    JOIN (SELECT idx AS partner, label FROM sql_indexed) USING (partner) WHERE rank <= 6""")
def node_cochange_top6(t: Testbed) -> DataFrame:
    files, links = _report_links(t)
    named = files.select("idx", paths.basename(F.col("path")).alias("label"))
    return report.partner_top(report.cochange_links(links), named)


@query(f"""
    SELECT 0 AS section, '' AS key, concat('{{"repo":"testbed","stats":', to_json({{
               'files': (SELECT count(*) FROM sql_nodes),
               'struct_edges': (SELECT count(*) FROM sql_links WHERE kind IN {_in(REPORT_LINK_KINDS)}),
               'cochange_edges': (SELECT count(*) FROM sql_pair_links),
               'owners': (SELECT count(*) FROM sql_owners), 'crates': (SELECT count(*) FROM sql_crates)}}),
           ',"nodes":[') AS text
    UNION ALL
    SELECT 1, CAST(idx AS STRING), concat(CASE idx WHEN 0 THEN '' ELSE ',' END, to_json({{
        'id': idx, 'label': label, 'path': path, 'crate': crate, 'crate_idx': crate_idx, 'owner': owner,
        'owner_email': owner_email, 'owner_idx': owner_idx, 'degree': degree}})) FROM sql_nodes
    UNION ALL SELECT 2, '', '],"struct_links":['
    UNION ALL
    SELECT 3, concat(source, '.', target, '.', rank),
           concat(CASE row_number() OVER (ORDER BY source, target, rank) WHEN 1 THEN '' ELSE ',' END,
                  to_json({{'source': source, 'target': target, 'kind': 'struct'}}))
    FROM (SELECT source, target, CASE kind WHEN 'imports' THEN 1 ELSE 2 END AS rank FROM sql_links
          WHERE kind IN {_in(REPORT_LINK_KINDS)})
    UNION ALL SELECT 4, '', '],"cochange_links":['
    UNION ALL
    SELECT 5, concat(source, '.', target),
           concat(CASE row_number() OVER (ORDER BY source, target) WHEN 1 THEN '' ELSE ',' END,
                  to_json({{'source': source, 'target': target, 'kind': 'cochange', 'confidence': confidence}}))
    FROM sql_pair_links
    UNION ALL SELECT 6, '', '],"blast":{{'
    UNION ALL
    SELECT 7, concat(idx, '.0'), concat(CASE idx WHEN 0 THEN '' ELSE ',' END, '"', idx, '":[') FROM sql_indexed
    UNION ALL
    SELECT 7, concat(source, '.1.', slice), concat(CASE min(slice) OVER (PARTITION BY source) WHEN slice THEN '' ELSE ',' END, list)
    FROM (SELECT source, node // {report.LIST_CHUNK} AS slice, string_agg(CAST(node AS STRING), ',' ORDER BY node) AS list
          FROM sql_blast GROUP BY 1, 2)
    UNION ALL SELECT 7, concat(idx, '.2'), ']' FROM sql_indexed
    UNION ALL SELECT 8, '', '}},"hotspots":['
    UNION ALL
    SELECT 9, concat(-degree, '.', idx),
           concat(CASE row_number() OVER (ORDER BY degree DESC, idx) WHEN 1 THEN '' ELSE ',' END,
                  to_json({{'id': idx, 'label': label, 'path': path, 'degree': degree}}))
    FROM (SELECT * FROM sql_nodes ORDER BY degree DESC, path LIMIT 10)
    UNION ALL SELECT 10, '', '],"owners":['
    UNION ALL
    SELECT 11, CAST(owner_idx AS STRING), concat(CASE owner_idx WHEN 0 THEN '' ELSE ',' END,
        to_json({{'name': owner, 'count': files}})) FROM sql_owners
    UNION ALL SELECT 12, '', '],"crates":['
    UNION ALL
    SELECT 13, CAST(crate_idx AS STRING), concat(CASE crate_idx WHEN 0 THEN '' ELSE ',' END, to_json(crate)) FROM sql_crates
    UNION ALL SELECT 14, '', ']}}'""")
def graph_json(t: Testbed) -> DataFrame:
    key = F.array_join(F.col("key").cast("array<string>"), ".").alias("key")
    return _report(t).json_fragments("testbed").select("section", key, "text")


# --- Requests -------------------------------------------------------------------------------


@query("SELECT * FROM sql_checked")
def request_validation(t: Testbed) -> DataFrame:
    return requests.validated(t.requests)


def _answers(df: DataFrame) -> DataFrame:
    return df.select("request_id", "tool", "status", "result", "detail", F.round("value", 6).alias("value"), "rank", "message")


@query("SELECT * FROM sql_answers")
def batch_requests(t: Testbed) -> DataFrame:
    return _answers(requests.answer(t.requests, t.entities, _graph(t)))


def _asked_stream(t: Testbed) -> DataFrame:
    """The testbed's requests as a stream of event files."""
    schema = t.table("events").schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    user, value = F.col("user_id"), F.col("value")
    tool = (
        F.when(F.col("event_type") == "view", "who_owns").when(F.col("event_type") == "click", "dependencies")
        .when(F.col("event_type") == "purchase", "co_changes")
        .when(F.col("event_type") == "signup", F.when(value >= 40, "blast_radius").otherwise("hotspots"))
        .otherwise(F.col("event_type"))
    )
    named = events.join(t.files.select(F.col("k").alias("user_id"), "path"), "user_id", "left")
    return named.select(
        F.col("event_id").cast("string").alias("request_id"), tool.alias("tool"),
        F.when(value < 3, None).when(value < 5, F.concat(F.lit("../"), user))
        .when(value < 8, F.concat(F.lit("missing/"), user)).otherwise(F.col("path")).alias("entity"),
        F.when(value <= 400, F.floor(value / 40)).alias("depth"),
        F.when(value > 30, "upstream").alias("direction"),
        F.when(value >= 10, F.floor(value * 20)).alias("limit"),
    )


@query("SELECT * FROM sql_answers")
def stream_requests(t: Testbed) -> DataFrame:
    """The same requests as a stream of event files, answered micro-batch by micro-batch."""
    asked = _asked_stream(t)
    sink, progress = scratch_path(t.spark, "answers"), scratch_path(t.spark, "progress")
    answer_stream(asked, t.entities, _graph(t), sink, progress).awaitTermination()
    return _answers(t.spark.read.parquet(sink))


@query("SELECT * FROM sql_answers")
def stream_requests_joined(t: Testbed) -> DataFrame:
    """One-hop requests joined as a stream with stored answers, the others by micro-batch."""
    sink, progress = scratch_path(t.spark, "answers"), scratch_path(t.spark, "progress")
    for running in answer_streams(_asked_stream(t), t.entities, _graph(t), sink, progress):
        running.awaitTermination()
    near, far = (t.spark.read.parquet(f"{sink}/{part}") for part in ("one-hop", "reach"))
    return _answers(near.unionByName(far.drop("batch")))
