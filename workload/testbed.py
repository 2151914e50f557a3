"""A code base derived from the benchmark tables, in SQL that Spark and DuckDB both run.

A part is a file, an order a commit, a line item a changed file and a blamed line, a customer
an author, a document a source text and an event a request. Every view covers its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphquarry.session import bounded_tasks, stored

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

VIEWS: dict[str, str] = {
    "tb_files": """
        SELECT p_partkey AS k, concat('f:', p_partkey) AS id,
               concat(CASE p_type WHEN 'ECONOMY' THEN concat('crates/', lower(replace(p_brand, '#', '')), '/')
                                  WHEN 'PROMO' THEN ''
                                  ELSE concat(lower(p_type), '/', lower(replace(p_brand, '#', '')), '/') END,
                      'f', p_partkey,
                      CASE WHEN p_size <= 20 THEN '.rs' WHEN p_size <= 40 THEN '.ts' ELSE '.tsx' END) AS path,
               concat('f', p_partkey,
                      CASE WHEN p_size <= 20 THEN '.rs' WHEN p_size <= 40 THEN '.ts' ELSE '.tsx' END) AS name,
               CASE WHEN p_size <= 20 THEN 'rust' ELSE 'typescript' END AS language
        FROM part""",
    "tb_entities": """
        SELECT id, 'File' AS kind, name, path, language FROM tb_files
        UNION ALL
        SELECT concat('p:', c_custkey), 'Person', c_name, concat('c', c_custkey, '@example.com'), NULL FROM customer
        UNION ALL
        SELECT concat('d:', s_suppkey), 'Document', s_name, NULL, NULL FROM supplier WHERE s_acctbal >= 0""",
    "tb_span": """
        SELECT l_partkey AS k, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order
        FROM lineitem GROUP BY l_partkey""",
    "tb_ends": """
        SELECT l_orderkey AS o, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY l_orderkey""",
    "tb_struct": """
        SELECT concat('f:', k) AS from_id, concat('f:', high) AS to_id,
               CASE p_type WHEN 'MEDIUM' THEN 'depends_on' WHEN 'PROMO' THEN 'calls' WHEN 'ECONOMY' THEN 'implements'
                           WHEN 'SMALL' THEN 'exposes' ELSE 'imports' END AS kind,
               CAST(1.0 AS DOUBLE) AS confidence
        FROM tb_span JOIN tb_ends ON first_order = o JOIN part ON p_partkey = k
        UNION
        SELECT concat('f:', k), concat('f:', low),
               CASE WHEN p_size <= 25 THEN 'depends_on' ELSE 'imports' END, CAST(1.0 AS DOUBLE)
        FROM tb_span JOIN tb_ends ON last_order = o JOIN part ON p_partkey = k""",
    "tb_docs": """
        SELECT concat('f:', l_partkey) AS from_id, concat('d:', l_suppkey) AS to_id, 'documented_in' AS kind,
               CASE WHEN min(l_tax) = 0 THEN NULL ELSE max(l_discount) END AS confidence
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "tb_raw_edges": """
        SELECT * FROM tb_struct UNION ALL SELECT * FROM tb_docs
        UNION ALL
        SELECT concat('f:', p_partkey), concat('f:', p_partkey), replace(p_name, ' ', '_'), CAST(1.0 AS DOUBLE)
        FROM part""",
    "tb_edges": """
        SELECT * FROM tb_struct
        UNION ALL
        SELECT tb_docs.* FROM tb_docs JOIN supplier ON to_id = concat('d:', s_suppkey) WHERE s_acctbal >= 0""",
    "tb_commits": """
        SELECT CAST(o_orderkey AS STRING) AS hash, c_name AS author, concat('c', o_custkey, '@example.com') AS email,
               o_custkey AS custkey, o_orderdate AS ts, o_orderpriority AS message
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tb_changes": """
        SELECT CAST(l_orderkey AS STRING) AS hash,
               CASE WHEN p_type = 'SMALL' THEN concat('docs/', l_partkey, '.md') ELSE path END AS path,
               CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'R100' ELSE 'M' END AS status
        FROM lineitem JOIN tb_files ON l_partkey = k JOIN part ON p_partkey = k""",
    "tb_blame": """
        SELECT path, author, email FROM lineitem
        JOIN tb_files ON l_partkey = k JOIN tb_commits ON CAST(l_orderkey AS STRING) = hash""",
    "tb_log": """
        SELECT concat('COMMIT_START', chr(10), hash, chr(10), author, chr(10), email, chr(10),
                      CASE message WHEN '5-LOW' THEN 'zz' ELSE CAST(custkey AS STRING) END, chr(10), message, chr(10),
                      chr(10), status, chr(9),
                      CASE WHEN status = 'R100' THEN concat('old/', path, chr(9), path) ELSE path END, chr(10),
                      'D', chr(9), 'gone/', path, chr(10), 'no tab here', chr(10),
                      'C75', chr(9), path, chr(9), 'copy/', path) AS record
        FROM tb_changes JOIN tb_commits USING (hash)""",
    "tb_hunks": """
        SELECT path, concat(md5(concat(n_name, '-', year(o_orderdate))),
                            substr(md5(concat(n_name, '-', year(o_orderdate))), 1, 8)) AS sha,
               n_name AS author, concat(lower(replace(n_name, ' ', '.')), '@example.com') AS email,
               (l_linenumber * (SELECT count(*) FROM orders) + l_orderkey) * 4 AS pos
        FROM lineitem JOIN tb_files ON l_partkey = k JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "tb_first_hunks": """
        SELECT path, sha, author, email, min(pos) AS pos FROM tb_hunks GROUP BY path, sha, author, email""",
    "tb_blame_lines": """
        SELECT path, pos, concat(sha, ' ', pos, ' ', pos, ' 1') AS line FROM tb_hunks
        UNION ALL SELECT path, pos + 1, concat('author ', author) FROM tb_first_hunks
        UNION ALL SELECT path, pos + 2, concat('author-mail <', email, '>') FROM tb_first_hunks
        UNION ALL SELECT path, pos + 3, concat(chr(9), 'text') FROM tb_hunks""",
    "tb_dumps": """
        SELECT h.path, concat(h.sha, ' 1 1 1', chr(10),
                              CASE WHEN f.pos IS NULL THEN '' ELSE concat('author ', h.author, chr(10),
                                  'author-mail <', h.email, '>', chr(10), 'summary author no one', chr(10)) END,
                              'filename x', chr(10), chr(9), 'author nobody', chr(10)) AS dump
        FROM tb_hunks h LEFT JOIN tb_first_hunks f ON h.path = f.path AND h.sha = f.sha AND h.pos = f.pos""",
    "tb_tree": """
        SELECT concat(CASE p_brand WHEN 'Brand#1' THEN 'target/' WHEN 'Brand#2' THEN 'pkg/node_modules/'
                                   WHEN 'Brand#3' THEN 'a/dist/b/' WHEN 'Brand#4' THEN 'web/.next/'
                                   WHEN 'Brand#5' THEN 'build/' WHEN 'Brand#6' THEN 'targets/' ELSE '' END,
                      replace(path, '.tsx', CASE p_type WHEN 'LARGE' THEN '.d.ts' WHEN 'MEDIUM' THEN '.d.tsx'
                                                        WHEN 'SMALL' THEN '.js' WHEN 'STANDARD' THEN '.rs.bak'
                                                        ELSE '.tsx' END)) AS path
        FROM tb_files JOIN part ON k = p_partkey""",
    "tb_texts": """
        SELECT doc_id AS d, lang,
               CASE WHEN source = 'src0' THEN 'src' ELSE concat(source, '/', lang) END AS dir,
               concat(CASE WHEN source = 'src0' THEN 'src' ELSE concat(source, '/', lang) END, '/d', doc_id,
                      CASE lang WHEN 'en' THEN '.rs' WHEN 'es' THEN '.tsx' ELSE '.ts' END) AS path,
               concat('/* ', text, chr(10), '*/', chr(10)) AS head, n_chars,
               length(text) - length(replace(text, chr(10), '')) AS breaks
        FROM documents""",
    "tb_sources": """
        SELECT a.path, concat(a.head,
            'use crate::d', a.d + 1, '::load;', chr(10),
            'use crate::d', a.n_chars, ';', chr(10),
            'pub use std::fmt;', chr(10),
            'mod sub;', chr(10),
            'pub mod extra_', a.d, ';', chr(10),
            '// fn fake_', a.d, '() {}', chr(10),
            'pub struct Item', a.d, ' { value: u32 }', chr(10),
            'pub trait Load', a.d, ' { fn sig_', a.d, '(&self) -> u32; }', chr(10),
            'impl Load', a.d, ' for Item', a.d, ' {', chr(10),
            '    fn run_', a.d, '(&self, xs: [u8; 4]) -> u32 { let s = "fn no_', a.d, '() {}"; 0 }', chr(10),
            '}', chr(10),
            'impl std::fmt::Display for Item', a.d, ' {}', chr(10),
            'impl<T> Wrap<T> { async fn deep_', a.d, '() {} }', chr(10)) AS source
        FROM tb_texts a WHERE a.lang = 'en'
        UNION ALL
        SELECT a.path, concat(a.head,
            'import { a } from "./d', a.d + 1, '.js";', chr(10),
            'import type { B } from ''../../', coalesce(b.dir, 'none'), '/d', a.d + 1, ''';', chr(10),
            'import {', chr(10), '  c,', chr(10), '  d', chr(10), '} from "./index";', chr(10),
            '// import no from "./no', a.d, '";', chr(10),
            'export * from "lodash";', chr(10),
            'import "node:fs";', chr(10),
            'const t = "import z from ''./zz''";', chr(10)) AS source
        FROM tb_texts a LEFT JOIN tb_texts b ON b.d = a.d + 1 WHERE a.lang <> 'en'""",
    # what only a state machine can read: literals that hold quotes, templates in templates, markup, deep nesting
    "tb_hard_sources": """
        SELECT path, concat(
            'const re', d, ' = /["''`]/;', chr(10),
            'import c from "./c', d, '";', chr(10),
            'const z = `a ${ `in ${x', d, '} ` + "}" } don''t', chr(10), 'import no from "./no', d, '";', chr(10),
            replace(replace(replace(text, '`', ''), '$', ''), chr(92), ''), '`;', chr(10),
            'export * from ''./e', d, ''';', chr(10),
            'const half = n', d, ' / 2; // it''s a quotient', chr(10),
            CASE tb_texts.lang WHEN 'es' THEN concat('const v = () => <p title="it''s">don''t `use` {f(`x`)}<b/>', chr(10),
                'import no from "./text', d, '";</p>;', chr(10)) ELSE '' END,
            'import type { G } from "./g', d, '"; export { h } from "h', d, '";', chr(10)) AS source
        FROM tb_texts JOIN documents ON d = doc_id WHERE tb_texts.lang <> 'en'
        UNION ALL
        SELECT path, concat(
            'macro_rules! m', d, ' ', repeat('{', CAST(1 + d % 200 AS INTEGER)), ' fn hidden_', d, '() {} ',
            repeat('}', CAST(1 + d % 200 AS INTEGER)), chr(10),
            repeat('/* " ', CAST(1 + d % 90 AS INTEGER)), replace(replace(text, '/*', ''), '*/', ''),
            ' fn unseen_', d, '() {} ', repeat('don''t */', CAST(1 + d % 90 AS INTEGER)), chr(10),
            'pub fn seen_', d, '(xs: ', repeat('[', CAST(1 + d % 70 AS INTEGER)), 'u8',
            repeat('; {3}]', CAST(1 + d % 70 AS INTEGER)), ') -> u8 { 0 }', chr(10),
            'impl Wrap', repeat('<A', CAST(1 + d % 120 AS INTEGER)), repeat('>', CAST(1 + d % 120 AS INTEGER)),
            ' for Inner', d, ' {}', chr(10)) AS source
        FROM tb_texts JOIN documents ON d = doc_id WHERE tb_texts.lang = 'en'""",
    "tb_code_files": """
        SELECT path FROM tb_texts
        UNION SELECT concat(dir, '/index.ts') FROM tb_texts WHERE lang <> 'en'
        UNION SELECT concat(dir, '/d', d, '/sub.rs') FROM tb_texts JOIN labels ON d = doc_id WHERE quality = 1
        UNION SELECT concat(dir, '/d', d, '/sub/mod.rs') FROM tb_texts JOIN labels ON d = doc_id WHERE toxic = 1""",
    "tb_requests": """
        SELECT CAST(event_id AS STRING) AS request_id,
               CASE event_type WHEN 'view' THEN 'who_owns' WHEN 'click' THEN 'dependencies'
                               WHEN 'purchase' THEN 'co_changes'
                               WHEN 'signup' THEN CASE WHEN value >= 40 THEN 'blast_radius' ELSE 'hotspots' END
                               ELSE event_type END AS tool,
               CASE WHEN value < 3 THEN NULL WHEN value < 5 THEN concat('../', user_id)
                    WHEN value < 8 THEN concat('missing/', user_id) ELSE path END AS entity,
               CASE WHEN value > 400 THEN NULL ELSE CAST(floor(value / 40) AS BIGINT) END AS depth,
               CASE WHEN value > 30 THEN 'upstream' ELSE NULL END AS direction,
               CASE WHEN value < 10 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS "limit"
        FROM events LEFT JOIN tb_files ON user_id = k""",
}

_NAMES = re.compile(r"\b(?:tb|sql)_\w+")


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """Prefix ``sql`` with the views it uses, inner ones first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in views and name not in order:
                own = views[name].replace(name, "")
                visit(own)
                order.append(name)

    visit(sql)
    if not order:
        return sql
    recursive = "RECURSIVE " if any(f"FROM {n}" in views[n] or f"JOIN {n}" in views[n] for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + sql


class Testbed:
    """The views over one data folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        bounded_tasks(spark)  # the views group and join whole tables

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, views: dict[str, str] = VIEWS) -> DataFrame:
        for name in BASE_TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(with_views(text, views).replace('"limit"', "`limit`"))

    def held_lines(self) -> dict[str, DataFrame]:
        """The rows of ``tb_struct`` and ``tb_blame`` and ``(hash, path)`` of ``tb_changes``, from line items that are
        joined with their files once; ``sized`` has a path for each of them."""
        # tb_changes has a row for each pair of a file and a part of its number
        parts = "SELECT p_partkey, collect_list(coalesce(p_type = 'SMALL', false)) AS small FROM part GROUP BY p_partkey"
        lines = self.sql(f"""
            SELECT l_orderkey, k, path, transform(small, s -> CASE WHEN s THEN concat('docs/', k, '.md') ELSE path END) AS changed
            FROM lineitem JOIN (SELECT k, path, small FROM tb_files JOIN ({parts}) ON k = p_partkey) ON l_partkey = k""")
        stored(lines, "lines").createOrReplaceTempView("held_lines")
        # tb_struct joins spans with parts, so that other spans are not needed
        span = VIEWS["tb_span"].replace("l_partkey AS k", "k").replace("GROUP BY l_partkey", "GROUP BY k").replace("lineitem", "held_lines")
        commits = VIEWS["tb_commits"].replace("CAST(o_orderkey AS STRING) AS hash", "o_orderkey")
        return {
            "struct": self.sql("SELECT * FROM tb_struct", VIEWS | {"tb_span": span}),
            "changes": self.sql("SELECT CAST(l_orderkey AS STRING) AS hash, explode(changed) AS path FROM held_lines"),
            "blame": self.sql(f"SELECT path, author, email FROM held_lines JOIN ({commits}) ON l_orderkey = o_orderkey"),
            "sized": self.sql("SELECT path FROM held_lines"),
        }

    def held_hunks(self, view: str) -> DataFrame:
        """A view of blamed hunks, which are written once, file by file.

        The rows are those of ``tb_hunks``, joined with their files last: until then a line is four numbers and a
        short name. ``first`` marks one row per row of ``tb_first_hunks``, ``opens`` the rows that ``tb_dumps`` joins with those.
        """
        columns = VIEWS["tb_hunks"].partition("FROM lineitem JOIN")[0].replace("year(o_orderdate)", "o_year")
        hunks = self.sql(f"""
            SELECT path, sha, author, email, pos, row_number() OVER w = 1 AS first,
                   coalesce(path IS NOT NULL AND sha IS NOT NULL AND pos = min(pos) OVER w, false) AS opens
            FROM ({columns}, k
                  FROM (SELECT l_partkey, l_orderkey, l_linenumber, o_year, n_name FROM lineitem JOIN (
                            SELECT o_orderkey, year(o_orderdate) AS o_year, n_name FROM orders
                            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
                        ON l_orderkey = o_orderkey)
                  JOIN tb_files ON l_partkey = k)
            WINDOW w AS (PARTITION BY k, path, sha, author, email ORDER BY pos NULLS LAST)""")
        stored(hunks, "tb_hunks").createOrReplaceTempView("held_hunks")
        # a path tells its file, but files without a path are grouped together
        firsts = "SELECT path, sha, author, email, {} AS pos FROM held_hunks WHERE first AND path IS {} NULL"
        dumps = VIEWS["tb_dumps"].partition("FROM tb_hunks h LEFT JOIN")[0].replace("f.pos IS NULL", "NOT opens")
        return self.sql(f"SELECT * FROM {view}", VIEWS | {
            "tb_hunks": "SELECT path, sha, author, email, pos FROM held_hunks",
            "tb_first_hunks": f"{firsts.format('pos', 'NOT')} UNION ALL {firsts.format('min(pos)', '')} GROUP BY path, sha, author, email",
            "tb_dumps": f"{dumps} FROM held_hunks h",
        })

    def __getattr__(self, name: str) -> DataFrame:
        if f"tb_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM tb_{name}")
