"""The operators of this subpackage as queries over the given tables, and the SQL that states them."""

from __future__ import annotations

from graphquarry.llm import (
    alignment, bpe, decontaminate, htmltext, language, linededup, lmscore, merkle, neardup, pii, syncmers, urlfilter, warc,
)

QUERIES = {
    "op1_lm_score": lmscore.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_arc_to_warc": warc.query,
    "op4_weak_pii": pii.query,
    "op5_block_rule_text": htmltext.query,
    "op6_closed_syncmers": syncmers.query,
    "op7_compression_language": language.query,
    "op8_byte_bpe": bpe.query,
    "op9_decontaminate": decontaminate.query,
    "op10_redirect_url_filter": urlfilter.query,
    "op11_line_dedup": linededup.query,
    "op12_merkle_manifest": merkle.query,
    "op13_token_alignment": alignment.query,
}
ORACLES = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, y FROM reach JOIN links ON x = node),
named AS (SELECT root, min(node) AS component_id FROM reach GROUP BY root)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN named ON root = d.doc_id
""",
    "op3_arc_to_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q
""",
    # the pages hold no canonical link and no redirect, so no alias changes a default verdict
    "op10_redirect_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM named n LEFT JOIN best b USING (page_id)
""",
    "op9_decontaminate": r"""
WITH folded AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS l FROM folded WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
            FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM items)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i
           FROM docs, (SELECT DISTINCT l FROM items)),
hits AS (SELECT doc_id, i, p.l, item_id
         FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM places) p
         JOIN windows USING (l, win)),
marked AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + l)) AS spot FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, line, pos, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    # DuckDB has no crc32: the register is folded over the digits, bit by bit, without the final inversion
    "op12_merkle_manifest": r"""
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS altered
  FROM (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS cut,
          coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
          coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM docs)),
placed AS (
  SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT 0 AS lv, g, p, n, leaf AS d FROM placed
  UNION ALL
  SELECT lv + 1, g, p // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY lv, g, p // 3, n),
tops AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS lv, p, n, d FROM tops
  UNION ALL
  SELECT lv + 1, p // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY p)) FROM upper_nodes WHERE n > 1 GROUP BY lv, p // 3, n),
beside AS (
  SELECT lv, g, p, n, coalesce(lag(d, 2) OVER w, '') || coalesce(lag(d) OVER w, '') AS l, coalesce(lead(d) OVER w, '') || coalesce(lead(d, 2) OVER w, '') AS r
  FROM nodes WINDOW w AS (PARTITION BY lv, g, p // 3 ORDER BY p)),
upper_beside AS (
  SELECT lv, p, n, coalesce(lag(d, 2) OVER w, '') || coalesce(lag(d) OVER w, '') AS l, coalesce(lead(d) OVER w, '') || coalesce(lead(d, 2) OVER w, '') AS r
  FROM upper_nodes WINDOW w AS (PARTITION BY lv, p // 3 ORDER BY p)),
climb AS (
  SELECT doc_id, g, leaf, 0 AS lv, p, n, altered AS acc, '' AS siblings FROM placed
  UNION ALL
  SELECT doc_id, c.g, leaf, c.lv + 1, c.p // 3, (c.n + 2) // 3, sha256(l || acc || r), siblings || l || r
  FROM climb c JOIN beside b ON b.lv = c.lv AND b.g = c.g AND b.p = c.p WHERE c.n > 1),
climb_upper AS (
  SELECT doc_id, leaf, t.d AS subroot, 0 AS lv, t.p AS p, t.n AS n, acc, siblings FROM climb c JOIN tops t USING (g) WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, c.lv + 1, c.p // 3, (c.n + 2) // 3, sha256(l || acc || r), siblings || l || r
  FROM climb_upper c JOIN upper_beside b ON b.lv = c.lv AND b.p = c.p WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM climb_upper, (SELECT d AS root FROM upper_nodes WHERE n = 1) WHERE n = 1
""",
}
