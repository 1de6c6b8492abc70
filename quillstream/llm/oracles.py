"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_warc_archive"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), g AS (
    SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY sha1(h)) END AS top FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END::BIGINT AS refers_to, 'ok' AS status
FROM g
"""

ORACLES["op2_metric_tree"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
)
SELECT query_id::BIGINT AS query_id,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id::BIGINT AS vec_id, score
FROM scored QUALIFY rank <= 5
"""

ORACLES["op5_phrase_index"] = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), i AS (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), spots AS (
    SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase
    FROM (SELECT d.*, z.size, unnest(range(1, greatest(len(w) - z.size + 1, 0) + 1)) AS s FROM d CROSS JOIN (SELECT DISTINCT size FROM windows) z)
), hits AS (
    SELECT doc_id, item_id, s, spots.size FROM spots JOIN windows ON spots.phrase = windows.phrase AND spots.size = windows.size
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op8_line_windows"] = """
WITH d AS (SELECT doc_id, text, string_split(text, E'\\n') AS l FROM documents),
w AS (
    SELECT doc_id, s, array_to_string(list_slice(l, s, s + 2), E'\\n') AS h
    FROM (SELECT *, unnest(range(1, len(l) - 1)) AS s FROM d WHERE len(l) >= 3)
    WHERE trim(array_to_string(list_slice(l, s, s + 2), '')) <> ''
), later AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS p FROM later),
gone AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM covered GROUP BY doc_id),
kept AS (
    SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, text,
           array_to_string(list_filter(l, lambda x, i: NOT list_contains(coalesce(p, []), i)), E'\\n') AS after
    FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, n_removed, sha256(coalesce(after, '')) AS kept_sha256 FROM kept
"""

#: crc32 of the decimal text of ``conv_id``, bit by bit: 0 and more folds a byte in, -1 shifts by one bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

ORACLES["op12_prefix_trie"] = f"""
WITH placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
    SELECT c.conv_id, place, role, text FROM convs c JOIN placed p ON p.conv_id = c.base WHERE place < h
    UNION ALL SELECT c.conv_id, place, role, text FROM convs c JOIN placed p ON p.conv_id = c.conv_id WHERE place >= h
), whole AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) AS turns FROM rebuilt GROUP BY conv_id),
filled AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM convs c LEFT JOIN whole USING (conv_id)),
prefixes AS (SELECT conv_id, d, list_slice(turns, 1, d) AS p, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM filled)),
nodes AS (
    SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM prefixes GROUP BY d, p
), children AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.p[-1].t) ELSE 0 END AS saved
    FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p
), sums AS (
    SELECT a AS d, list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = list_slice(n.p, 1, n.d - 1)
"""

ORACLES["op13_automaton_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
marked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(t)) < doc_id AS again FROM windows),
covered AS (
    SELECT w.doc_id, w.p, w.word, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM words w LEFT JOIN marked m ON m.doc_id = w.doc_id AND m.i = w.p
), told AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept,
           count(*) FILTER (WHERE gone AND NOT before) AS n_spans
    FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS before FROM covered) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN told USING (doc_id)
"""
