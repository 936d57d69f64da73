"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
#: Spark and DuckDB agree on ASCII: A-Z alone are lower-cased.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;') AS by_role,
    replace(replace(text, '&', '&amp;'), '<', '&lt;') AS by_text FROM rows
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, by_role, by_text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, by_role, by_text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<turn>' || by_role || chr(10) || by_text || '</turn>')) AS formatted_chars
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM chats
"""

OP4 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS w FROM texts
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM words, unnest(range(1, len(w) - 6)) AS t(i)
), repeats AS (
  SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1
), hits AS (
  SELECT r, count(DISTINCT i + j) AS n FROM windows JOIN repeats USING (r, k), unnest(range(0, 8)) AS t(j) GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dups AS (
  SELECT r, sum(n - 1) AS n_dup, sum(n) AS n_lines FROM lines GROUP BY r
), measures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(hits.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_word_lines
  FROM words LEFT JOIN hits USING (r) LEFT JOIN dups USING (r)
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_word_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits
FROM bits
"""

OP5 = f"""
WITH lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key
), judged AS (
  SELECT k.r, k.doc_id, line, pos, coalesce(first < doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6 = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), words AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS w FROM texts
), sets AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT r, count(*) AS n FROM sets GROUP BY r
), pairs AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach(a, b) AS (
  SELECT r, r FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN words ON words.r = reach.b GROUP BY a
)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (r) JOIN least_of USING (r)
"""

OP7 = f"""
WITH items AS (
  SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM tests), unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (
  SELECT r, i, tests.n AS n, item_id FROM windows JOIN tests ON windows.n = tests.n AND windows.k = tests.k
), hits AS (
  SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS t(j) GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""

#: Texts as hex digits: a byte is two of them, a 50-byte string 100.
OP10 = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS s
  FROM texts, unnest(range(0, length(h) // 2)) AS t(i)
), holders AS (
  SELECT s, min(doc_id) AS doc FROM places WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)
), late AS (
  SELECT r, i, byte, CASE WHEN doc < doc_id THEN 1 ELSE 0 END AS late FROM places LEFT JOIN holders ON places.s = holders.s
), gone AS (
  SELECT r, i, byte, max(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM late
), runs AS (
  SELECT r, i, byte, gone, lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) AS before FROM gone
), sums AS (
  SELECT r, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept
  FROM runs GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN sums USING (r)
"""

#: Absolute canonical and refresh targets outside comments, scripts and styles.
OP12 = r"""
WITH RECURSIVE rules(action, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT url, unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<textarea\b.*?</textarea\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>'
  )) AS tag FROM pages WHERE url IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')
), targets AS (
  SELECT url AS a, CASE
    WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?(https?://[^\s"''>]+)', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?(https?://[^\s"''>]+)', 1)
  END AS b FROM tags
), edges AS (
  SELECT regexp_replace(a, '#.*$', '') AS a, regexp_replace(b, '#.*$', '') AS b FROM targets WHERE b <> ''
), ends AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT a, a FROM ends UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a
), urls AS (
  SELECT DISTINCT url FROM (SELECT coalesce(url, '') AS url FROM pages UNION ALL SELECT a FROM ends)
), parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls
), fits AS (
  SELECT url, r.host || r.path AS rule, action,
    row_number() OVER (PARTITION BY url ORDER BY length(r.host || r.path) DESC, action, r.host || r.path) AS nr
  FROM parts p JOIN rules r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path)
), own AS (
  SELECT url, host, path, rule, action FROM parts LEFT JOIN (SELECT url, rule, action FROM fits WHERE nr = 1) USING (url)
), blocked AS (
  SELECT DISTINCT reach.a AS node FROM reach JOIN own ON own.url = reach.b WHERE own.action = 'block'
)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM pages JOIN own ON own.url = coalesce(pages.url, '') LEFT JOIN blocked ON blocked.node = regexp_replace(pages.url, '#.*$', '')
"""

#: crc32 of the decimal digits: each byte, then its eight shifts (-1), folded.
_CRC32 = """(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"""

OP13 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), keyed AS (
  SELECT conv_id, turn, role, md5(length(role) || ':' || role || text) AS k, length(text)::BIGINT AS n FROM turns
), convs AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, role, k) AS k, list(n ORDER BY turn NULLS FIRST, role, k) AS n FROM keyed GROUP BY conv_id
), heads AS (
  SELECT conv_id, k, n, (xor({_CRC32.format("conv_id")}, 4294967295) % 6)::BIGINT AS h FROM convs
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.k[1 : h], []), c.k[h + 1 :]) AS k, list_concat(coalesce(b.n[1 : h], []), c.n[h + 1 :]) AS n
  FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
  SELECT conv_id, d, array_to_string(k[1 : d], '') AS prefix, len(k) = d AS ends, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS n
  FROM rebuilt, unnest(range(0, len(k) + 1)) AS t(d)
), grouped AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM members GROUP BY prefix, d
), nodes AS (
  SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM grouped g
  LEFT JOIN (SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS n_children FROM grouped WHERE d > 0 GROUP BY 1) c ON c.prefix = g.prefix
), below AS (
  SELECT left(prefix, 32 * a) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
  FROM nodes, unnest(range(0, d + 1)) AS t(a) GROUP BY 1
)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs, nodes.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (prefix) LEFT JOIN grouped up ON nodes.d > 0 AND up.prefix = left(nodes.prefix, 32 * (nodes.d - 1))
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": OP2,
    "op4_quality_rules": OP4,
    "op5_line_dedup": OP5,
    "op6_jaccard_join": OP6,
    "op7_decontamination": OP7,
    "op10_suffix_dedup": OP10,
    "op12_url_aliases": OP12,
    "op13_prefix_trie": OP13,
}
