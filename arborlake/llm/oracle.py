"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from arborlake.llm.linededup import BREAK, UNSEEN

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH r AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM r),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("text")}, {_WORD}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER.format("text")}, {_WORD}) AS w FROM benchmark),
q AS (SELECT DISTINCT id, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS win
  FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
p AS (SELECT r, k.n, s, w[s:s + k.n - 1] AS win FROM d, (SELECT DISTINCT n FROM q) k, unnest(range(1, len(w) - k.n + 2)) AS t(s)),
m AS (SELECT DISTINCT p.r, p.s, p.n, q.id FROM p JOIN q ON p.n = q.n AND p.win = q.win),
h AS (SELECT r, count(DISTINCT s + o) AS n_hit FROM m, unnest(range(0, n)) AS t(o) GROUP BY r),
a AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN a USING (r)
"""

_REST = "CASE WHEN position('://' IN {0}) > 0 THEN substr({0}, position('://' IN {0}) + 3) END"
_HOST = _LOWER.format("regexp_extract(rest, '^[^/?#]*')")
_RULE = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{0}{1}'"

OP7 = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_REST.format("url")} AS rest FROM pages),
x AS (SELECT page_id, html, {_HOST} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1), '') AS query FROM u),
t AS (SELECT *, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>') AS tag1, regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>') AS tag2 FROM x),
l AS (SELECT host, path, query, unnest([regexp_replace(regexp_extract(tag1, '(?is)[\\s"''/]href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '^["'']|["'']$', '', 'g'),
  regexp_extract(regexp_replace(regexp_extract(tag2, '(?is)[\\s"''/]content\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), '(?is)url\\s*=\\s*[''"]?([^''"]+)', 1)]) AS link FROM t WHERE host <> ''),
k AS (SELECT host || path || query AS a, trim(replace(link, '&amp;', '&')) AS link, host, path FROM l),
b0 AS (SELECT a, host, path, link, regexp_extract(link, '^[^?#]*') AS own, regexp_extract(link, '^[^?#]*(.*)$', 1, 's') AS more FROM k),
b1 AS (SELECT *, string_split(CASE WHEN starts_with(own, '/') THEN own ELSE '/' || regexp_replace(regexp_replace(path, '[^/]*$', ''), '^/', '') || own END, '/') AS parts FROM b0),
b2 AS (SELECT *, list_reduce(list_transform(parts, lambda s: [s]), lambda x, y: CASE WHEN y[1] = '.' THEN x WHEN y[1] = '..' THEN CASE WHEN len(x) > 1 THEN x[:-2] ELSE x END ELSE x || y END)
  || CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE [] END AS clean FROM b1),
b AS (SELECT a, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN link = '' OR starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(link, '?') THEN 'http://' || host || path || link ELSE 'http://' || host || array_to_string(clean, '/') || more END AS target FROM b2),
c AS (SELECT a, {_REST.format("target")} AS rest FROM b),
e AS (SELECT a, {_HOST} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1), '') AS query FROM c),
g AS (SELECT a, host || path || query AS b FROM e WHERE host <> '' AND a <> host || path || query),
s AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach(a, b) AS (SELECT a, a FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
n AS (SELECT a, b, 'x://' || b AS u FROM reach),
o AS (SELECT a, {_LOWER.format("regexp_extract(substr(u, 5), '^[^/?#]*')")} AS host, regexp_extract(substr(u, 5), '^[^/?#]*([^?#]*)', 1) AS path FROM n),
v AS (SELECT a, CASE {_RULE.format("example.net", "/en/")} {_RULE.format("example.com", "/de/")} {_RULE.format("org", "/fr/")} {_RULE.format("net", "/")} END AS rule FROM o),
w AS (SELECT a FROM v GROUP BY a HAVING bool_or(rule IN ('net/', 'example.com/de/')) AND NOT coalesce(bool_or(rule IN ('example.net/en/', 'org/fr/')), false)),
j AS (SELECT page_id, host, path, host || path || query AS node, CASE {_RULE.format("example.net", "/en/")} {_RULE.format("example.com", "/de/")} {_RULE.format("org", "/fr/")} {_RULE.format("net", "/")} END AS rule FROM x)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR rule IS NULL AND host <> '' AND node IN (SELECT a FROM w) THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

_LINES = "coalesce(html, '')"
for _pattern in UNSEEN:
    _LINES = f"regexp_replace({_LINES}, '{_pattern}', '', 'g')"

OP8 = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host,
    list_filter(list_transform(string_split_regex({_LINES}, '{BREAK}'), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM (SELECT *, {_REST.format("url")} AS rest FROM pages)),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT r, host, unnest(lines) AS line, unnest(range(len(lines))) AS at FROM p),
n AS (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY host, line),
b AS (SELECT host, line FROM n JOIN t USING (host) WHERE n >= 2 AND n > pages * CAST(0.1 AS DOUBLE)),
k AS (SELECT l.r, count(*) AS kept, string_agg(l.line, chr(10) ORDER BY l.at) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.host = l.host AND b.line = l.line) GROUP BY l.r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(kept, 0) AS BIGINT) AS n_dropped, coalesce(text, '') AS text FROM p LEFT JOIN k USING (r)
"""

ORACLE = {"op2_warc_archive": OP2, "op4_decontaminate": OP4, "op7_url_filter": OP7, "op8_line_dedup": OP8}
