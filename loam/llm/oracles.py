"""SQL that the operators' queries must equal, where SQL can say it."""

from loam.llm.url_filters import PATTERNS

_WORDS = r"'[^\x20\x09-\x0D]+'"

_MEASURES = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"),
             "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
_LEAST = {"word_length": 0.5, "symbol_share": 0.05, "dup_line_share": 0.1, "repeat_share": 0.1}
_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END::DOUBLE AS x FROM base"
                             for m, (a, b) in _MEASURES.items())


def _fences(depth: int, keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""SELECT {depth} AS depth, {by}, max(n) AS n, min(v) FILTER (upto >= 0.25 * n) AS q1, min(v) FILTER (upto >= 0.75 * n) AS q3 FROM (
    SELECT {by}, (pow(1.02e0, b) - 1) / 100 AS v, sum(k) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(k) OVER (PARTITION BY {by}) AS n
    FROM (SELECT {by}, ceil(ln(1 + 100 * x) / ln(1.02e0)) AS b, count(*) AS k FROM vals WHERE NOT base_failed GROUP BY ALL) s) r GROUP BY {by}"""


OP1 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w) x),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(8) r(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS ls,
  coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
base AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
vals AS ({_VALUES}),
f2 AS ({_fences(0, 'lang, source')}), f1 AS ({_fences(1, 'lang')}), f0 AS ({_fences(2, '')}),
judged AS (SELECT v.doc_id, v.measure, v.x,
  CASE WHEN f2.n >= 100 THEN f2.q1 WHEN f1.n >= 100 THEN f1.q1 ELSE f0.q1 END AS q1,
  CASE WHEN f2.n >= 100 THEN f2.q3 WHEN f1.n >= 100 THEN f1.q3 ELSE f0.q3 END AS q3,
  CASE v.measure {' '.join(f"WHEN '{m}' THEN {s}e0" for m, s in _LEAST.items())} END AS least
  FROM vals v LEFT JOIN f2 ON v.measure = f2.measure AND v.lang IS NOT DISTINCT FROM f2.lang AND v.source IS NOT DISTINCT FROM f2.source
  LEFT JOIN f1 ON v.measure = f1.measure AND v.lang IS NOT DISTINCT FROM f1.lang LEFT JOIN f0 ON v.measure = f0.measure),
inside AS (SELECT doc_id, bool_and(coalesce(x <= q3 + 3 * greatest(q3 - q1, least) + 1e-9, TRUE)
  AND coalesce(measure <> 'word_length' OR x >= q1 - 3 * greatest(q3 - q1, least) - 1e-9, TRUE)) AS fine FROM judged GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM base b JOIN inside i ON b.doc_id = i.doc_id
"""

_REACH = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE FALSE END),
{_REACH.strip()}
SELECT n.id AS vec_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, n.id = c.c AS kept FROM nodes n
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) k ON n.id = k.x JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON n.id = c.a
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to, TRUE AS intact FROM p
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT id, s FROM (
  SELECT id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) x
  UNION ALL SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2) y),
size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_ways AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
near AS (SELECT x, y FROM both_ways JOIN size a ON x = a.id JOIN size b ON y = b.id WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near), nodes AS (SELECT id FROM w),
{_REACH.strip()}
SELECT w.id AS doc_id, coalesce(size.n, 0) AS n_shingles, c.c AS component_id, coalesce(k.n, 0) AS n_links FROM w LEFT JOIN size ON w.id = size.id
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) k ON w.id = k.x JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON w.id = c.a
"""

OP8 = r"""
WITH RECURSIVE m AS (SELECT conv_id AS conv, turn, role, coalesce(text, '') AS raw FROM conversations),
u AS (SELECT DISTINCT conv, turn, raw FROM m),
l AS (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS body FROM (
  SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks FROM (
    SELECT *, unnest(regexp_split_to_array(raw, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(raw, '\r?\n'), 1) AS i FROM u) a) b),
n AS (SELECT *, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM l),
o AS (SELECT *, lag(norm) OVER w AS last_norm, lag(level) OVER w AS last_level, lead(level) OVER w AS next_level
  FROM n WINDOW w AS (PARTITION BY conv, turn, raw ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN norm <> '' AND last_norm <> '' AND last_level = level THEN 0 ELSE 1 END) OVER (PARTITION BY conv, turn, raw ORDER BY i) AS part FROM o),
p AS (SELECT conv, turn, raw, part, level, string_agg(norm, ' ' ORDER BY i) AS norm FROM g WHERE norm <> '' GROUP BY ALL),
wrote AS (SELECT conv, turn, norm FROM p WHERE level = 0 UNION SELECT conv, turn, norm FROM g WHERE level = 0 AND norm <> ''
  UNION SELECT conv, turn, string_agg(norm, ' ' ORDER BY i) FROM g WHERE level = 0 AND norm <> '' GROUP BY conv, turn, raw),
source AS (SELECT conv, norm, min(turn) AS source FROM wrote GROUP BY ALL),
quoted AS (SELECT conv, turn, raw, part, level, norm FROM p WHERE level > 0
  UNION SELECT conv, turn, raw, part, level, norm FROM g WHERE level > 0 AND norm <> ''),
found AS (SELECT q.*, source FROM quoted q JOIN source s ON q.conv = s.conv AND q.norm = s.norm WHERE source < turn),
linked AS (SELECT conv, turn, raw, count(DISTINCT part) AS n FROM found GROUP BY ALL),
best AS (SELECT conv, turn, arg_max(source, (-level, chars, source)) AS answers FROM (
  SELECT conv, turn, level, source, sum(length(norm)) AS chars FROM found GROUP BY ALL) x GROUP BY ALL),
replies AS (SELECT t.conv, t.turn, coalesce(answers, lag(t.turn) OVER (PARTITION BY t.conv ORDER BY t.turn)) AS reply_to
  FROM (SELECT DISTINCT conv, turn FROM u WHERE conv IS NOT NULL AND turn IS NOT NULL) t LEFT JOIN best b ON t.conv = b.conv AND t.turn = b.turn),
deep(conv, turn, depth) AS (SELECT conv, turn, 0::BIGINT FROM replies WHERE reply_to IS NULL
  UNION ALL SELECT r.conv, r.turn, d.depth + 1 FROM deep d JOIN replies r ON r.conv = d.conv AND r.reply_to = d.turn),
own AS (SELECT conv, turn, raw, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(next_level, 0) > 0
    AND regexp_matches(body, '(?i)(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY ALL),
quotes AS (SELECT conv, turn, raw, count(*) AS n FROM p WHERE level > 0 GROUP BY ALL)
SELECT m.conv AS conv_id, m.turn, m.role, reply_to, coalesce(depth, 0) AS depth, coalesce(q.n, 0) AS n_quotes, coalesce(k.n, 0) AS n_linked, o.text
FROM m JOIN own o ON m.conv IS NOT DISTINCT FROM o.conv AND m.turn IS NOT DISTINCT FROM o.turn AND m.raw = o.raw
LEFT JOIN quotes q ON m.conv IS NOT DISTINCT FROM q.conv AND m.turn IS NOT DISTINCT FROM q.turn AND m.raw = q.raw
LEFT JOIN linked k ON m.conv = k.conv AND m.turn = k.turn AND m.raw = k.raw LEFT JOIN replies r ON m.conv = r.conv AND m.turn = r.turn
LEFT JOIN deep d ON m.conv = d.conv AND m.turn = d.turn
"""

OP11 = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS behind FROM pages),
u AS (SELECT page_id, translate(regexp_extract(behind, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(behind, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(behind, '(?s)^[^?#]*(.*)$', 1) AS rest FROM p),
rules(verdict, h, t) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
signs(pattern) AS (VALUES {', '.join(f"('{p.rule}')" for p in PATTERNS)}),
fitting AS (SELECT page_id, arg_max(h || t, length(h || t)) AS rule, arg_max(verdict, length(h || t)) AS verdict
  FROM u, rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, t) GROUP BY page_id),
found AS (SELECT page_id, min(pattern) AS pattern FROM u, signs WHERE regexp_matches(host || path || rest, pattern) GROUP BY page_id)
SELECT u.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN g.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.rule IS NULL THEN g.pattern END AS pattern
FROM u LEFT JOIN fitting f ON u.page_id = f.page_id LEFT JOIN found g ON u.page_id = g.page_id
"""

OP12 = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) END::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT s.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY s.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""
