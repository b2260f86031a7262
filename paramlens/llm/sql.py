"""The operators' results as plain SQL, for those that SQL can express."""

from __future__ import annotations

from . import quality, url_filter

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + {quality.WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS u(i)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT j) AS c FROM dup, unnest(range(i, i + {quality.WINDOW})) AS v(j) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: list_contains(string_split('{quality.STOP_WORDS}', ' '), lower(x)))) AS n_stop FROM d LEFT JOIN cov USING (r)),
n AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_repeat_words / n_words <= 0.3 AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.2
  AND coalesce(n_dup_lines / nullif(len(l), 0), 0) <= 0.3 AND (n_words < 50 OR n_stop / n_words >= 0.01) AS kept
FROM n"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT *, length(bin(size)) * 16 + ((size * 8) >> (length(bin(size)) - 1)) AS cl, CAST('0x' || h[1:4] AS BIGINT) % 256 AS sp FROM d),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS ss, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
r AS (SELECT *, ss * 3 AS cap, (ss * 3) / w AS ratio FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, k) AS n, sum(ss) OVER () AS total, sum(w) OVER () AS ww, coalesce(sum(cap) OVER p, 0) AS cc, coalesce(sum(w) OVER p, 0) AS cw FROM r WINDOW p AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - cc) / (ww - cw), n) AS lev FROM o WHERE (total - cc) / (ww - cw) <= ratio),
t AS (SELECT k, ss, CASE WHEN lev IS NULL OR ratio < lev THEN CAST(cap AS DOUBLE) ELSE lev * w END AS target FROM o LEFT JOIN l ON TRUE),
g AS (SELECT c.*, ss, target, row_number() OVER (PARTITION BY c.k ORDER BY cl, sp, size, h, doc_id) AS i, CAST('0x' || md5('mix/' || c.k)[1:5] AS BIGINT) / 1048576 AS u, CASE WHEN ss = 0 THEN 0.0 ELSE target / ss END AS rate FROM c JOIN t ON c.k = t.k)
SELECT doc_id, size, ss AS source_size, target, CAST((floor(u + rate * i) - floor(u + rate * (i - 1))) * size AS BIGINT) AS taken FROM g"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM again, unnest(range(i, i + 20)) AS v(j)),
words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_COMPONENTS = """reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_LOWER})")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON d.doc_id = least.a"""


def _rule(column: str) -> str:
    found = "NULL"
    for r in sorted(url_filter.RULES, key=lambda r: (len(r.pattern), r.pattern)):
        value = r.pattern if column == "rule" else r.verdict
        found = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value}' ELSE {found} END"
    return found


def _parts(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), ''), {_LOWER}) AS host, coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path"


_BARE = r"regexp_replace(regexp_replace(regexp_extract(url, '://([^#]*)', 1), '([?&])(?:utm_[a-z]+|ref)=[^&]*&?', '\1', 'g'), '[?&]+$', '')"
_CANONICAL = rf"'=' || regexp_replace(translate(regexp_extract(x, '^([^/?]*)', 1), {_LOWER}), '^www\.', '') || regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '(?:\.html?|/)$', '') || regexp_extract(x, '(\?.*)$', 1)"

URLS = rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(list_filter(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is'), lambda g: regexp_matches(g, 'rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh', 'i'))) AS g FROM pages WHERE contains(url, '://')),
told AS (SELECT url, regexp_extract(g, '(?:href|url)\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS alias FROM tags), urls AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT alias FROM told WHERE contains(alias, '://')),
forms AS (SELECT url, {_CANONICAL} AS alias FROM (SELECT url, {_BARE} AS x FROM urls)),
one AS (SELECT url AS a, alias AS b FROM told WHERE contains(alias, '://') UNION SELECT url, alias FROM forms), edges AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
known AS (SELECT url, {_rule('verdict')} AS v FROM (SELECT url, {_parts('url')} FROM urls)),
spread AS (SELECT a AS url FROM reach JOIN known ON b = known.url GROUP BY a HAVING bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), FALSE)),
p AS (SELECT page_id, url, {_parts('url')} FROM pages)
SELECT page_id, host, path, {_rule('rule')} AS rule, coalesce({_rule('verdict')}, CASE WHEN url IN (SELECT url FROM spread) THEN 'block' END, 'allow') AS verdict FROM p"""

#: Ways to insert before a row: state, state after, letters, added rows. And edits of a row that may stay: state, role, state after, letter, role, cost.
_INSERTS = "(0, 0, '', ''), (0, 2, 'I', 'u'), (0, 3, 'II', 'ua'), (1, 1, '', ''), (1, 2, 'I', 'u'), (1, 3, 'II', 'ua'), (2, 2, '', ''), (2, 3, 'I', 'a'), (3, 3, '', ''), (3, 2, 'I', 'u')"
_STAYS = "(0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0), (0, '', 2, 'R', 3), (1, '', 2, 'R', 3), (2, '', 3, 'R', 3), (3, '', 2, 'R', 3)"
_SHOWN = "replace(replace({}, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10))"

#: Costs, audits and texts of each conversation's first rows, by the state they leave, row by row.
REPAIR = rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (SELECT plain.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) % 20 AS way FROM plain, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(c)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM hurt),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM r),
g AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
ins(s, s2, le, added) AS (VALUES {_INSERTS}), stay(s, ini, s2, le, c) AS (VALUES {_STAYS}),
ops AS (SELECT conv_id, i, s, s2, le, c + CASE WHEN fault = 3 THEN 3 ELSE 0 END AS c, CASE WHEN le = 'K' THEN role WHEN s2 = 3 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) AS shown FROM f JOIN stay ON stay.ini IN (f.ini, '') WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, s, s, 'D', 4, '' FROM f, (VALUES (0), (1), (2), (3)) AS v(s)),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'shown': ''}} AS b FROM counts
  UNION ALL SELECT w.conv_id, w.i + 1, o.s2, min({{'cost': w.b.cost + 3 * length(ins.le) + o.c, 'audit': w.b.audit || ins.le || o.le, 'shown': w.b.shown || {_SHOWN.format("ins.added")} || o.shown}})
  FROM walk w JOIN ins ON ins.s = w.s JOIN ops o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 AND o.s = ins.s2 GROUP BY w.conv_id, w.i, o.s2),
done AS (SELECT w.conv_id, min({{'cost': w.b.cost + 3 * length(ins.le), 'audit': w.b.audit || ins.le, 'shown': w.b.shown || {_SHOWN.format("ins.added")}}}) AS b
  FROM walk w JOIN ins ON ins.s = w.s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE ins.s2 IN (0, 3) GROUP BY w.conv_id)
SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(d.b.cost, 0) AS cost, coalesce(d.b.audit, '') AS audit, sha256(CASE WHEN d.b.shown <> '' THEN d.b.shown[1:-2] ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM plain) p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM p.conv_id"""

ORACLE = {"op13_repair": REPAIR, "op1_url_filter": URLS, "op3_quality": QUALITY, "op5_substring": SUBSTRING, "op8_mixing": MIXING, "op9_itq": VECTORS, "op10_minmax": NEAR}
