"""SQL texts that give the rows of those queries that SQL can express.

The others are tested against brute force: tokenizers (1, 10), trained models (3, 7, 8), hashed draws
(4) and sketches (6) have no counterpart in SQL.
"""

from __future__ import annotations

from .urls import RULES, TRACKING

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(32)) AS gram FROM d, unnest(range(1, len(w) - 6)) r(i) WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
f AS (SELECT doc_id, lang, source, 'symbols' AS feature, CAST(floor(coalesce(greatest(n_symbols - 2 * sqrt(n_symbols), 0.0) * 10000 / nullif(word_chars, 0), 0)) AS BIGINT) AS v FROM b UNION ALL SELECT doc_id, lang, source, 'dup_lines', CAST(floor(coalesce(greatest(n_dup_lines - 2 * sqrt(n_dup_lines), 0.0) * 10000 / nullif(n_lines, 0), 0)) AS BIGINT) FROM b
 UNION ALL SELECT doc_id, lang, source, 'repeats', CAST(floor(coalesce(greatest(n_repeat_words - 2 * sqrt(n_repeat_words), 0.0) * 10000 / nullif(n_words, 0), 0)) AS BIGINT) FROM b UNION ALL SELECT doc_id, lang, source, 'word_length', coalesce(word_chars * 10000 // nullif(n_words, 0), 0) FROM b),
k AS (SELECT lang, source, feature, greatest(length(bin(v)) - 6, 0) * 32 + v // (1 << greatest(length(bin(v)) - 6, 0)) AS b FROM f JOIN (SELECT doc_id FROM b WHERE NOT base_failed) USING (doc_id)),
s AS (SELECT lang, source, feature, b, count(*) AS n FROM k GROUP BY ALL),
sl AS (SELECT lang, feature, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, feature) AS t FROM s GROUP BY lang, feature, b),
sa AS (SELECT feature, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY feature) AS t FROM s GROUP BY feature, b),
gr AS (SELECT DISTINCT lang, source, feature FROM s),
mg AS (SELECT lang, source, feature, b, sum(n) AS n FROM (SELECT lang, source, feature, b, n * 1000 AS n FROM s
 UNION ALL SELECT gr.lang, source, gr.feature, b, n * 30000 // t FROM gr JOIN sl ON gr.lang IS NOT DISTINCT FROM sl.lang AND gr.feature = sl.feature
 UNION ALL SELECT lang, source, feature, b, n * 10000 // t FROM gr JOIN sa USING (feature)) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, feature ORDER BY b) AS c, sum(n) OVER (PARTITION BY lang, source, feature) AS t FROM mg),
lv(feature, low, high, times) AS (VALUES ('symbols', 50, 90, 2), ('dup_lines', 95, 99, 1), ('repeats', 95, 99, 1), ('word_length', 25, 75, 8)),
q AS (SELECT lang, source, feature, times, min(CASE WHEN 100 * c >= low * t THEN b END) AS b1, min(CASE WHEN 100 * c >= high * t THEN b END) AS b3 FROM r JOIN lv USING (feature) GROUP BY ALL),
u AS (SELECT *, (b1 - greatest(b1 // 32 - 1, 0) * 32 + 1) * (1 << greatest(b1 // 32 - 1, 0)) - 1 AS q1, (b3 - greatest(b3 // 32 - 1, 0) * 32 + 1) * (1 << greatest(b3 // 32 - 1, 0)) - 1 AS q3 FROM q),
m AS (SELECT *, times * (q3 - q1) AS reach FROM (SELECT * EXCLUDE (q1), CASE WHEN b1 > 0 THEN (b1 - 1 - greatest((b1 - 1) // 32 - 1, 0) * 32 + 1) * (1 << greatest((b1 - 1) // 32 - 1, 0)) ELSE 0 END AS q1 FROM u)),
o AS (SELECT f.doc_id, max(f.v > m.q3 + m.reach OR (f.feature = 'word_length' AND f.v < m.q1 - m.reach)) AS over FROM f JOIN m ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source AND f.feature = m.feature GROUP BY f.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over, false) AS kept FROM b LEFT JOIN o USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], chr(32)) AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], chr(32)) AS g FROM d, (SELECT DISTINCT n FROM iw) s, unnest(range(1, len(w) - n + 2)) r(i) WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_TESTS = {"rule": [], "verdict": []}
for _verdict, _host, _path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
    _when = f"WHEN (host = '{_host}' OR ends_with(host, '.{_host}')) AND starts_with(path, '{_path}') THEN"
    _TESTS["rule"].append(f"{_when} '{_host}{_path}'")
    _TESTS["verdict"].append(f"{_when} '{_verdict}'")
OP9 = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {' '.join(_TESTS['rule'])} END AS rule, CASE {' '.join(_TESTS['verdict'])} END AS by_rule FROM u),
g AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
l AS (SELECT page_id, url, replace(trim(CASE WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
 WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>\s]*)', 1) END), '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin FROM g),
x AS (SELECT page_id, url AS target FROM pages UNION ALL SELECT page_id, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') AND origin <> '' THEN origin || t END FROM l),
q AS (SELECT page_id, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/$', '') AS base,
 array_to_string(list_filter(string_split(regexp_extract(target, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), '&') AS rest FROM x WHERE contains(target, '://')),
k AS (SELECT DISTINCT page_id, base || CASE WHEN coalesce(rest, '') = '' THEN '' ELSE '?' || rest END AS alias FROM q),
e AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM k a JOIN k b USING (alias)),
reach AS (SELECT page_id AS a, page_id AS b FROM pages UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS page_id, min(b) AS component, max(CASE WHEN by_rule = 'allow' THEN 1 ELSE 0 END) AS allowed, max(CASE WHEN by_rule = 'block' THEN 1 ELSE 0 END) AS blocked FROM reach JOIN r ON r.page_id = reach.b GROUP BY a)
SELECT r.page_id, host, path, rule, coalesce(by_rule, CASE WHEN blocked = 1 AND allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict, component FROM r JOIN c USING (page_id)
"""

#: Base32 of a SHA-1: eight times five hex digits as four digits of 32.
_BASE32 = "array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> s) & 31) + 1, 1)), '')), '')"
OP12 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS head FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN nth > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN nth > 1 THEN head END AS refers_to, true AS digest_holds FROM r
"""

#: CRC-32 bit by bit: a byte is mixed in, then -1 stands for a shift.
_CRC = "(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295))"
OP13 = rf"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
re AS (SELECT ids.c, 0 AS part, i, role, text FROM ids JOIN own ON own.c = ids.base AND i <= h UNION ALL SELECT ids.c, 1, i, role, text FROM ids JOIN own USING (c) WHERE i > h),
seq AS (SELECT ids.c, coalesce(s, []) AS s FROM ids LEFT JOIN (SELECT c, list(struct_pack(role := role, text := text) ORDER BY part, i) AS s FROM re GROUP BY c) q USING (c)),
m AS (SELECT c, d, s[1:d] AS k, len(s) = d AS ends FROM seq, unnest(range(0, len(s) + 1)) r(d)),
node AS (SELECT d, k, min(c) AS id, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256, CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].text, '[^ 	-
]+')) ELSE 0 END AS words FROM m GROUP BY d, k),
mem AS (SELECT c, d, id FROM m JOIN node USING (d, k)),
par AS (SELECT node.*, mem.id AS parent FROM node LEFT JOIN mem ON mem.c = node.id AND mem.d = node.d - 1),
kids AS (SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM par WHERE d > 0 GROUP BY ALL),
x AS (SELECT par.*, coalesce(n_children, 0) AS n_children FROM par LEFT JOIN kids ON kids.d = par.d AND kids.id = par.id),
below AS (SELECT mem.d, mem.id, sum((x.n - 1) * x.words)::BIGINT AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves FROM x JOIN mem ON mem.c = x.id AND mem.d <= x.d GROUP BY mem.d, mem.id)
SELECT x.id AS conv_id, x.d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN below ON below.d = x.d AND below.id = x.id
"""

ORACLE = {"op2_quality": OP2, "op5_decontaminate": OP5, "op9_urls": OP9, "op12_warc": OP12, "op13_trie": OP13}
