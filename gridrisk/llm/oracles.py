"""DuckDB SQL that gives the rows of the registered queries that SQL can express."""

from __future__ import annotations

from .license_rules import BASE, WEIGHTS, rules, widened

OP2 = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(url), 1, 7))::BIGINT % 360 AS INT) AS fetched,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1) AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
asked AS (
  SELECT DISTINCT url, fetched, unnest(list_distinct(list_concat(
    CASE WHEN regexp_matches(h, '^(\[|[0-9.]+$)') THEN [h]
         ELSE list_transform(range(1, greatest(1, len(string_split(h, '.')) - 1) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')) END,
    [h || path]))) AS pattern
  FROM captures WHERE h <> ''),
listed AS (SELECT DISTINCT pattern, CAST(('0x' || substr(md5(pattern), 1, 7))::BIGINT AS INT) AS k FROM asked),
raw AS (
  SELECT pattern, CASE WHEN k % 2 = 0 THEN 'block' ELSE 'allow' END AS action, DATE '2024-01-01' + k % 120 AS listed FROM listed WHERE k % 3 > 0
  UNION ALL SELECT pattern, CASE WHEN k % 5 < 3 THEN 'remove' ELSE 'block' END, DATE '2024-01-01' + (120 + k % 110) FROM listed WHERE k % 3 > 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + (230 + k % 200) FROM listed WHERE k % 3 > 0),
entries AS (SELECT pattern, listed, arg_max(action, CASE action WHEN 'remove' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM raw GROUP BY ALL),
spans AS (SELECT *, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS until FROM entries),
found AS (
  SELECT a.url, a.fetched, s.action, s.pattern, s.listed, row_number() OVER (PARTITION BY a.url, a.fetched ORDER BY length(s.pattern) DESC, s.pattern DESC) AS r
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND a.fetched >= s.listed AND (s.until IS NULL OR a.fetched < s.until)
  WHERE s.action <> 'remove')
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched_on, coalesce(f.action, 'none') AS verdict, f.pattern AS matched_pattern, strftime(f.listed, '%Y-%m-%d') AS listed_on
FROM captures c LEFT JOIN found f ON c.url = f.url AND c.fetched = f.fetched AND f.r = 1
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')) AS n_text,
         length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')) AS n_role,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS merged
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(7 + sum(n_text + CASE WHEN merged THEN 8 ELSE 7 + n_role + 2 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM h WHERE n > 1),
q AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM p GROUP BY r),
m AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN q USING (r)),
v AS (
  SELECT m.*, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
         unnest([CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END,
                 CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END]) AS x,
         unnest([100, 50, 100, 50]) AS least_spread
  FROM m),
b AS (SELECT *, x - x % (1 << greatest(0, length(bin(x)) - 7)) AS bucket FROM v WHERE n_words > 0),
s AS (
  SELECT lang, source, 2 AS level, metric, least_spread, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT lang, NULL, 1, metric, least_spread, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT NULL, NULL, 0, metric, least_spread, bucket, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM s),
f AS (
  SELECT level, lang, source, metric, max(total) AS n_texts, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3,
         greatest(q3 - q1, max(least_spread)) * 4 AS spread
  FROM c GROUP BY level, lang, source, metric),
k AS (
  SELECT a.lang, a.source, a.metric, a.n_texts AS n, l.n_texts AS m, a.q1 - a.spread AS low, a.q3 + a.spread AS high,
         (l.n_texts * (l.q1 - l.spread) + 100.0::DOUBLE * (z.q1 - z.spread)) / (l.n_texts + 100.0::DOUBLE) AS lang_low,
         (l.n_texts * (l.q3 + l.spread) + 100.0::DOUBLE * (z.q3 + z.spread)) / (l.n_texts + 100.0::DOUBLE) AS lang_high
  FROM f a JOIN f l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.metric = a.metric JOIN f z ON z.level = 0 AND z.metric = a.metric
  WHERE a.level = 2),
u AS (
  SELECT v.r, bool_and(coalesce(v.x <= (k.n * k.high + 100.0::DOUBLE * k.lang_high) / (k.n + 100.0::DOUBLE), true)
    AND (v.metric <> 'word_length' OR coalesce(v.x >= (k.n * k.low + 100.0::DOUBLE * k.lang_low) / (k.n + 100.0::DOUBLE), true))) AS within
  FROM v LEFT JOIN k ON k.lang IS NOT DISTINCT FROM v.lang AND k.source IS NOT DISTINCT FROM v.source AND k.metric = v.metric
  GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND within AS kept
FROM m JOIN u USING (r)
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ik AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM ik),
dk AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) x WHERE len(ws) >= n),
hits AS (SELECT r, k, n, item_id FROM (SELECT r, k, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM dk) x JOIN iw USING (n, w)),
inside AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM (SELECT DISTINCT r, k, n FROM hits) x),
covered AS (SELECT r, count(*) AS n_hit FROM inside GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) x GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^ \x09-\x0D]+') AS ws FROM documents),
k AS (SELECT r, ws, least(5, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + n - 1], ' ') AS g FROM k),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs p JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * p.n >= 80 * (a.n + b.n - p.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, edges.y FROM reach JOIN edges ON edges.x = reach.other)
SELECT d.doc_id, coalesce(max(sizes.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.other LEFT JOIN sizes ON sizes.r = d.r GROUP BY d.r, d.doc_id
"""

PLACES = " UNION ALL ".join(f"SELECT r, {k} AS k, '{label}' AS label, string_split(ws, '{widened(p)}') AS parts, {len(p.split())} AS size, n_words FROM n" for k, (p, label) in enumerate(BASE.items()))
COUNTED = "(length({0}) - length(replace({0}, ' ', ''))) // 2".format
OP12 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS t FROM documents),
w AS (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS ws FROM t),
n AS (SELECT *, {COUNTED("ws")} AS n_words FROM w),
places AS ({PLACES}),
based AS (
  SELECT r, label, len(parts) - 1 AS n, {COUNTED("parts[1]")} AS first, n_words - {COUNTED("parts[-1]")} - size AS last FROM places WHERE len(parts) > 1),
rule(id, label, keyword, priority, pattern) AS (VALUES {", ".join(f"({x.id}, '{x.label}', '{x.keyword}', {x.priority}, '{x.pattern}')" for x in rules())}),
hit AS (SELECT r, id, label, priority, string_split_regex(ws, pattern) AS parts, regexp_extract_all(ws, pattern) AS found FROM n JOIN rule ON contains(ws, ' ' || keyword || ' ') WHERE regexp_matches(ws, pattern)),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM hit),
sizes AS (SELECT r, id, label, priority, k, {COUNTED("parts[k]")} AS between, {COUNTED("found[k]")} AS size FROM each),
ends AS (SELECT *, sum(between + size) OVER (PARTITION BY r, id ORDER BY k) AS upto FROM sizes),
spans AS (SELECT r, id, label, priority, upto - size AS start, upto FROM ends),
kept AS (
  SELECT * FROM spans x WHERE NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.r = x.r AND y.start <= x.start AND y.upto >= x.upto
      AND (y.priority > x.priority OR y.priority = x.priority AND (y.upto - y.start > x.upto - x.start OR y.start = x.start AND y.upto = x.upto AND y.id < x.id)))),
weighed AS (
  SELECT r, label, CASE priority {" ".join(f"WHEN {p} THEN {v}" for p, v in WEIGHTS.items() if p != "base")} END AS weight FROM kept
  UNION ALL SELECT r, label, {WEIGHTS["base"]} FROM based),
best AS (SELECT r, label, max(weight) AS weight FROM weighed GROUP BY ALL),
labelled AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels, round(1 - product(1 - weight), 6) AS score FROM best GROUP BY r),
base AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels FROM based GROUP BY r),
counted AS (SELECT r, count(*) AS n_spans FROM kept GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM n LEFT JOIN base USING (r) LEFT JOIN labelled USING (r) LEFT JOIN counted USING (r)
"""

OP13 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents),
bits AS (
  SELECT r, s, 0 AS j, 4294967295::BIGINT AS c FROM d
  UNION ALL
  SELECT r, s, j + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT r, s, j, CASE WHEN j % 8 = 0 THEN xor(c, ascii(substr(s, j // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM bits WHERE j < 8 * length(s)) y),
hashed AS (SELECT r, xor(c, 4294967295::BIGINT) AS h FROM bits WHERE j = 8 * length(s)),
given AS (SELECT d.r, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS changed, h // 10 AS g FROM d LEFT JOIN hashed USING (r)),
placed AS (SELECT *, CASE WHEN changed THEN g % n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM given),
w AS (SELECT r, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM placed) x),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY ALL),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (r, i) GROUP BY r),
whole AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'start': start, 'length': length, 'period': period}, {'a': -length, 'b': start, 'c': period}) AS longest
  FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.start AS start, longest.length AS length, longest.period AS period, CAST(1000 * longest.length // longest.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM given LEFT JOIN whole USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL = {"op2_url_lists": OP2, "op6_chat_formatting": OP6, "op7_quality_rules": OP7, "op8_decontamination": OP8, "op9_jaccard_join": OP9, "op12_license_scans": OP12, "op13_periodic_runs": OP13}
