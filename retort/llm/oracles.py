"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from retort.llm import quality

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 16) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS ratio FROM t),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
  / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM r),
x AS (SELECT max(level) AS water FROM l WHERE ratio = (SELECT min(ratio) FROM l WHERE level <= ratio)),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), water * w) AS target FROM l, x),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS q, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS e,
  coalesce(CAST(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, e * size + greatest(0, least(size, q - e * source_size - before)) AS taken FROM p"""

_EACH = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{m}' AS m, CAST({reach} AS DOUBLE) AS reach, CAST({part} AS DOUBLE) / {whole} AS v, CAST({whole} AS DOUBLE) / {unit} AS size FROM c WHERE n_words > 0"
    for (m, (part, whole, unit)), reach in zip(quality.SHARES.items(), quality.REACH.values(), strict=True)
)



def _value(bucket: str) -> str:
    return f"CASE WHEN {bucket} = {quality.ZERO} THEN 0 ELSE pow({quality.GROWTH}, {bucket}) END"


OP7 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, n)) AS BIGINT) AS n FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS n FROM rep) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_shout, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
v AS ({_EACH}),
b AS (SELECT lang, source, m, reach, 'v' AS what, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {quality.math.log(quality.GROWTH)!r}) AS INT) ELSE {quality.ZERO} END AS b FROM v UNION ALL SELECT lang, source, m, reach, 'size', CAST(ceil(ln(size) / {quality.math.log(quality.GROWTH)!r}) AS INT) FROM v),
k AS (SELECT lang, source, m, reach, what, b, count(*) AS n FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m, what ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, m, what) AS alln FROM k),
q AS (SELECT lang, source, m, reach, what, min(CASE WHEN upto >= 0.25 * alln THEN b END) AS low, min(CASE WHEN upto >= 0.5 * alln THEN b END) AS mid, CAST(max(alln) AS DOUBLE) AS n FROM u GROUP BY ALL),
au AS (SELECT m, what, b, sum(n) OVER (PARTITION BY m, what ORDER BY b RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY m, what) AS alln FROM k),
aq AS (SELECT m, what, min(CASE WHEN upto >= 0.25 * alln THEN b END) AS all_low, min(CASE WHEN upto >= 0.5 * alln THEN b END) AS all_mid FROM au GROUP BY m, what),
w AS (SELECT lang, source, m, reach, what, n, {_value("low")} AS low, {_value("mid")} AS mid, {_value("all_low")} AS all_low, {_value("all_mid")} AS all_mid FROM q JOIN aq USING (m, what)),
pq AS (SELECT lang, source, m, reach, max((n * low + {quality.PRIOR_ROWS} * all_low) / (n + {quality.PRIOR_ROWS})) FILTER (what = 'v') AS low, max((n * mid + {quality.PRIOR_ROWS} * all_mid) / (n + {quality.PRIOR_ROWS})) FILTER (what = 'v') AS mid,
  max((n * mid + {quality.PRIOR_ROWS} * all_mid) / (n + {quality.PRIOR_ROWS})) FILTER (what = 'size') AS size FROM w GROUP BY ALL),
f AS (SELECT lang, source, m, greatest(mid + reach * (mid - low), pow(sqrt(mid * size) + {quality.ERRORS / 2}, 2) / size) AS fence FROM pq),
o AS (SELECT DISTINCT v.doc_id FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.m = f.m WHERE pow(greatest(sqrt(v.v * v.size) - {quality.ERRORS / 2}, 0), 2) / v.size > fence),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM y"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id"""

#: Bytes are pairs of hexadecimal digits here.
OP11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, i) > 1),
e AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS f, max(i) + 100 AS t FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e) GROUP BY doc_id, g),
p AS (SELECT doc_id, f, t, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY f), 0) AS since FROM g),
k AS (SELECT p.doc_id, count(*) AS n_spans, CAST(sum(t - f) AS BIGINT) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (f - since)), '' ORDER BY f) || substr(any_value(x), 2 * max(t) + 1) AS x FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: CRC-32 of an ASCII text as DuckDB lacks it: each character is mixed in, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP12 = f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN {_CRC.format("CAST(doc_id AS VARCHAR)")} ELSE 1 END AS h, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a, len(w) AS n, w FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
e AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM p),
four AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 4], ' ')) AS s FROM (SELECT doc_id, n, w, unnest(range(n - 3)) AS i FROM e WHERE n >= 6)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM four a JOIN four b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
f AS (SELECT doc_id, q, min(i) AS start, count(*) + q + 3 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM f WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS x FROM r GROUP BY doc_id),
b AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(e.w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM e WHERE doc_id IN (SELECT doc_id FROM r)) e ANTI JOIN b USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, x.s AS start, x.l AS length, x.p AS period, 1000 * x.l // x.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS collapsed_sha256
FROM e LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)"""

_H13 = _CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
#: For each state, the ways in which inserted turns lead on: edits, lines, state after them and cost. States are 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_INSERTS = """(VALUES (0, '', '', 0, 0), (1, '', '', 1, 0), (2, '', '', 2, 0), (3, '', '', 3, 0), (0, 'I', chr(10) || 'user:', 2, 2), (1, 'I', chr(10) || 'user:', 2, 2), (2, 'I', chr(10) || 'assistant:', 3, 2), (3, 'I', chr(10) || 'user:', 2, 2),
  (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3, 4), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3, 4), (3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3, 4)) i(before, ins, made, state, c)"""
_ACTS = """(VALUES (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3), (0, 'R', 'user', 2, 2), (1, 'R', 'user', 2, 2), (2, 'R', 'assistant', 3, 2), (3, 'R', 'user', 2, 2),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)) a(before, act, new, state, c)"""

OP13 = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_H13} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM d),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (was IS NOT NULL AND was[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
w(conv_id, i, state, cost, audit, lines) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM conversations
  UNION ALL SELECT conv_id, i, state, best[1].cost, best[1].audit, best[1].lines FROM (
    SELECT w.conv_id, f.i, a.state, list({{'cost': w.cost + i.c + a.c + CASE WHEN fault = 'truncated' AND act <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || ins || act,
      'lines': w.lines || made || CASE act WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || new || ':' || text END}} ORDER BY w.cost + i.c + a.c + CASE WHEN fault = 'truncated' AND act <> 'D' THEN 1 ELSE 0 END, w.audit || ins || act) AS best
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN {_INSERTS} ON i.before = w.state JOIN {_ACTS} ON a.before = i.state
    WHERE act = 'D' OR fault NOT IN ('blank', 'duplicate') AND (act = 'R' OR role[1] = new) GROUP BY w.conv_id, f.i, a.state)),
e AS (SELECT w.conv_id, w.cost + i.c AS cost, audit || ins AS audit, lines || made AS lines FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN {_INSERTS} ON i.before = w.state WHERE w.i = coalesce(c.n, 0) AND i.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.c, audit || ins) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.cost, e.audit, sha256(substr(e.lines, 2)) AS repaired_sha256 FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

ORACLES = {"op3_source_mixing": OP3, "op7_quality_rules": OP7, "op8_near_duplicates": OP8, "op11_repeated_passages": OP11, "op12_periodic_runs": OP12, "op13_conversation_repair": OP13}
