"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM t),
pos AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM pos),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, [l FOR l IN ls IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls FROM w),
base AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines.ls) - len(list_distinct(lines.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines.ls) AS BIGINT) AS n_lines
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
m AS (
  SELECT r, lang, source, base_failed, rule, CASE rule WHEN 'symbols' THEN n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) WHEN 'dup_lines' THEN n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE)
    WHEN 'repeats' THEN n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) WHEN 'word_length' THEN word_chars / CAST(greatest(n_words, 1) AS DOUBLE) WHEN 'words' THEN CAST(n_words AS DOUBLE) ELSE CAST(greatest(n_lines, 1) AS DOUBLE) END AS v
  FROM judged, (VALUES ('symbols'), ('dup_lines'), ('repeats'), ('word_length'), ('words'), ('lines')) AS x(rule)),
b AS (SELECT lang, source, rule, CASE WHEN v < 1e-6 THEN -100000 ELSE CAST(ceil(ln(v) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INT) END AS bucket FROM m WHERE NOT base_failed),
k AS (
  SELECT 's' AS lvl, lang, source, rule, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL
  SELECT 'l', lang, NULL, rule, bucket, count(*) FROM b GROUP BY ALL UNION ALL
  SELECT 'c', NULL, NULL, rule, bucket, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, rule) AS docs FROM k),
q AS (
  SELECT lvl, lang, source, rule, docs, min(bucket) FILTER (WHERE upto >= 0.25 * docs) AS b25, min(bucket) FILTER (WHERE upto >= 0.5 * docs) AS b50, min(bucket) FILTER (WHERE upto >= 0.75 * docs) AS b75 FROM c GROUP BY ALL),
v AS (
  SELECT *, CASE WHEN b25 = -100000 THEN 0.0 ELSE 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b25) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END AS low, CASE WHEN b50 = -100000 THEN 0.0 ELSE 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b50) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END AS mid,
    CASE WHEN b75 = -100000 THEN 0.0 ELSE 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b75) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END AS high FROM q),
f AS (
  SELECT v.lvl, v.lang, v.source, v.rule, v.docs, v.mid + 8.0 * greatest(v.mid - v.low, x.occurrence / z.mid) AS fence, CASE WHEN v.rule = 'word_length' THEN v.mid - 8.0 * greatest(v.high - v.mid, x.occurrence / z.mid) ELSE 0.0 END AS floor
  FROM v JOIN (VALUES ('symbols', 'words', 1.0::DOUBLE), ('dup_lines', 'lines', 0.5::DOUBLE), ('repeats', 'words', 6.0::DOUBLE), ('word_length', 'words', 20.0::DOUBLE)) AS x(rule, size, occurrence) ON x.rule = v.rule
  JOIN v z ON z.rule = x.size AND z.lvl = v.lvl AND z.lang IS NOT DISTINCT FROM v.lang AND z.source IS NOT DISTINCT FROM v.source),
verdict AS (
  SELECT m.r, bool_and(m.v <= coalesce(s.fence, l.fence, c.fence, m.v) AND m.v >= coalesce(s.floor, l.floor, c.floor, 0.0)) AS inside FROM m
  LEFT JOIN f s ON s.lvl = 's' AND s.docs >= 50 AND s.rule = m.rule AND s.lang IS NOT DISTINCT FROM m.lang AND s.source IS NOT DISTINCT FROM m.source
  LEFT JOIN f l ON l.lvl = 'l' AND l.docs >= 50 AND l.rule = m.rule AND l.lang IS NOT DISTINCT FROM m.lang
  LEFT JOIN f c ON c.lvl = 'c' AND c.rule = m.rule WHERE m.rule NOT IN ('words', 'lines') GROUP BY m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM judged JOIN verdict USING (r)
"""

OP9 = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said FROM d GROUP BY conv_id),
u AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY said),
p AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM u)),
kept AS (SELECT u.* FROM u LEFT JOIN p ON u.said = p.said WHERE p.said IS NULL)
SELECT conv_id, CAST(len(said) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
  list_aggregate(['<|' || coalesce(s.role, '') || '|>' || chr(10) || coalesce(s.text, '') || chr(10) FOR s IN said], 'string_agg', '') AS chat
FROM kept
"""

OP2 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, url FROM f
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || x[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1 : a] || '<S>' || t[b + 1 :] || '<M>' || t[a + 1 : b] ELSE '<S>' || t[b + 1 :] || '<P>' || t[1 : a] || '<M>' || t[a + 1 : b] END AS output FROM c),
r AS (SELECT *, CASE form WHEN 'plain' THEN [output, '', ''] WHEN 'psm' THEN string_split(replace(replace(output[4:], '<S>', '<M>'), '<P>', ''), '<M>') ELSE string_split(replace(replace(output[4:], '<P>', '<M>'), '<S>', ''), '<M>') END AS q FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN q[1] || q[3] || q[2] ELSE q[2] || q[3] || q[1] END) AS restored_sha256 FROM r
"""



def _plus(cost: str, way: str, initial: str) -> str:
    """A way, its cost in ten digits and then its audit, with one edit more; null where there is none."""
    return f"lpad(CAST(CAST(left({way}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({way}, 11) || '{initial}'"


def _inserted(a: str) -> str:
    """The four ways of struct `a`, with inserted rows where these are better."""
    once = f"{{'o': {a}.o, 's': {a}.s, 'u': least({a}.u, {_plus('2', a + '.o', 'I')}, {_plus('2', a + '.s', 'I')}, {_plus('2', a + '.a', 'I')}), 'a': {a}.a, 'x': NULL::STRUCT(r VARCHAR, f BIGINT)}}"
    return f"list_transform([{once}], lambda q: {{'o': q.o, 's': q.s, 'u': q.u, 'a': least(q.a, {_plus('2', 'q.u', 'I')}), 'x': q.x}})[1]"


def _through() -> str:
    """The four ways of b after row z: kept, reroled or deleted."""
    soft = "CASE WHEN z.f = 3 THEN 1 ELSE 0 END"
    step = lambda way, role, gets: f"CASE WHEN z.f IN (0, 3) THEN CASE WHEN z.r = '{role}' THEN {_plus(soft, way, 'K')} ELSE {_plus('2 + ' + soft, way, 'R')} END END" if gets else "NULL"
    return (
        f"{{'o': {_plus('3', 'b.o', 'D')}, 's': least({_plus('3', 'b.s', 'D')}, CASE WHEN z.r = 's' AND z.f IN (0, 3) THEN {_plus(soft, 'b.o', 'K')} END), "
        f"'u': least({_plus('3', 'b.u', 'D')}, {step('b.o', 'u', 1)}, {step('b.s', 'u', 1)}, {step('b.a', 'u', 1)}), 'a': least({_plus('3', 'b.a', 'D')}, {step('b.u', 'a', 1)}), 'x': NULL::STRUCT(r VARCHAR, f BIGINT)}}"
    )


OP13 = rf"""
WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
b AS (SELECT * EXCLUDE (k), [CAST('0x' || hex(k)[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(octet_length(k))] AS bytes FROM d),
h AS (SELECT * EXCLUDE (bytes), xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, y: list_reduce(list_concat([xor(c, y)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind FROM b),
m AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END::BIGINT AS f FROM p),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal, list({{'r': r, 'f': f}} ORDER BY n) AS rows, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts FROM f GROUP BY conv_id),
w AS (
  SELECT *, list_reduce(list_concat([{{'o': '0000000000', 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR, 'x': NULL::STRUCT(r VARCHAR, f BIGINT)}}],
    [{{'o': NULL::VARCHAR, 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR, 'x': x}} FOR x IN rows]),
    lambda acc, row: list_transform([{{'b': {_inserted('acc')}, 'z': row.x}}], lambda y: list_transform([y.b], lambda b: list_transform([y.z], lambda z: {_through()})[1])[1])[1]) AS ways FROM g),
e AS (SELECT *, {_inserted('ways')} AS final FROM w),
a AS (SELECT *, CAST(left(least(final.o, final.a), 10) AS BIGINT) AS cost, substr(least(final.o, final.a), 11) AS audit FROM e),
s AS (
  SELECT *, list_reduce(list_concat([{{'i': 1::BIGINT, 'st': '', 'out': []::VARCHAR[], 'c': ''}}], [{{'i': 0::BIGINT, 'st': '', 'out': []::VARCHAR[], 'c': c}} FOR c IN string_split(audit, '') IF c <> '']),
    lambda q, y: CASE y.c WHEN 'D' THEN {{'i': q.i + 1, 'st': q.st, 'out': q.out, 'c': ''}}
      WHEN 'K' THEN {{'i': q.i + 1, 'st': left(roles[q.i], 1), 'out': list_append(q.out, roles[q.i] || ':' || texts[q.i]), 'c': ''}}
      WHEN 'R' THEN {{'i': q.i + 1, 'st': CASE q.st WHEN 'u' THEN 'a' ELSE 'u' END, 'out': list_append(q.out, CASE q.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END || texts[q.i]), 'c': ''}}
      ELSE {{'i': q.i, 'st': CASE q.st WHEN 'u' THEN 'a' ELSE 'u' END, 'out': list_append(q.out, CASE q.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END), 'c': ''}} END).out AS said FROM a)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES = {"op11_middles": OP11, "op13_repairs": OP13, "op1_quality": OP1, "op2_archives": OP2, "op9_chats": OP9}
