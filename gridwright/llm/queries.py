"""Registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from gridwright.llm.chat_format import op7_preference_format
from gridwright.llm.decontam import op1_decontamination
from gridwright.llm.langid import op8_language_id
from gridwright.llm.license_scan import op3_license_scan
from gridwright.llm.matroska import op5_matroska
from gridwright.llm.mixing import op10_source_mixing
from gridwright.llm.near_dedup import op4_near_dedup
from gridwright.llm.pii import op9_pii
from gridwright.llm.sharding import op2_sharding
from gridwright.llm.urlfilter import RULES, op6_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_matroska": op5_matroska,
    "op6_url_filter": op6_url_filter,
    "op7_preference_format": op7_preference_format,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_source_mixing": op10_source_mixing,
}

# CRC-32 is computed byte by byte: DuckDB has no function for it.
_OP2 = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT] || range(8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (
  SELECT doc_id, size, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT) AS bytes FROM d),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8))) AS text_crc32 FROM b, tab),
s AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(size) OVER ())::BIGINT AS total FROM c),
p AS (
  SELECT *, least(((2 * start + size) * 24) // (2 * total), 23)::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot,
       NULL::INT AS grown_shard
FROM p
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS ss FROM w WHERE len(ws) > 0),
u AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (
  SELECT w.doc_id, coalesce(len(ss), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""

_RULE_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

_OP6 = f"""
WITH rules(v, rh, rp) AS (VALUES {_RULE_VALUES}),
p AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, n,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
m AS (
  SELECT n, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM h LEFT JOIN m ON h.n = m.n AND k = 1
"""

_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, (min({'role': role, 'text': text})) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (
  SELECT conv_id, max(turn) AS last_turn, max({'turn': turn, 'text': coalesce(text, '')}).text AS reply FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
p AS (
  SELECT l.conv_id, l.last_turn, o.reply AS wrong FROM l LEFT JOIN l o ON o.conv_id = xor(l.conv_id, 1::BIGINT)),
b AS (
  SELECT t.conv_id AS pair_id, turn, coalesce(s.role, 'unknown') AS role, coalesce(s.text, '') AS c,
         CASE WHEN turn = last_turn THEN coalesce(wrong, '') ELSE coalesce(s.text, '') END AS r
  FROM t LEFT JOIN p ON t.conv_id = p.conv_id WHERE last_turn IS NULL OR turn <= last_turn),
cut AS (
  SELECT pair_id, min(turn) FILTER (WHERE c <> r) AS cut FROM b GROUP BY pair_id),
x AS (
  SELECT b.pair_id, turn, turn // 4096 AS part, cut IS NULL OR turn < cut AS common, role = 'assistant' AS train,
         '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
         replace(c, '<|', '< |') || '<|im_end|>' AS cb, replace(r, '<|', '< |') || '<|im_end|>' AS rb
  FROM b JOIN cut ON b.pair_id = cut.pair_id),
y AS (
  SELECT *, head || cb || chr(10) AS cs, head || rb || chr(10) AS rs,
         coalesce(sum(CASE WHEN common THEN 0 ELSE length(head || cb) + 1 END) OVER w, 0)::BIGINT AS ca,
         coalesce(sum(CASE WHEN common THEN 0 ELSE length(head || rb) + 1 END) OVER w, 0)::BIGINT AS ra
  FROM x WINDOW w AS (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, part, count(*) FILTER (WHERE common)::INT AS prompt_turns,
       coalesce(string_agg(cs, '' ORDER BY turn) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(cs, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS chosen,
       coalesce(string_agg(rs, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS rejected,
       coalesce(string_agg((ca + length(head)) || ':' || (ca + length(head) + length(cb)), ',' ORDER BY turn) FILTER (WHERE NOT common AND train), '') AS chosen_mask,
       coalesce(string_agg((ra + length(head)) || ':' || (ra + length(head) + length(rb)), ',' ORDER BY turn) FILTER (WHERE NOT common AND train), '') AS rejected_mask
FROM y GROUP BY pair_id, part
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM t),
w AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size / ((rank - 1) % 3 + 1)::DOUBLE AS f FROM r),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY f, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY f, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lv FROM w),
g AS (
  SELECT *, least(weight * coalesce((SELECT min_by(lv, f) FROM l WHERE lv <= f), 0.0), (3 * source_size)::DOUBLE) AS target FROM l),
q0 AS (
  SELECT *, ceil((sum(source_size) OVER ())::BIGINT / 8)::BIGINT AS seats, sum(target) OVER () AS v FROM g),
q1 AS (
  SELECT *, CASE WHEN v > 0 THEN floor(target * seats / v + 0.5)::BIGINT ELSE 0 END AS q FROM q0),
q2 AS (
  SELECT *, CASE WHEN v > 0 THEN seats - (sum(q) OVER ())::BIGINT ELSE 0 END AS delta FROM q1),
q3 AS (
  SELECT rank, k, delta, CASE WHEN delta > 0 THEN q + k ELSE q - k + 1 END AS seat, target FROM q2, range(1, 200) AS x(k) WHERE delta <> 0 AND target > 0 AND k <= abs(delta)),
q4 AS (
  SELECT rank, delta, row_number() OVER (ORDER BY CASE WHEN delta > 0 THEN -target / (2 * seat - 1) ELSE target / (2 * seat - 1) END, rank * sign(delta), k) AS n FROM q3 WHERE seat > 0),
q AS (
  SELECT source, rank, source_size, target, greatest(1, ceil(n / 4096))::BIGINT AS shards,
         q + sign(delta)::BIGINT * coalesce((SELECT count(*) FROM q4 WHERE q4.rank = q2.rank AND q4.n <= abs(q4.delta)), 0) AS want FROM q2),
o AS (
  SELECT d.doc_id, d.size, d.copy, q.*, md5('7:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size || ':' || d.copy) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM d) d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % shards AS cell FROM o),
c0 AS (
  SELECT rank, cell, any_value(want) AS want, sum(size)::BIGINT AS cs FROM e GROUP BY rank, cell),
c1 AS (
  SELECT *, (sum(cs) OVER (PARTITION BY rank))::DOUBLE AS v FROM c0),
c2 AS (
  SELECT *, CASE WHEN v > 0 THEN floor(cs::DOUBLE * want / v + 0.5)::BIGINT ELSE 0 END AS q FROM c1),
c3 AS (
  SELECT *, CASE WHEN v > 0 THEN want - (sum(q) OVER (PARTITION BY rank))::BIGINT ELSE 0 END AS delta FROM c2),
c4 AS (
  SELECT rank, cell, k, delta, CASE WHEN delta > 0 THEN q + k ELSE q - k + 1 END AS seat, cs FROM c3, range(1, 200) AS x(k) WHERE delta <> 0 AND cs > 0 AND k <= abs(delta)),
c5 AS (
  SELECT rank, cell, delta, row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN delta > 0 THEN -cs::DOUBLE / (2 * seat - 1) ELSE cs::DOUBLE / (2 * seat - 1) END, cell * sign(delta), k) AS n FROM c4 WHERE seat > 0),
c AS (
  SELECT rank, cell, cs, least(8 * (q + sign(delta)::BIGINT * coalesce((SELECT count(*) FROM c5 WHERE c5.rank = c3.rank AND c5.cell = c3.cell AND c5.n <= abs(c5.delta)), 0)), 3 * cs)::BIGINT AS words FROM c3),
f AS (
  SELECT e.*, cs, words, coalesce(sum(size) OVER (PARTITION BY e.rank, e.cell ORDER BY substr(h, 9, 24), doc_id NULLS FIRST, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM e JOIN c ON e.rank = c.rank AND e.cell = c.cell)
SELECT doc_id, size, source_size, target,
       CASE WHEN cs > 0 THEN (words // cs) * size + greatest(0, least(size, words % cs - before)) ELSE 0 END::BIGINT AS taken
FROM f
"""

ORACLE_SQL = {
    "op2_sharding": _OP2,
    "op4_near_dedup": _OP4,
    "op6_url_filter": _OP6,
    "op7_preference_format": _OP7,
    "op10_source_mixing": _OP10,
}
