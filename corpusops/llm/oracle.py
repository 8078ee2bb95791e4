"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

# Links on full shingle sets of four words, then the smallest id reachable.
OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
), hashed AS (SELECT doc_id, hash(s) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM hashed GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM hashed a JOIN hashed b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
found AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN found f ON f.node = d.doc_id
"""

OP6 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS crc_of FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
    FROM (SELECT unnest(range(256)) AS n))
), rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS src, strlen(coalesce(text, '')) + 1 AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h, count(*) OVER (PARTITION BY coalesce('s' || source, '-')) AS n,
    coalesce(text, '') AS body
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) AS place FROM rows_
), fractions AS (
  SELECT *, (place - 1 + ('0x' || substr(md5('17/' || src), 1, 6))::BIGINT / 16777216) / n AS fraction FROM ranked
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, src, place) - 1 AS position, count(*) OVER () AS total FROM fractions
)
SELECT doc_id, source, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32, 'rows' AS law, (position * 16 // total)::INTEGER AS shard,
  position - ((position * 16 // total) * total + 15) // 16 AS slot, NULL::INTEGER AS grown_shard
FROM placed CROSS JOIN crc_table
"""

OP8 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS t
  FROM items WHERE len(w) > 0
), spots AS (
  SELECT d.doc_id, z.size, unnest(range(1, len(d.w) - z.size + 2)) AS p, d.w
  FROM docs d CROSS JOIN (SELECT DISTINCT size FROM windows) z
), hits AS (
  SELECT DISTINCT s.doc_id, s.p, s.size, x.item_id
  FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS t FROM spots) s JOIN windows x ON x.t = s.t AND x.size = s.size
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(len(n.items), 0) AS n_items,
  sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][number % 3 + 1]::BIGINT AS w, sum(words) OVER ()::BIGINT AS all_words FROM sources
), filled AS (
  -- Smallest room per weight first: sources are full up to the first that is not.
  SELECT *, 3 * all_words - 4 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w
  FROM weighed WINDOW o AS (ORDER BY words * 2.0 / w, number)
), marked AS (
  SELECT *, w * room > 2 * open_w * 2 * words AS is_full FROM filled
), level AS (
  SELECT 3 * max(all_words) - 4 * coalesce(sum(words) FILTER (is_full), 0)::BIGINT AS left_over, coalesce(sum(w) FILTER (NOT is_full), 1)::BIGINT AS open_w FROM marked
), targets AS (
  SELECT m.source, number, words, greatest(1, n // 256) AS blocks, CASE WHEN is_full THEN 2 * words ELSE w * l.left_over END AS num,
    CASE WHEN is_full THEN 1 ELSE 2 * l.open_w END AS den
  FROM marked m, level l
), planned AS (
  SELECT *, num / den AS target, CASE WHEN words > 0 THEN num // (den * words) ELSE 0 END AS passes FROM targets
), rest AS (
  SELECT *, (num - passes * den * words) / den AS rest FROM planned
), placed AS (
  SELECT d.*, r.number, r.words, r.target, r.passes, r.rest, ('0x' || substr(h, 1, 8))::BIGINT % r.blocks AS block
  FROM sized d JOIN rest r ON r.source IS NOT DISTINCT FROM d.source
), blocks AS (
  SELECT number, block, passes, any_value(rest) AS rest, sum(size)::BIGINT AS words, md5('29/' || number || '/' || passes || '/' || block) AS o
  FROM placed GROUP BY number, block, passes
), drawn AS (
  SELECT number, block, words, sum(words) OVER (PARTITION BY number ORDER BY o, block) - words AS before FROM blocks
), cut AS (
  SELECT p.number, p.block, p.h, d.before + sum(p.size) OVER (PARTITION BY p.number, p.block ORDER BY p.h) - p.size / 2 <= p.rest AS inside
  FROM placed p JOIN drawn d ON d.number = p.number AND d.block = p.block AND d.before < p.rest AND d.before + d.words > p.rest
), last_one AS (
  SELECT number, block, max(h) FILTER (inside) AS h FROM cut GROUP BY ALL
)
SELECT p.doc_id, p.source, p.size, p.words AS source_size, p.target,
  p.size * (p.passes + CASE WHEN d.before >= p.rest THEN 0 WHEN d.before + d.words <= p.rest THEN 1 WHEN p.h <= l.h THEN 1 ELSE 0 END) AS taken
FROM placed p JOIN drawn d ON d.number = p.number AND d.block = p.block LEFT JOIN last_one l ON l.number = p.number AND l.block = p.block
"""

OP11 = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masked AS (
  SELECT b.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
      + 16 * coalesce((b.doc_id > min(b.doc_id) OVER (PARTITION BY t))::INTEGER, 0) AS mask
  FROM base b LEFT JOIN marks m ON m.doc_id = b.doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters d ON d.c <> a.c AND d.c <> b.c
  JOIN letters e ON e.c <> a.c AND e.c <> b.c AND e.c <> d.c JOIN letters f ON f.c <> a.c AND f.c <> b.c AND f.c <> d.c AND f.c <> e.c
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65))::INTEGER AS bit,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders)
), flagged AS (
  SELECT filter_order, step, letter, bit, coalesce(before, 0)::INTEGER AS before FROM steps
), summed AS (
  SELECT c.part, s.filter_order, s.step, any_value(s.letter) AS letter,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counted c CROSS JOIN flagged s GROUP BY c.part, s.filter_order, s.step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""

OP13 = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS crc_of FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
    FROM (SELECT unnest(range(256)) AS n))
), split_ AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM documents CROSS JOIN crc_table
), chosen AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS d FROM split_
), words AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w
  FROM chosen
), each AS (
  SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM words
), equal_ AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM each a JOIN each b ON b.doc_id = a.doc_id AND b.x = a.x AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal_) GROUP BY doc_id, q, g
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), lines AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM runs) WHERE place = 1
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN dropped d ON d.doc_id = e.doc_id AND d.i = e.i WHERE d.i IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  ((1000 * b.length) // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM words w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN best b ON b.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

ORACLE = {
    "op5_superminhash": OP5,
    "op6_stratified_shards": OP6,
    "op8_prefix_join": OP8,
    "op9_mixture_tree": OP9,
    "op11_text_tries": OP11,
    "op13_cover_runs": OP13,
}
