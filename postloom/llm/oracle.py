"""DuckDB SQL that must agree with the operators it can express, on small tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x09-\x0D ]+'), lambda x: x <> '')"

WINNOWING = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    unnest(list_transform(range(0, len(w) - least(13, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(13, len(w))], ' '))) AS s
  FROM b WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i,
    unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN strlen(p.h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.h) >= 1000 AND page_id <> top THEN top END AS refers_to, url, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN m ON p.h = m.h
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(0, len(w) - least(5, len(w)) + 1),
    lambda i: array_to_string(w[i + 1 : i + least(5, len(w))], ' ') || '#' || least(5, len(w))))) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id <= coalesce(low, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM w JOIN d USING (doc_id)),
again AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM k SEMI JOIN again USING (s)),
marked AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 200 AS fresh FROM hit),
runs AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, run),
cut AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS was FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed,
    string_agg(substr(h, 2 * was + 1, 2 * (s - was)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS rest
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

# Fixed value: the CRC-32 polynomial, bits reversed; the bits of a byte come in from the lowest.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1),
  lambda i: list_transform(range(0, 8), lambda b: (ascii(substring(s, i, 1)) >> b) & 1)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""

PERIODIC = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, CAST({_CRC} AS BIGINT) AS h FROM d),
a AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
raw AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM p),
x AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(range(0, n)) AS i, a, p FROM p) t
  JOIN (SELECT doc_id, i AS o, word FROM raw) r USING (doc_id) WHERE o = CASE WHEN i < a THEN i ELSE a + (i - a) % p END),
factor(size, doc_id, i, name) AS (
  SELECT CAST(1 AS BIGINT), doc_id, i, md5(word) FROM x
  UNION ALL
  SELECT 2 * size, doc_id, i, md5(name || half) FROM (
    SELECT size, doc_id, i, name, lead(name, CAST(size AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS half FROM factor)
  WHERE half IS NOT NULL),
step AS (SELECT size, doc_id, i, lead(i) OVER (PARTITION BY size, doc_id, name ORDER BY i) - i AS q FROM factor),
near AS (SELECT *, i - row_number() OVER (PARTITION BY size, doc_id, q ORDER BY i) AS island FROM step WHERE 2 * q > size AND q <= size),
run AS (
  SELECT DISTINCT doc_id, min(i) AS start, max(i) - min(i) + size + q AS length, q AS period FROM near
  GROUP BY size, doc_id, q, island HAVING max(i) - min(i) + size + q >= greatest(6, 4 * q)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM run),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op12_periodic_runs": PERIODIC, "op4_winnowing": WINNOWING, "op5_warc": WARC, "op6_minhash": MINHASH, "op7_bucket_refine": REPEATS}
