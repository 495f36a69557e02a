"""The SQL each registered query must agree with, in DuckDB's dialect.

Patterns are RE2: ``\\b`` and ``\\w`` are ASCII there, so word boundaries are
spelled out with Unicode classes.
"""

W = r"[^\p{L}\p{N}_]"

POSTINGS = r"""
postings AS (
  SELECT doc_id AS arrival,
         CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'A' ELSE 'B' END AS layout,
         regexp_extract(text, '^[^.,|\n]*') AS title,
         CASE WHEN source = 'src7' THEN NULL WHEN source = 'src13' THEN ''
              ELSE 'https://jobs.test/job/' || CAST(doc_id * 7 // 10 AS VARCHAR) END AS url,
         CASE WHEN source = 'src11' THEN 'N/A' ELSE lang END AS company,
         text AS description,
         CASE WHEN source = 'src5' THEN ' ' ELSE '$' || CAST(n_chars AS VARCHAR) END AS salary,
         CAST(NULL AS VARCHAR) AS qualifications,
         '2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS scraped_at
  FROM documents)"""

# one blank between words, none at the ends (the data has no other blanks)
def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _whole_word(x: str, words: str) -> str:
    """Delete whole words; twice, as neighbours share their separator."""
    once = lambda y: rf"regexp_replace({y}, '(^|{W})({words})({W}|$)', '\1 \3', 'g')"
    return once(once(x))


def _norm(x: str) -> str:
    x = f"lower({x})"
    x = rf"regexp_replace({x}, '\(.*?\)', ' ', 'g')"
    x = rf"regexp_replace({x}, '\[.*?\]', ' ', 'g')"
    x = _whole_word(x, r"[a-z]*\p{Nd}{3,}")
    x = rf"regexp_replace({x}, '[/|,;:\-–—]+', ' ', 'g')"
    x = _whole_word(x, "i|ii|iii|iv|v")
    return _collapse(x)


NORMED = POSTINGS + f""",
normed AS (SELECT *, {_norm('title')} AS title_norm FROM postings)"""

TITLED = NORMED + rf""",
titled AS (
  SELECT *, CASE
    WHEN regexp_matches(title_norm, '(^|{W})the({W}.*{W}|{W})of({W}|$)') THEN 'Of The'
    WHEN regexp_matches(title_norm, '(^|{W})(the|thé)({W}|$)') THEN 'The'
    WHEN regexp_matches(title_norm, '(^|{W})(le|la|les)({W}|$)') THEN 'Le'
    WHEN regexp_matches(title_norm, '(^|{W})(der|die|und)({W}|$)') THEN 'Der'
    ELSE title_norm END AS title_updated
  FROM normed)"""

TIER = """CASE WHEN contains(lower(title), 'ist') THEN 'REJECT'
     WHEN contains(lower(title), 'the ') THEN 'KEEP_IMMEDIATE'
     WHEN contains(lower(title), 'that') OR contains(lower(title), 'er ') THEN 'CHECK_DESCRIPTION'
     ELSE 'SKIP' END"""


def _missing(x: str) -> str:
    return f"(coalesce(lower(trim({x})), '') IN ('', 'n/a', 'na', 'none', 'null'))"


SCREENED = POSTINGS + f""",
tiered AS (
  SELECT *, {TIER} AS tier,
    CASE WHEN {_missing('title')} THEN 'missing_title'
         WHEN layout = 'A' AND {_missing('url')} THEN 'missing_url'
         WHEN {_missing('company')} THEN 'missing_company' END AS missing,
    CASE WHEN NOT {_missing('url')} THEN trim(url) END AS u,
    lower(trim(title)) || chr(1) || lower(trim(company)) AS s
  FROM postings),
screened AS (
  SELECT *, missing IS NULL AND (tier = 'KEEP_IMMEDIATE'
     OR (tier = 'CHECK_DESCRIPTION' AND contains(lower(description), 'tion'))) AS passes
  FROM tiered)"""


def _greedy(rows: str) -> str:
    """Walk ``rows`` in arrival order with the keys accepted so far."""
    return f"""
ranked AS (SELECT row_number() OVER (ORDER BY arrival) AS rn, arrival, u, s FROM {rows}),
walk(rn, us, ss, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT r.rn,
    CASE WHEN r.u IS NULL OR list_contains(w.us, r.u) OR list_contains(w.ss, r.s) THEN w.us
         ELSE list_append(w.us, r.u) END,
    CASE WHEN coalesce(list_contains(w.us, r.u), false) OR list_contains(w.ss, r.s) THEN w.ss
         ELSE list_append(w.ss, r.s) END,
    CASE WHEN coalesce(list_contains(w.us, r.u), false) OR list_contains(w.ss, r.s) THEN NULL
         ELSE r.arrival END
  FROM walk w JOIN ranked r ON r.rn = w.rn + 1),
kept AS (SELECT kept AS arrival FROM walk WHERE kept IS NOT NULL)"""


SPLIT = SCREENED + f""",
stored AS (SELECT * FROM screened WHERE arrival IN (SELECT doc_id FROM labels)),
new AS (SELECT * FROM screened WHERE arrival NOT IN (SELECT doc_id FROM labels)),
unseen AS (
  SELECT * FROM new n
  WHERE NOT EXISTS (SELECT 1 FROM stored o WHERE o.u = n.u)
    AND NOT EXISTS (SELECT 1 FROM stored o WHERE o.s = n.s AND NOT {_missing('o.title')} AND NOT {_missing('o.company')}))"""

DECIDED = SPLIT + """,
wanted AS (SELECT * FROM unseen WHERE passes),""" + _greedy("wanted") + f""",
kept_rows AS (SELECT n.* FROM new n JOIN kept USING (arrival)),
flagged AS (
  SELECT n.*,
    (EXISTS (SELECT 1 FROM stored o WHERE o.u = n.u)
      OR EXISTS (SELECT 1 FROM kept_rows k WHERE k.u = n.u AND k.arrival < n.arrival)) AS taken_url,
    (EXISTS (SELECT 1 FROM stored o WHERE o.s = n.s AND NOT {_missing('o.title')} AND NOT {_missing('o.company')})
      OR EXISTS (SELECT 1 FROM kept_rows k WHERE k.s = n.s AND k.arrival < n.arrival)) AS taken_sig
  FROM new n),
decided AS (
  SELECT arrival, layout, tier, CASE
    WHEN layout = 'A' AND taken_url THEN 'duplicate_url'
    WHEN missing = 'missing_title' THEN missing
    WHEN layout = 'B' AND taken_url THEN 'duplicate_url'
    WHEN layout = 'B' AND missing IS NOT NULL THEN missing
    WHEN layout = 'B' AND taken_sig THEN 'duplicate_signature'
    WHEN tier = 'REJECT' THEN 'bad_keyword'
    WHEN tier = 'SKIP' THEN 'irrelevant_title'
    WHEN missing IS NOT NULL THEN missing
    WHEN taken_sig THEN 'duplicate_signature'
    WHEN NOT passes THEN 'no_tech_keyword'
    ELSE 'kept' END AS reason
  FROM flagged)"""

_KEYS = "arrival, title, url, company, scraped_at"

# what a clean removes from a title before its doubling is undone
SANITIZED = POSTINGS + r""",
noiseless AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    title, '(?i)with verification', '', 'g'), '(?i) - Job', '', 'g'),
    '(?i)\(f/m/d\)', '', 'g'), '(?i)\(m/f/d\)', '', 'g'), '\s+', ' ', 'g')) AS t
  FROM postings),
sanitized AS (
  SELECT * REPLACE (CASE
      WHEN len(w) % 2 = 0 AND lower(array_to_string(w[1:len(w) // 2], ' '))
                            = lower(array_to_string(w[len(w) // 2 + 1:], ' '))
        THEN array_to_string(w[1:len(w) // 2], ' ')
      WHEN length(t) > 6 AND length(t) % 2 = 0
           AND lower(substr(t, 1, length(t) // 2)) = lower(substr(t, length(t) // 2 + 1))
        THEN substr(t, 1, length(t) // 2)
      ELSE t END AS title, coalesce(url, '') AS url, coalesce(company, '') AS company)
  FROM (SELECT *, string_split(t, ' ') AS w FROM noiseless)),
signed AS (
  SELECT *, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') || '_'
         || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS sig
  FROM sanitized)"""


def _batch(rank: str, url_key: str) -> str:
    return f""",
per_sig AS (
  SELECT * FROM signed QUALIFY row_number() OVER (
    PARTITION BY sig ORDER BY {rank}, scraped_at DESC NULLS LAST, arrival) = 1),
per_url AS (
  SELECT * FROM per_sig QUALIFY row_number() OVER (PARTITION BY {url_key} ORDER BY sig) = 1)"""


BATCH = SANITIZED + _batch("length(url)", "url")
BATCH_KEEP = SANITIZED + _batch(
    "CASE WHEN url = '' THEN 1000000 ELSE length(url) END",
    "CASE WHEN url = '' THEN chr(1) || arrival ELSE url END")


def _entities(x: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


PAGE_FIELDS = f"""
page_fields AS (
  SELECT page_id, url, {_entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS head,
    {_entities("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
    regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, html
  FROM pages)"""


def _fix_doubled(x: str) -> str:
    """Compare the two halves of a collapsed text, by words or by characters."""
    return rf"""list_transform([{_collapse(x)}], lambda t: CASE
      WHEN len(string_split(t, ' ')) % 2 = 0 AND string_split(t, ' ')[1:len(string_split(t, ' ')) // 2]
           = string_split(t, ' ')[len(string_split(t, ' ')) // 2 + 1:]
        THEN array_to_string(string_split(t, ' ')[1:len(string_split(t, ' ')) // 2], ' ')
      WHEN length(t) > 4 AND length(t) % 2 = 0
           AND substr(t, 1, length(t) // 2) = substr(t, length(t) // 2 + 1)
        THEN substr(t, 1, length(t) // 2)
      ELSE t END)[1]"""


CARDS = PAGE_FIELDS + """,
cards AS (SELECT page_id AS card_id, head AS title, lang AS company FROM page_fields),
details AS (SELECT page_id AS card_id,
  CASE page_id % 5 WHEN 1 THEN 'zz ' || reverse(h1) WHEN 2 THEN ' ' ELSE h1 END AS title,
  CASE WHEN page_id % 5 = 3 THEN 'zz' WHEN contains(url, 'https') AND page_id % 5 <> 1 THEN lang ELSE '' END AS company FROM page_fields)"""

LIVE = PAGE_FIELDS + f""",
checked AS (
  SELECT page_id AS arrival, url AS page_url,
    CASE WHEN lang = 'es' THEN h1 || ' x' WHEN lang = 'fr' THEN h1 || ' ' || h1 ELSE h1 END AS title,
    CASE WHEN contains(url, 'm.') THEN regexp_replace(url, '^.*//', '') ELSE url END AS url, lang,
    lower({_entities("regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')")}) AS body
  FROM page_fields),
live AS (
  SELECT arrival, CASE
    WHEN NOT starts_with(url, 'http') OR {_fix_doubled('title')} = '' THEN 'not_checkable'
    WHEN lang = 'de' THEN 'not_captured'
    WHEN contains(url, 'example.net') AND contains(url, '/en/') AND contains(lower(page_url), '#top') THEN 'redirected'
    WHEN contains(body, 'that the') THEN 'unavailable'
    WHEN contains(body, lower({_fix_doubled('title')})) THEN 'live'
    ELSE 'title_mismatch' END AS reason
  FROM checked),
verdicts AS (SELECT *, reason IN ('live', 'not_captured') AS is_valid FROM live)"""


def _stale(layout: str) -> str:
    events = """
seq AS (
  SELECT event_id AS arrival, user_id, CASE WHEN event_type <> 'signup' THEN event_type END AS t FROM events)"""
    if layout == "B":
        return f"""WITH {events},
prev AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY arrival
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM seq)
SELECT arrival, user_id, CASE WHEN t IS NULL OR t IS NOT DISTINCT FROM p THEN 'N/A' ELSE t END AS description FROM prev"""
    return f"""WITH {events},
marked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival)
                   - row_number() OVER (PARTITION BY user_id, t ORDER BY arrival) AS run FROM seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, t, run ORDER BY arrival) AS pos FROM marked)
SELECT arrival, user_id, CASE WHEN t IS NULL OR pos % 2 = 0 THEN 'N/A' ELSE t END AS description FROM placed"""


CHUNKS = POSTINGS + rf""",
worded AS (SELECT arrival, description, string_split({_collapse('description')}, ' ') AS w FROM postings),
chunked AS (
  SELECT arrival, CAST(i AS INTEGER) AS chunk_no, array_to_string(w[i * 450 + 1:(i + 1) * 450], ' ') AS chunk
  FROM (SELECT arrival, w, unnest(generate_series(0, (len(w) - 1) // 450)) AS i FROM worded WHERE len(w) >= 80)
  UNION ALL SELECT arrival, 0, description FROM worded WHERE len(w) < 80)"""

GRAMS = NORMED + r""",
docs AS (SELECT title_norm AS title, min(arrival) AS title_id, count(*) AS n FROM normed GROUP BY 1),
total AS (SELECT count(*) AS n_docs FROM normed),
toks AS (SELECT title_id, n, regexp_extract_all(title, '[\p{L}\p{N}_]{2,}') AS w FROM docs),
word_grams AS (
  SELECT title_id, n, 'w' AS block, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT title_id, n, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM toks, (SELECT unnest([1, 2, 3]) AS k))),
padded AS (SELECT title_id, n, ' ' || unnest(string_split(title, ' ')) || ' ' AS w FROM docs WHERE title <> ''),
char_grams AS (
  SELECT title_id, n, 'c' AS block, substr(w, i, k) AS gram
  FROM (SELECT title_id, n, w, k, unnest(generate_series(1, length(w) - k + 1)) AS i
        FROM padded, (SELECT unnest([3, 4, 5]) AS k))),
counts AS (
  SELECT title_id, n, block, gram, count(*) AS tf
  FROM (SELECT * FROM word_grams UNION ALL SELECT * FROM char_grams) GROUP BY ALL),
dfs AS (SELECT block, gram, sum(n) AS df FROM counts GROUP BY ALL HAVING sum(n) >= 2),
raw AS (
  SELECT title_id, n, block, gram, tf, df, tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w
  FROM counts JOIN dfs USING (block, gram), total),
weighted AS (
  SELECT title_id, n, block, gram, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY title_id, block)) AS weight FROM raw),
united AS (
  SELECT title_id, n, block || ':' || gram AS feature, tf, df,
         weight / sqrt(sum(weight * weight) OVER (PARTITION BY title_id)) AS weight
  FROM weighted)"""

# Pairs meet at rare features: behind the last common one of those, the product is at most that of what is left of both.
PAIRS = GRAMS + """,
prints AS (SELECT title_id, any_value(n) AS n, string_agg(feature || chr(1) || tf, chr(2) ORDER BY feature) AS print FROM united GROUP BY 1),
profiles AS (SELECT min(title_id) AS title_id, sum(n) AS n_rows FROM prints GROUP BY print),
vecs AS MATERIALIZED (SELECT u.title_id, feature, df, weight FROM united u JOIN profiles USING (title_id)),
placed AS (
  SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY title_id ORDER BY df, feature
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rest,
    sqrt(coalesce(sum(weight * weight) OVER (PARTITION BY title_id ORDER BY df, feature
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS behind
  FROM vecs),
rare AS MATERIALIZED (SELECT *, min(behind) OVER (PARTITION BY title_id) AS common FROM placed WHERE rest >= 0.5499),
likely AS MATERIALIZED (
  SELECT x.title_id AS a, y.title_id AS b FROM rare x JOIN rare y ON x.feature = y.feature AND x.title_id < y.title_id
  GROUP BY 1, 2 HAVING sum(x.weight * y.weight)
    + greatest(min(x.common) * min(y.behind), min(x.behind) * min(y.common)) >= 0.5499),
pairs AS MATERIALIZED (
  SELECT a, b, sum(x.weight * y.weight) AS sim
  FROM likely JOIN vecs x ON x.title_id = a JOIN vecs y ON y.title_id = b AND x.feature = y.feature
  GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.55)"""

# the smallest node that reaches each one, handed on along edges from both ends
SPREAD = """
spread(node, low) AS (
  SELECT DISTINCT a, a FROM edges
  UNION SELECT e.a, min(s.low) FROM spread s JOIN edges e ON e.b = s.node GROUP BY e.a HAVING min(s.low) < e.a)"""

# Average linkage of the pairs below the distance, component by component: in every round all pairs of clusters that are
# the nearest of each other merge; clusters without a near one are finished. Rows are kept from both ends.
LINKED = PAIRS + """,
near AS MATERIALIZED (SELECT a, b FROM pairs WHERE 1.0 - round(sim, 12) < 0.45),
edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
""" + SPREAD + """,
homes AS MATERIALIZED (SELECT node, min(low) AS home FROM spread GROUP BY node),
parts AS MATERIALIZED (SELECT home, title_id, feature, weight FROM vecs JOIN homes ON node = title_id),
whole AS MATERIALIZED (
  SELECT x.title_id AS a, y.title_id AS b, sum(x.weight * y.weight) AS sim
  FROM parts x JOIN parts y ON x.home = y.home AND x.feature = y.feature AND x.title_id <> y.title_id GROUP BY 1, 2),
step(round, a, b, na, nb, s) AS (
  SELECT 0, a, b, CAST(x.n_rows AS DOUBLE), CAST(y.n_rows AS DOUBLE), sim * x.n_rows * y.n_rows
  FROM whole JOIN profiles x ON x.title_id = a JOIN profiles y ON y.title_id = b
  UNION ALL
  SELECT round + 1, ra, rb, max(sa), max(sb), sum(s) FROM (
    SELECT round, s, CASE WHEN pa > 0 THEN least(a, ma) ELSE a END AS ra, CASE WHEN pb > 0 THEN least(b, mb) ELSE b END AS rb,
      na + pa AS sa, nb + pb AS sb
    FROM (
      SELECT *, max(CASE WHEN b = ma AND mb = a THEN nb ELSE 0 END) OVER (PARTITION BY a) AS pa,
        max(CASE WHEN b = ma AND mb = a THEN na ELSE 0 END) OVER (PARTITION BY b) AS pb
      FROM (
        SELECT *, first_value(b) OVER (PARTITION BY a ORDER BY sim DESC, least(a, b), greatest(a, b)) AS ma,
          first_value(a) OVER (PARTITION BY b ORDER BY sim DESC, least(a, b), greatest(a, b)) AS mb
        FROM (
          SELECT *, max(sim) OVER (PARTITION BY a) AS ta, max(sim) OVER (PARTITION BY b) AS tb
          FROM (SELECT *, round(s / (na * nb), 12) AS sim FROM step))
        WHERE 1.0 - ta < 0.45 AND 1.0 - tb < 0.45)))
  WHERE ra <> rb GROUP BY round, ra, rb),
rounds AS (
  SELECT *, first_value(b) OVER (PARTITION BY round, a ORDER BY sim DESC, least(a, b), greatest(a, b)) AS ma,
    first_value(a) OVER (PARTITION BY round, b ORDER BY sim DESC, least(a, b), greatest(a, b)) AS mb
  FROM (SELECT *, round(s / (na * nb), 12) AS sim FROM step)),
merged AS MATERIALIZED (SELECT a AS node, b AS parent FROM rounds WHERE b = ma AND a = mb AND b < a AND 1.0 - sim < 0.45),
up(node, root) AS (SELECT node, parent FROM merged UNION ALL SELECT up.node, m.parent FROM up JOIN merged m ON m.node = up.root),
tops AS (SELECT node, min(root) AS cluster FROM up GROUP BY node),
member AS (
  SELECT p.title_id, q.title_id AS profile FROM prints p
  JOIN (SELECT print, min(title_id) AS title_id FROM prints GROUP BY print) q USING (print)),
clustered AS (
  SELECT arrival, title_norm AS title_updated, CASE WHEN coalesce(title_norm, '') = '' THEN arrival
    ELSE coalesce(cluster, profile, title_id) END AS cluster_id
  FROM normed LEFT JOIN docs ON docs.title = title_norm LEFT JOIN member USING (title_id) LEFT JOIN tops ON tops.node = profile)"""

GIVEN = r"""
given AS (
  SELECT doc_id AS arrival, regexp_extract(text, '^[^.,|\n]*') AS title,
         CAST(regexp_extract(source, '\d+') AS BIGINT) AS cluster_id
  FROM documents),
sizes AS (SELECT cluster_id, count(*) AS n FROM given GROUP BY 1),
top AS (SELECT cluster_id FROM sizes ORDER BY n DESC, cluster_id LIMIT 15)"""

_TOP_TITLES = """
SELECT cluster_id, title, n, rank, size FROM (
  SELECT cluster_id, title, count(*) AS n,
         row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, title) AS rank
  FROM {rows} GROUP BY 1, 2) t
JOIN (SELECT cluster_id, count(*) AS size FROM {rows} GROUP BY 1) USING (cluster_id)
WHERE rank <= 15"""

_MISSING_COLUMNS = ("title", "url", "company", "description", "salary", "qualifications", "scraped_at")
_INGESTED = f"WITH RECURSIVE {SCREENED}, wanted AS (SELECT * FROM screened WHERE passes), {_greedy('wanted')} " + """
SELECT arrival, nullif(title, '') AS title, nullif(url, '') AS url, company, scraped_at
FROM postings JOIN kept USING (arrival)"""

# postings with sessions: stale descriptions are blanked among the rows that pass the field and title gates
_SESSIONS = SCREENED.split("screened AS (")[0].replace("text AS description", """CASE
           WHEN source = 'src5' OR n_chars % 3 = 1 THEN 'others' WHEN n_chars % 3 = 0 THEN 'a notion' ELSE text END AS description,
         CASE WHEN source NOT IN ('src0','src1','src2','src3','src4') THEN 'all'
              WHEN source = 'src11' THEN 'N/A' ELSE lang END AS session""") + f"""
shown AS (
  SELECT arrival, layout, session, CASE WHEN NOT {_missing('description')} THEN trim(description) END AS t FROM tiered
  WHERE missing IS NULL AND tier IN ('KEEP_IMMEDIATE', 'CHECK_DESCRIPTION')),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY layout, session ORDER BY arrival)
          - row_number() OVER (PARTITION BY layout, session, t ORDER BY arrival) AS run FROM shown),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY layout, session, t, run ORDER BY arrival) AS pos,
    last_value(t IGNORE NULLS) OVER (PARTITION BY layout, session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM runs),
blanked AS (
  SELECT arrival, CASE WHEN t IS NULL OR (layout = 'A' AND pos % 2 = 0) OR (layout = 'B' AND t IS NOT DISTINCT FROM p)
    THEN 'N/A' ELSE t END AS now FROM placed),
screened AS (
  SELECT * REPLACE (coalesce(now, description) AS description), missing IS NULL AND (tier = 'KEEP_IMMEDIATE'
     OR (tier = 'CHECK_DESCRIPTION' AND contains(lower(coalesce(now, description)), 'tion'))) AS passes
  FROM tiered LEFT JOIN blanked USING (arrival))"""
_SESSIONS_INGESTED = f"""WITH RECURSIVE {_SESSIONS}, wanted AS (SELECT * FROM screened WHERE passes), {_greedy('wanted')},
saved AS (
  SELECT arrival, nullif(title, '') AS title, nullif(url, '') AS url, company, nullif(description, 'N/A') AS d
  FROM screened JOIN kept USING (arrival))
SELECT arrival, title, url, company, length(d) AS n_text, md5(d) AS digest FROM saved"""

def _captured(layout: str) -> str:
    pay = """CASE arrival % 5 WHEN 0 THEN '$' || {n} || ' per hour' WHEN 1 THEN 'N/A'
      ELSE '$' || (arrival % 900) || ',000' END""".replace(
        "{n}", "substr(CAST(arrival AS VARCHAR), 1, 3)").replace(
        "|| ' per hour'", "|| CASE WHEN arrival < 1000 THEN ' per hour' ELSE '' END")
    title = _fix_doubled(f"trim(title) || '{' ' if layout == 'B' else ''}R&D'")
    d_title = "CASE arrival % 5 WHEN 1 THEN 'zz' WHEN 2 THEN '' ELSE trim(title || ' R&D') END"
    company = "coalesce(company, '')"
    d_company = f"CASE arrival % 5 WHEN 3 THEN '' WHEN 4 THEN 'another' ELSE trim({company} || ' inc') END"
    if layout == "A":
        agree = f"""({d_company} <> '' AND company IS NOT NULL AND (contains(lower(company), lower({d_company})) OR contains(lower({d_company}), lower(company))))
          OR ({d_title} <> '' AND contains(lower({d_title}), lower(substr({title}, 1, 10))))"""
        url, session, first = "'https://www.simplyhired.ca/job/' || arrival", "arrival", "0"
        rest = f"{pay} AS salary, CASE WHEN trim({company}) = '' THEN 'a' ELSE 'a; ' || trim(company) END AS qualifications"
    else:
        agree = f"{_fix_doubled(d_title)} <> '' AND (contains(lower({title}), lower({_fix_doubled(d_title)})) OR contains(lower({_fix_doubled(d_title)}), lower({title})))"
        url, session, first = "'https://jobs.test/job/' || arrival", "0", "4611686018427387904"
        rest = "'N/A' AS salary, 'N/A' AS qualifications"
    shown = "company" if layout == "A" else d_company
    return f"""WITH {POSTINGS} SELECT arrival * 1048576 + {first} AS arrival, '{layout}' AS layout, CAST({session} AS BIGINT) AS session,
      CAST(arrival % 4 + 1 AS INTEGER) AS page_num, {title} AS title, {url} AS url, {shown} AS company, {rest},
      length(description) AS n_text, md5(description) AS digest FROM postings WHERE {agree}"""


_STAGED = CHUNKS + r""",
stage AS (
  SELECT arrival, string_agg(array_to_string(string_split('obtain salary / salary range, if available: ' || chunk, ' ')[-5:], ' '),
                             ' ' ORDER BY chunk_no) AS mid
  FROM chunked WHERE arrival IN (SELECT arrival FROM worded WHERE len(w) >= 80) GROUP BY 1),
summed AS (
  SELECT p.arrival, coalesce(array_to_string(string_split(s.mid, ' ')[-5:], ' '), p.description) AS d,
         CASE WHEN trim(p.salary) = '' THEN 'N/A' ELSE p.salary END AS salary
  FROM postings p LEFT JOIN stage s USING (arrival))"""

SQL: dict[str, str] = {
    "role_counts": f"WITH {TITLED} SELECT title_updated, count(*) AS n FROM titled GROUP BY 1",
    "normalized_titles": f"WITH {TITLED} SELECT arrival, title_norm, title_updated FROM titled",
    "title_repair": f"""WITH {POSTINGS} SELECT arrival, {_fix_doubled(
        "CASE WHEN company = 'en' THEN title || '  ' || title WHEN company = 'fr' THEN title || title ELSE title END")}
        AS fixed FROM postings""",
    "title_sanitize": f"""WITH base AS (SELECT 1), {SANITIZED.replace('FROM documents', '''FROM documents),
      written AS (SELECT * REPLACE (CASE
        WHEN company = 'en' THEN lower(title) || ' WITH verification ' || title
        WHEN company = 'fr' THEN title || lower(title) || ' (M/F/D)'
        ELSE title || ' - Jobs' END AS title) FROM postings''').replace('  FROM postings)', '  FROM written)')}
      SELECT arrival, title AS clean FROM sanitized""",
    "salary_spans": r"""WITH written AS (
      SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS size, p_type
      FROM part), texts AS (
      SELECT p_partkey, trim(regexp_replace(CASE p_type
        WHEN 'ECONOMY' THEN 'Pay $' || price || ' per hour'
        WHEN 'SMALL' THEN 'ca$' || size || 'K - C$' || price || '/Year'
        WHEN 'MEDIUM' THEN '$ ' || size || ',000 to ' || size || ',500 a year'
        WHEN 'STANDARD' THEN 'USD ' || price
        ELSE '  $' || size || chr(10) || '000 mo' END, '\s+', ' ', 'g')) AS t FROM written)
      SELECT p_partkey, coalesce(nullif(trim(regexp_extract(t,
        '(?i)(?:ca?\$|c\$|\$) *[0-9]{1,3}(?:[, ][0-9]{3})*(?:\.[0-9]+)? *k?(?: *(?:-|–|—|to) *(?:ca?\$|c\$|\$)? *[0-9]{1,3}(?:[, ][0-9]{3})*(?:\.[0-9]+)? *k?)?(?: *(?:/|per *)?(?:hour|hr|year|yr|month|mo|week|wk|day|annum))?')), ''), 'N/A') AS salary
      FROM texts""",
    "salary_filled": f"WITH {POSTINGS} SELECT arrival, CASE WHEN trim(salary) = '' THEN 'N/A' ELSE salary END AS salary FROM postings",
    "quals_joined": f"""WITH {POSTINGS}, joined AS (
      SELECT arrival, coalesce(nullif(array_to_string(list_filter(list_transform(
        string_split(description, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '; '), ''), 'N/A') AS q FROM postings)
      SELECT arrival, length(q) AS n_text, md5(q) AS digest FROM joined""",
    "missing_report": f"WITH {POSTINGS} SELECT count(*) AS n_rows, " + ", ".join(
        f"count(*) FILTER ({_missing(c)}) AS missing_{c}" for c in _MISSING_COLUMNS) + " FROM postings",
    "schema_conform": f"""WITH {POSTINGS} SELECT title, url, company, salary, 'N/A' AS qualifications, scraped_at,
      length(description) AS n_text, md5(description) AS digest FROM postings""",
    "first_non_blank": f"""WITH {POSTINGS} SELECT arrival, coalesce(nullif(trim(url), ''), nullif(trim(salary), ''),
      nullif(trim(company), ''), '') AS picked FROM postings""",
    "seen_urls": f"WITH {SCREENED} SELECT DISTINCT u AS url_key FROM screened WHERE u IS NOT NULL",
    "seen_signatures": f"""WITH {POSTINGS} SELECT DISTINCT lower(trim(title)) AS title, lower(trim(company)) AS company
      FROM postings WHERE NOT {_missing('title')} AND NOT {_missing('company')}""",
    "csv_postings": f"""WITH {POSTINGS} SELECT layout, nullif(title, '') AS title, nullif(url, '') AS url,
      nullif(company, 'N/A') AS company, salary, scraped_at, CAST(NULL AS VARCHAR) AS qualifications,
      length(description) AS n_text, md5(description) AS digest FROM postings""",
    "title_tiers": f"WITH {POSTINGS} SELECT arrival, {TIER} AS tier FROM postings",
    "required_fields": f"WITH {SCREENED} SELECT arrival, layout FROM screened WHERE missing IS NULL",
    "accepted_postings": f"""WITH {POSTINGS} SELECT arrival, title FROM (SELECT *, {TIER} AS tier FROM postings)
      WHERE tier = 'KEEP_IMMEDIATE' OR (tier = 'CHECK_DESCRIPTION' AND description <> 'N/A'
        AND contains(lower(description), 'tion'))""",
    "decisions": f"WITH RECURSIVE {DECIDED} SELECT arrival, tier, reason FROM decided",
    "decision_funnel": f"WITH RECURSIVE {DECIDED} SELECT layout, reason, count(*) AS n FROM decided GROUP BY 1, 2",
    "decision_log": f"""WITH {POSTINGS} SELECT arrival, {TIER} AS reason, substr(trim(title), 1, 80) AS title,
      substr(trim(company), 1, 60) AS company, substr(trim(salary), 1, 40) AS salary,
      coalesce(substr(trim(url), 1, 90), '') AS url FROM postings""",
    "capped_postings": f"""WITH {SCREENED} SELECT layout, arrival, title FROM screened WHERE missing IS NULL
      ORDER BY layout, arrival LIMIT 100""",
    "stale_blanked_a": _stale("A"),
    "stale_blanked_b": _stale("B"),
    "unseen_postings": f"WITH {SPLIT} SELECT arrival, title, url, company FROM unseen",
    "greedy_dedup": f"""WITH RECURSIVE {SCREENED}, {_greedy('screened')}
      SELECT arrival, title, url, company FROM postings JOIN kept USING (arrival)""",
    "batch_dedup": f"WITH {BATCH} SELECT {_KEYS} FROM per_url",
    "batch_dedup_keep_blank": f"WITH {BATCH_KEEP} SELECT arrival, title, url FROM per_url",
    "dedup_report": f"""WITH {BATCH} SELECT (SELECT count(*) FROM postings) AS original, (SELECT count(*) FROM per_url) AS kept,
      (SELECT count(*) FROM postings) - (SELECT count(*) FROM per_url) AS removed""",
    "cleaned_store": f"""WITH {BATCH.replace("coalesce(company, '')", "CASE WHEN company = 'N/A' THEN '' ELSE company END")}
      SELECT arrival, nullif(title, '') AS title, nullif(url, '') AS url,
      nullif(company, '') AS company, scraped_at FROM per_url""",
    "page_links": rf"""WITH anchors AS (
      SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS a
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS l FROM pages)),
      parts AS (SELECT page_id, CAST(pos AS INTEGER) AS pos,
        {_entities("regexp_extract(a, '>([^<]+)<', 1)")} AS t,
        {_entities("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href FROM anchors)
      SELECT page_id, pos, {_fix_doubled('t')} AS title, CASE WHEN href = '' THEN '' WHEN starts_with(href, 'http') THEN href
        ELSE 'https://jobs.test' || split_part(href, '?', 1) END AS url FROM parts""",
    "cards_layout_a": f"""WITH {POSTINGS} SELECT arrival AS page_id, 0 AS pos,
        {_fix_doubled("trim(title) || 'R&D'")} AS title,
        'https://www.simplyhired.ca/job/' || arrival AS url, company FROM postings
      UNION ALL SELECT arrival, 1, 'Plain', 'https://abs.test/j?q=1', '' FROM postings""",
    "cards_layout_b": f"""WITH {POSTINGS} SELECT arrival AS page_id, 0 AS pos,
        {_fix_doubled("trim(title) || ' R&D'")} AS title, 'https://jobs.test/job/' || arrival AS url FROM postings
      UNION ALL SELECT arrival, 1, '', '' FROM postings""",
    "captured_a": _captured("A"),
    "captured_b": _captured("B"),
    "captured_pages_limited": f"SELECT arrival, page_num, title FROM ({_captured('A')}) WHERE page_num <= 2",
    "canonical_urls": """SELECT page_id, url AS url_a, split_part(url, '?', 1) AS url_b,
      'https://jobs.test/' || split_part(regexp_replace(url, '^.*//', ''), '?', 1) AS completed FROM pages""",
    "card_detail_match_a": f"""WITH {CARDS} SELECT c.card_id, c.title, c.company FROM cards c JOIN details d USING (card_id)
      WHERE (trim(d.company) <> '' AND (contains(lower(c.company), lower(trim(d.company))) OR contains(lower(trim(d.company)), lower(c.company))))
         OR (trim(d.title) <> '' AND contains(lower(trim(d.title)), lower(substr(c.title, 1, 10))))""",
    "card_detail_match_b": f"""WITH {CARDS} SELECT c.card_id, c.title, trim(d.company) AS company
      FROM cards c JOIN details d USING (card_id)
      WHERE {_fix_doubled('d.title')} <> '' AND (contains(lower(c.title), lower({_fix_doubled('d.title')}))
         OR contains(lower({_fix_doubled('d.title')}), lower(c.title)))""",
    "liveness": f"WITH {LIVE} SELECT * FROM verdicts",
    "clean_report": f"""WITH {LIVE} SELECT count(*) AS original, count(*) FILTER (is_valid) AS kept,
      count(*) FILTER (NOT is_valid) AS removed FROM verdicts""",
    "verified_store": f"""WITH {PAGE_FIELDS} SELECT page_id AS arrival, h1 AS title, url, CAST(NULL AS VARCHAR) AS company
      FROM page_fields WHERE h1 <> '' AND {_fix_doubled('h1')} <> ''
      AND NOT (contains(url, 'example.net') AND contains(url, '/en/') AND contains(url, '#top'))
      AND NOT contains(lower(h1), 'that the') AND contains(lower(h1), lower({_fix_doubled('h1')}))""",
    "desc_chunks": f"WITH {CHUNKS} SELECT arrival, chunk_no, length(chunk) AS n_text, md5(chunk) AS digest FROM chunked",
    "summary_regroup": f"WITH {_STAGED} SELECT arrival, salary, length(d) AS n_text, md5(d) AS digest FROM summed",
    "summary_resumed": f"WITH {_STAGED} SELECT arrival, salary, length(d) AS n_text, md5(d) AS digest FROM summed",
    "tfidf_word": f"WITH {GRAMS} SELECT title_id, gram AS feature, round(weight, 6) AS weight FROM weighted WHERE block = 'w'",
    "tfidf_char": f"WITH {GRAMS} SELECT title_id, gram AS feature, round(weight, 6) AS weight FROM weighted WHERE block = 'c'",
    "tfidf_union": f"WITH {GRAMS} SELECT title_id, feature, round(weight, 6) AS weight FROM united",
    "similar_titles": f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "title_components": f"""WITH RECURSIVE {PAIRS},
      edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), {SPREAD}
      SELECT node, min(low) AS component FROM spread GROUP BY node""",
    "title_clusters": f"WITH RECURSIVE {LINKED} SELECT arrival, title_updated, cluster_id FROM clustered",
    "title_cluster_sizes": f"""WITH RECURSIVE {LINKED} SELECT cluster_id, count(*) AS n FROM clustered
      GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 25""",
    "cluster_sizes": f"WITH {GIVEN} SELECT cluster_id, n FROM sizes ORDER BY n DESC, cluster_id LIMIT 15",
    "cluster_top_titles": f"WITH {GIVEN} {_TOP_TITLES.format(rows='given')}",
    "outside_top": f"""WITH {GIVEN} SELECT count(*) AS rows_left, count(DISTINCT cluster_id) AS clusters_left
      FROM given WHERE cluster_id NOT IN (SELECT cluster_id FROM top)""",
    "outside_top_titles": f"""WITH {GIVEN}, rest AS (
      SELECT * FROM given WHERE cluster_id NOT IN (SELECT cluster_id FROM top)) {_TOP_TITLES.format(rows='rest')}""",
    "cluster_members": f"WITH {GIVEN} SELECT title, min(arrival) AS first_seen FROM given WHERE cluster_id = 3 GROUP BY 1",
    "preview": f"WITH {TITLED} SELECT title, title_updated FROM titled ORDER BY arrival LIMIT 20",
    "ingest_batches": _INGESTED,
    "ingest_stream": _INGESTED,
    "ingest_stream_sessions": _SESSIONS_INGESTED,
    "ingest_stream_capped": f"{_SESSIONS_INGESTED} ORDER BY arrival LIMIT 100",
}

# every clause of every text; the other queries see the first one only
CLAUSE_POSTINGS = r"""
postings AS (
  SELECT doc_id * 4294967296 + place AS arrival, title FROM (
    SELECT doc_id, unnest(range(len(c))) AS place, unnest(c) AS title
    FROM (SELECT doc_id, string_split_regex(text, '[.,|\n]') AS c FROM documents)))"""

SQL |= {f"clause_{name}": SQL[name].replace(POSTINGS, CLAUSE_POSTINGS) for name in (
    "role_counts", "tfidf_word", "tfidf_char", "tfidf_union", "similar_titles", "title_components",
    "title_clusters", "title_cluster_sizes")}
