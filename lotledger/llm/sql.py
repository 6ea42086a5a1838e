"""DuckDB SQL with the results of the queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
),
win AS (
  SELECT r, i, w[i:i+7] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)
),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(i - before, 8))) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM rep) GROUP BY r
),
c AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
    CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats
  FROM c
),
long AS (
  SELECT lang, source, metric, greatest(length(bin(v)) - 6, 0) AS s, v
  FROM (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM m WHERE NOT base_failed)
        ON word_length, symbols, dup_lines, repeats INTO NAME metric VALUE v)
),
fine AS (SELECT lang, source, metric, s * 64 + (v >> s) AS bucket, count(*) AS n FROM long GROUP BY ALL),
sketch AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM fine
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM fine GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM fine GROUP BY metric, bucket
),
q AS (
  SELECT level, lang, source, metric, max(total) AS n, max(total - without) AS held, min(bucket) FILTER (bucket > 0 AND 4 * (cum - without) >= total - without) AS least_held,
         min(bucket) FILTER (100 * cum >= 25 * total) AS b25,
         min(bucket) FILTER (100 * cum >= 75 * total) AS b75, min(bucket) FILTER (100 * cum >= 99 * total) AS b99
  FROM (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum,
               sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
               coalesce(sum(n) FILTER (bucket = 0) OVER (PARTITION BY level, lang, source, metric), 0) AS without FROM sketch) GROUP BY ALL
),
e AS (
  SELECT level, lang, source, metric, n, coalesce(held::DOUBLE * ((least_held % 64) << (least_held // 64)) / n, 0) AS few, (b25 % 64) << (b25 // 64) AS p25, (b75 % 64) << (b75 // 64) AS p75, (b99 % 64) << (b99 // 64) AS p99,
         ((b75 % 64 + 1) << (b75 // 64)) - 1 AS last75, ((b99 % 64 + 1) << (b99 // 64)) - 1 AS last99 FROM q
),
f AS (
  SELECT level, lang, source, max(n) AS n,
    max(p25 - 5 * (p75 - p25)) FILTER (metric = 'word_length') AS lo_word_length,
    max(last75 + 5 * (p75 - p25)) FILTER (metric = 'word_length') AS hi_word_length,
    max(last75 + greatest((3 * (p75 - p25))::DOUBLE, 3 * few)) FILTER (metric = 'symbols') AS hi_symbols,
    max(last99 + (p99 - p75)) FILTER (metric = 'dup_lines') AS hi_dup_lines,
    max(last99 + (p99 - p75)) FILTER (metric = 'repeats') AS hi_repeats
  FROM e GROUP BY level, lang, source
),
g AS (
  SELECT l.lang,
    coalesce((l.n::DOUBLE * l.lo_word_length + 100 * w.lo_word_length::DOUBLE) / (l.n + 100)::DOUBLE, w.lo_word_length) AS lo_word_length,
    coalesce((l.n::DOUBLE * l.hi_word_length + 100 * w.hi_word_length::DOUBLE) / (l.n + 100)::DOUBLE, w.hi_word_length) AS hi_word_length,
    coalesce((l.n::DOUBLE * l.hi_symbols + 100 * w.hi_symbols::DOUBLE) / (l.n + 100)::DOUBLE, w.hi_symbols) AS hi_symbols,
    coalesce((l.n::DOUBLE * l.hi_dup_lines + 100 * w.hi_dup_lines::DOUBLE) / (l.n + 100)::DOUBLE, w.hi_dup_lines) AS hi_dup_lines,
    coalesce((l.n::DOUBLE * l.hi_repeats + 100 * w.hi_repeats::DOUBLE) / (l.n + 100)::DOUBLE, w.hi_repeats) AS hi_repeats
  FROM f l, f w WHERE l.level = 1 AND w.level = 2
),
h AS (
  SELECT o.lang, o.source,
    (o.n::DOUBLE * o.lo_word_length + 100 * g.lo_word_length) / (o.n + 100)::DOUBLE AS lo_word_length,
    (o.n::DOUBLE * o.hi_word_length + 100 * g.hi_word_length) / (o.n + 100)::DOUBLE AS hi_word_length,
    (o.n::DOUBLE * o.hi_symbols + 100 * g.hi_symbols) / (o.n + 100)::DOUBLE AS hi_symbols,
    (o.n::DOUBLE * o.hi_dup_lines + 100 * g.hi_dup_lines) / (o.n + 100)::DOUBLE AS hi_dup_lines,
    (o.n::DOUBLE * o.hi_repeats + 100 * g.hi_repeats) / (o.n + 100)::DOUBLE AS hi_repeats
  FROM f o JOIN g ON g.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_length >= lo_word_length, true) AND coalesce(word_length <= hi_word_length, true)
  AND (coalesce(symbols <= hi_symbols, true) OR n_symbols <= 3) AND coalesce(dup_lines <= hi_dup_lines, true) AND coalesce(repeats <= hi_repeats, true) AS kept
FROM m LEFT JOIN h ON h.lang IS NOT DISTINCT FROM m.lang AND h.source IS NOT DISTINCT FROM m.source
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
),
e AS (SELECT *, row_number() OVER (PARTITION BY source, key, size, doc_id) AS copy FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM s
),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
),
t AS (
  SELECT source, source_size, budget,
         CASE WHEN cap <= level * w THEN cap ELSE (min_by(level, cap / w) FILTER (NOT cap <= level * w) OVER ()) * w END AS target FROM l
),
q AS (
  SELECT d.*, source_size, target, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, size, coalesce(doc_id, -1), copy) AS cum
  FROM e d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
i AS (
  SELECT *, (cum::BIGINT + pass * source_size) / target AS finish FROM q, (SELECT unnest([0, 1]) AS pass) WHERE size > 0 AND target > 0
),
g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, size, coalesce(doc_id, -1), copy) AS upto FROM i
),
n AS (SELECT source, key, size, coalesce(doc_id, -1) AS id, copy, count(DISTINCT pass) AS copies FROM g WHERE upto <= budget GROUP BY ALL)
SELECT doc_id, q.size, source_size, target, (q.size * coalesce(copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.key = n.key AND q.size = n.size AND coalesce(doc_id, -1) = id AND q.copy = n.copy
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages WHERE page_id IS NOT NULL
),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]*|ref|sessionid|sid|phpsessid|fbclid|gclid)(=|$)'))) AS args
  FROM p
),
c AS (
  SELECT page_id, html, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url,
    1577836800 + page_id * 60 AS sec, '"' || md5(html)[1:16] || '"' AS tag FROM u
),
r AS (
  SELECT page_id, url, sec, 'r' || page_id AS id, CASE WHEN page_id % 4 <> 3 THEN tag END AS etag, sec - 86400 AS lm, strlen(html) AS n FROM c
),
v AS (
  SELECT page_id, url, sec + 30 + (page_id % 7) * 86400 AS sec, 'v' || page_id AS id,
    CASE WHEN page_id % 4 < 2 THEN CASE WHEN page_id % 11 = 0 THEN '"other"' ELSE tag END END AS etag, CASE WHEN page_id % 4 >= 2 THEN sec - 86400 END AS lm
  FROM c WHERE page_id % 3 <> 1
),
j AS (
  SELECT v.id AS record_id, v.url, v.sec, v.etag AS ve, r.etag AS re, r.lm AS rl, r.n, r.id AS rid,
    CASE WHEN r.id IS NULL THEN 'no_response' WHEN coalesce(v.etag = r.etag, v.lm = r.lm) THEN 'resolved'
         WHEN NOT coalesce(v.etag = r.etag, v.lm = r.lm) THEN 'validator_mismatch' ELSE 'no_validator' END AS outcome
  FROM v LEFT JOIN LATERAL (SELECT * FROM r WHERE r.url = v.url AND r.sec < v.sec ORDER BY r.sec DESC, r.id DESC LIMIT 1) r ON true
),
t AS (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(make_timestamp(rl * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS l FROM j)
SELECT record_id, url, sec AS seconds, CASE WHEN outcome = 'resolved' THEN rid END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN md5('cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || d
    || CASE WHEN coalesce(ve, re) IS NOT NULL THEN chr(10) || 'etag: ' || coalesce(ve, re) ELSE '' END || chr(10) || 'last-modified: ' || l) END AS headers_md5
FROM t
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)][i]) AS failed
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
j AS (
  SELECT part, good, toxic, failed, filter_order, step, filter_order[step] AS filter,
    list_min(list_transform(failed, lambda y: instr(filter_order, y))) AS goes_at, list_contains(failed, filter_order[step]) AS fails FROM f, s
),
c AS (
  SELECT part, filter_order, step, filter, count(*) FILTER (coalesce(goes_at > step, true)) AS kept, count(*) FILTER (goes_at = step) AS removed,
    count(*) FILTER (fails AND goes_at < step) AS redundant, count(*) FILTER (fails AND len(failed) = 1) AS unique_fails,
    count(*) FILTER (goes_at = step AND good) AS good_lost, count(*) FILTER (goes_at = step AND toxic) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""

#: The checksum is folded over bytes with the table of its polynomial.
OP13 = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS sums FROM (
    SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(0, 256) r(i))
),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents
),
k AS (
  SELECT doc_id, source, size, t,
    md5('shards:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(t) || ':' || coalesce(length(source) || ':' || source, '')) AS key FROM d
),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, size, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS place FROM k
),
p AS (
  SELECT *, row_number() OVER (ORDER BY place, source NULLS LAST, key) - 1 AS position, count(*) OVER () AS n FROM r
)
SELECT doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda a, b: xor(a >> 8, sums[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
  'rows' AS law, (position * 16 // n)::INTEGER AS shard, position - (((position * 16 // n) * n + 15) // 16) AS slot, NULL::INTEGER AS grown_shard
FROM p, crc
"""

ORACLE_SQL = {"op3_quality_rules": OP3, "op6_mixing": OP6, "op7_warc_revisits": OP7, "op12_filter_audit": OP12, "op13_sharding": OP13}
