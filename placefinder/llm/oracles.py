"""DuckDB SQL for the corpus queries whose results SQL can express."""

from __future__ import annotations

from . import divergence, exact_dedup, fixity, url_trust

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN sym x ON x.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

LEAKS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (
  SELECT item_id, j, w[j:j + least(9, len(w) - 1)] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS j FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item_id, g FROM bp),
sizes AS (SELECT DISTINCT len(g) AS z FROM bw),
dw AS (
  SELECT doc_id, i, z, w[i:i + z - 1] AS g
  FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, sizes WHERE len(w) >= z)),
m AS (SELECT doc_id, i, z, item_id FROM dw JOIN bw USING (g)),
runs AS (
  SELECT doc_id, count(*) + z - 1 AS words FROM (
    SELECT doc_id, item_id, z, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island
    FROM dw JOIN bp USING (g))
  GROUP BY doc_id, item_id, z, diagonal, island),
longest AS (SELECT doc_id, max(words) AS longest FROM runs GROUP BY 1),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS k FROM m) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

FIXITY = rf"""
WITH r AS (
  SELECT page_id, page_id // {fixity.SLOTS} AS archive, page_id % {fixity.SLOTS} AS slot, coalesce(html, '') AS html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM pages),
h AS (SELECT page_id, archive, slot, strlen(body)::BIGINT AS n_bytes, sha256(body) AS leaf_sha256, ('0x' || substr(sha256(page_id::VARCHAR), 1, 7))::BIGINT AS mark FROM r)
SELECT page_id, archive, slot, n_bytes, leaf_sha256,
  coalesce(sum(n_bytes) OVER (PARTITION BY archive ORDER BY slot, leaf_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
  CASE WHEN mark % 211 = 5 THEN 'missing' WHEN mark % 101 = 7 THEN 'changed' ELSE 'ok' END AS status
FROM h
"""

_HOST = rf"translate(regexp_extract(coalesce(url, ''), '^[\x00-\x{{10FFFF}}]*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = r"regexp_extract(coalesce(url, ''), '^[\x00-\x{10FFFF}]*?://[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_trust.RULES)

#: Of the tables given here no page links to another host, so the walks end where they start.
TRUST = f"""
WITH r(v, h, p) AS (VALUES {_RULES}),
u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
m AS (
  SELECT page_id, host, path,
    (SELECT max_by(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(v, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS decided
  FROM u),
s AS (SELECT host, avg(CASE WHEN decided = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN decided = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM m WHERE host <> '' GROUP BY 1)
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN coalesce(distrust, 0.0) >= {url_trust.BLOCK_AT} AND coalesce(distrust, 0.0) > coalesce(trust, 0.0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust
FROM m LEFT JOIN s USING (host)
"""

EXACT = exact_dedup.ORACLE

RUNS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS s FROM documents),
h AS (
  SELECT doc_id, w, len(w) AS n,
    xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM d),
a AS (SELECT doc_id, w, n, h, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
t AS (
  SELECT doc_id, i, w[1 + CASE WHEN p IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word, n
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY 1, 2, 3),
best AS (
  SELECT doc_id, start, length, period FROM r x
  WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
    OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(m) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p, 1 + (1000000000 * (kept.m + 5)) // (v.n + 5 * v.v) AS q
  FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.MOST_TERMS}
"""
