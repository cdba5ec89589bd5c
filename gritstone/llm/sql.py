"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: A pass over the url with the same rules and counts as the operator's, in one statement.
OP8 = r"""
WITH after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM after),
named AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '.') AS parts FROM split),
two AS (SELECT *, array_to_string(parts, '.') AS name, array_to_string(parts[-2:], '.') AS last_two FROM named),
sorts AS (SELECT *, regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') AS address, regexp_matches(last_two,
  '^(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}$') AS long FROM two),
levels AS (
  SELECT page_id, host, path, CASE WHEN address THEN name WHEN long THEN array_to_string(parts[-3:], '.') ELSE last_two END AS domain,
    CASE WHEN address THEN 'ip' WHEN long THEN last_two ELSE parts[-1] END AS suffix
  FROM sorts),
known AS (SELECT l.*, q.quality AS good FROM levels l LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)) q ON q.doc_id = l.page_id),
h AS (SELECT host, domain, suffix, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS g FROM known GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(g) AS g, (sum(sum(g)) OVER () + 0.5::DOUBLE) / (sum(sum(n)) OVER () + 1) AS p FROM d GROUP BY suffix),
ss AS (SELECT sum((g - n * p) * (g - n * p) - n * p * (1 - p)) AS beyond, sum(n * p * (1 - p) * (n - 1)) AS room FROM s),
sw AS (SELECT CASE WHEN coalesce(room, 0) = 0 THEN 20::DOUBLE WHEN beyond > 0 THEN least(greatest(room / beyond - 1, 1), 1000) ELSE 1000 END AS w FROM ss),
sp AS (SELECT suffix, (g + p * w) / (n + w) AS p FROM s, sw),
dd AS (SELECT d.*, sp.p FROM d JOIN sp USING (suffix)),
ds AS (SELECT sum((g - n * p) * (g - n * p) - n * p * (1 - p)) AS beyond, sum(n * p * (1 - p) * (n - 1)) AS room FROM dd),
dw AS (SELECT CASE WHEN coalesce(room, 0) = 0 THEN 20::DOUBLE WHEN beyond > 0 THEN least(greatest(room / beyond - 1, 1), 1000) ELSE 1000 END AS w FROM ds),
dp AS (SELECT domain, suffix, (g + p * w) / (n + w) AS p FROM dd, dw),
hh AS (SELECT h.*, dp.p FROM h JOIN dp USING (domain, suffix)),
hs AS (SELECT sum((g - n * p) * (g - n * p) - n * p * (1 - p)) AS beyond, sum(n * p * (1 - p) * (n - 1)) AS room FROM hh),
hw AS (SELECT CASE WHEN coalesce(room, 0) = 0 THEN 20::DOUBLE WHEN beyond > 0 THEN least(greatest(room / beyond - 1, 1), 1000) ELSE 1000 END AS w FROM hs),
hp AS (SELECT host, g + p * w AS a, n - g + (1 - p) * w AS b FROM hh, hw),
bound AS (SELECT host, 1 / (1 + exp(1.645::DOUBLE * sqrt(1 / a + 1 / b) - ln(a / b))) AS bound FROM hp),
ruled AS (
  SELECT page_id, l.host, l.path, bound,
    CASE WHEN (l.host = 'example.org' OR l.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (l.host = 'example.org' OR l.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (l.host = 'com' OR l.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (l.host = 'com' OR l.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (l.host = 'org' OR l.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM levels l JOIN bound USING (host))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' WHEN
    'com/de/' THEN 'block'
       ELSE CASE WHEN bound >= 0.85 THEN 'allow' ELSE 'block' END END AS verdict,
  round(bound, 9) AS bound
FROM ruled
"""

#: A mean of over 16 is drawn as the sum of equal draws of at most 16.
OP9 = r"""
WITH counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
means AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE / n AS mean FROM counts),
split AS (SELECT source, greatest(1, ceil(mean / 16.0::DOUBLE))::BIGINT AS draws, mean / greatest(1, ceil(mean / 16.0::DOUBLE)) AS mean FROM means),
terms AS (SELECT source, k, exp(-mean) * pow(mean, k) / CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE list_product(range(1, k + 1)::DOUBLE[]) END AS p
  FROM split, range(0, 64) r(k)),
cdf AS (SELECT source, list(c ORDER BY k) AS c FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
keyed AS (
  SELECT d.doc_id, d.source, d.text, coalesce(CAST(d.doc_id AS VARCHAR), '') AS key, c, unnest(range(1, draws + 1)) AS draw
  FROM documents d JOIN split s ON s.source = coalesce(d.source, '') JOIN cdf ON cdf.source = s.source),
drawn AS (SELECT *, (('0x' || substr(md5(CASE WHEN draw = 1 THEN '17|' || key ELSE '17|draw|' || draw || '|' || key END), 1, 12))::BIGINT +
  0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM keyed),
counted AS (SELECT doc_id, source, text, key, sum(len(list_filter(c, lambda x: x < u)))::INTEGER AS n FROM drawn GROUP BY doc_id, source, text, key)
SELECT doc_id, source, text, copy::INTEGER AS copy, md5('order 17|' || key || '|' || copy) AS order_key
FROM (SELECT doc_id, source, text, key, unnest(range(0, n)) AS copy FROM counted WHERE n > 0)
"""

OP1 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         lead(doc_id) OVER (ORDER BY doc_id) AS after, first_value(doc_id) OVER (ORDER BY doc_id) AS start
  FROM documents),
edit AS (
  SELECT b.doc_id, b.text, b.n, coalesce(b.after, b.start) AS next_id, substr(b.text, 1, b.n - b.n // 2) || substr(x.text, 1, b.n // 2) AS edited
  FROM base b JOIN base x ON x.doc_id = coalesce(b.after, b.start)),
texts AS (SELECT doc_id, 0 AS k, text FROM edit UNION ALL SELECT doc_id, 1, edited FROM edit),
terms AS (
  SELECT doc_id, k, unnest(list_distinct(list_filter(
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS t
  FROM texts),
df AS (SELECT t, count(*) AS df FROM terms WHERE k = 0 GROUP BY t),
lex AS (SELECT t FROM df WHERE df >= greatest(1, 0.001::DOUBLE * (SELECT count(*) FROM documents)) AND df <= greatest(1, 0.05::DOUBLE * (SELECT
  count(*) FROM documents))),
kept AS (SELECT doc_id, k, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM terms JOIN lex USING (t)),
whole AS (SELECT doc_id, k, substr(md5(string_agg(h::VARCHAR, ' ' ORDER BY h)), 1, 16) AS h FROM kept GROUP BY ALL),
all_terms AS (SELECT doc_id, k, substr(md5(string_agg(t, ' ' ORDER BY t)), 1, 16) AS h FROM terms GROUP BY ALL),
dealt AS (
  SELECT doc_id, k, h, (h & 3) * 4 + ((h >> 2) & 3) AS pos FROM kept
  UNION ALL SELECT doc_id, k, h, 16 + ((h >> 6) & 15) FROM kept WHERE (h >> 4) & 3 = 0
  UNION ALL SELECT doc_id, k, h, 32 + ((h >> 13) & 31) FROM kept WHERE (h >> 10) & 7 = 0),
parts AS (SELECT doc_id, k, pos, substr(md5(string_agg(h::VARCHAR, ' ' ORDER BY h)), 1, 8) AS h FROM dealt GROUP BY ALL),
names AS (SELECT unnest(range(0, 64)) AS pos),
grid AS (
  SELECT x.doc_id, x.k, list(coalesce(p.h, '') ORDER BY n.pos) AS hs
  FROM texts x CROSS JOIN names n LEFT JOIN parts p ON p.doc_id = x.doc_id AND p.k = x.k AND p.pos = n.pos GROUP BY ALL),
prints AS (
  SELECT g.doc_id, g.k, list_concat([coalesce(w.h, z.h, substr(md5(''), 1, 16))], hs) AS f
  FROM grid g LEFT JOIN whole w ON w.doc_id = g.doc_id AND w.k = g.k LEFT JOIN all_terms z ON z.doc_id = g.doc_id AND z.k = g.k),
pairs AS (
  SELECT e.doc_id, e.n, e.edited, o.f AS f, d.f AS g, x.f AS h
  FROM edit e JOIN prints o ON o.doc_id = e.doc_id AND o.k = 0 JOIN prints d ON d.doc_id = e.doc_id AND d.k = 1 JOIN prints x ON x.doc_id =
    e.next_id AND x.k = 0)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f, '.') AS fingerprint, array_to_string(g, '.') AS edited_fingerprint,
  len(list_filter(list_zip(f, g), lambda p: p[1] = p[2] AND p[1] <> ''))::DOUBLE / len(list_filter(list_zip(f, g), lambda p: p[1] <> '' OR p[2] <>
    '')) AS near_edited,
  len(list_filter(list_zip(f, h), lambda p: p[1] = p[2] AND p[1] <> ''))::DOUBLE / len(list_filter(list_zip(f, h), lambda p: p[1] <> '' OR p[2] <>
    '')) AS near_next
FROM pairs
"""

#: Every document scored for every item that shares a term with it.
OP11 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE doc_id IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
held AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY t, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
adds AS (
  SELECT h.doc_id, h.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS part
  FROM held h JOIN lengths USING (doc_id) JOIN weights USING (t), whole WHERE t IN (SELECT t FROM asked)),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN adds USING (t) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

ORACLES: dict[str, str] = {"op1_imatch": OP1, "op8_url_filter": OP8, "op9_mixing": OP9, "op11_treaps": OP11}
