"""DuckDB SQL that states the results of the operators which SQL can express."""

NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
           THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
           ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id
"""

SOURCE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce(CAST(doc_id AS VARCHAR), '') AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER w, 0) AS BIGINT) AS above,
         CAST(2 * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS BIGINT) AS below
  FROM sources
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT above AS a, below AS b FROM levels WHERE above * weight <= cap * below
  ORDER BY cap / weight, above, below LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST(weight * a AS DOUBLE) / b, CAST(cap AS DOUBLE))) AS target
  FROM levels LEFT JOIN level ON true),
quotas AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS whole
  FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.whole, q.quota - q.whole * q.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM ranked
"""

_SPANS = r"""
placed AS (
  SELECT doc_id, n, a, b, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, a) AS place FROM runs),
covered AS (
  SELECT DISTINCT doc_id, n, unnest(range(a, b + 1)) AS item FROM placed WHERE place > 1),
islands AS (
  SELECT doc_id, n, item, item - row_number() OVER (PARTITION BY doc_id ORDER BY item) AS island FROM covered),
spans AS (
  SELECT doc_id, n, min(item) AS a, max(item) AS b FROM islands GROUP BY doc_id, n, island)
SELECT doc_id, CAST(n AS BIGINT) AS {count}, CAST(sum(b - a + 1) AS BIGINT) AS n_deleted,
       string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ';' ORDER BY a) AS deleted
FROM spans GROUP BY doc_id, n
"""

LINE_DEDUP = (
    r"""
WITH listed AS (
  SELECT doc_id, list_transform(
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')),
           lambda x: regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS items
  FROM documents),
windows AS (
  SELECT doc_id, len(items) AS n, items, unnest(range(0, greatest(len(items) - 2, 1))) AS a FROM listed WHERE len(items) > 0),
lines AS (SELECT doc_id, len(items) AS n, unnest(range(0, len(items))) AS a, unnest(items) AS run FROM listed WHERE len(items) > 1),
runs AS (
  SELECT doc_id, n, a, least(a + 2, n - 1) AS b, array_to_string(items[a + 1 : a + 3], chr(10)) AS run FROM windows
  UNION ALL
  SELECT doc_id, n, a, a AS b, run FROM lines WHERE len(regexp_extract_all(run, '[^\x20\x09-\x0D]+')) >= 20),"""
    + _SPANS.format(count="n_lines")
)

SPAN_DEDUP = (
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS w FROM (
    SELECT doc_id, list_transform(
             string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '([.!?,;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
             lambda y: regexp_extract_all(y, '[^\x20\x09-\x0D]+')) AS x
    FROM documents)),
cut AS (
  SELECT doc_id, line, w, unnest(range(0, len(w), 12)) AS o FROM lines),
sentences AS (
  SELECT doc_id, row_number() OVER p - 1 AS item, CAST(sum(len(w[o + 1 : o + 12])) OVER p AS BIGINT) AS upto,
         CAST(sum(len(w[o + 1 : o + 12])) OVER p - len(w[o + 1 : o + 12]) AS BIGINT) AS before,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM cut WINDOW p AS (PARTITION BY doc_id ORDER BY line, o)),
every AS (
  SELECT doc_id, flatten(list(w ORDER BY line)) AS w FROM lines GROUP BY doc_id),
runs AS (
  SELECT x.doc_id, x.n, x.item AS a, y.item AS b, array_to_string(w[x.before + 1 : y.upto], ' ') AS run
  FROM sentences x ASOF JOIN sentences y ON x.doc_id = y.doc_id AND x.before + 30 <= y.upto JOIN every e ON e.doc_id = x.doc_id),"""
    + _SPANS.format(count="n_sentences")
)
