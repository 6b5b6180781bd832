"""The SQL of those operators that SQL can express, for DuckDB over the whole tables."""

from .secrets import RULES


def _sql_spans(rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(hit, '{pattern}', {rule.value_group})" if rule.value_group else "hit"
    return f"""
    SELECT blob, {rank} AS rank, '{rule.kind}' AS kind, upto AS start, upto + length(hit) AS stop
    FROM (
      SELECT blob, n, hit,
             sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY blob ORDER BY n
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM (
        SELECT blob, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, generate_subscripts(hits, 1) AS n
        FROM (SELECT blob, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS pieces
              FROM blobs)
      )
      WINDOW w AS (PARTITION BY blob ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ) WHERE length({value}) >= {rule.least}"""


def _secrets_sql() -> str:
    spans = " UNION ALL ".join(_sql_spans(r, n) for n, r in enumerate(RULES))
    one = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT DISTINCT blob, t FROM d),
spans AS ({spans}),
found AS (
  SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
         string_agg({one}, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (blob)"""


SECRETS_SQL = _secrets_sql()

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM totals),
filling AS (
  SELECT *, 2 * source_size / weight AS full_at, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY full_at, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filling),
aims AS (
  SELECT source, source_size,
         coalesce(least(weight * max(CASE WHEN level <= full_at THEN level END) OVER (),
                        (2 * source_size)::DOUBLE), 0)::DOUBLE AS target
  FROM levels),
passes AS (
  SELECT s.doc_id, s.source, s.key, s.size, p.pass,
         (p.pass * a.source_size + CAST(sum(s.size) OVER (PARTITION BY s.source, p.pass ORDER BY s.key) AS BIGINT))::DOUBLE
           / a.target AS finish
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source CROSS JOIN (VALUES (0), (1)) p(pass)
  WHERE a.target > 0),
reached AS (SELECT *, sum(size) OVER (ORDER BY finish) AS reach FROM passes),
last AS (
  SELECT source, pass, max(key) AS key FROM reached
  WHERE reach <= (SELECT sum(target) FROM aims) GROUP BY source, pass)
SELECT s.doc_id, s.size, a.source_size, a.target,
       CAST(s.size * (SELECT count(*) FROM last l WHERE l.source IS NOT DISTINCT FROM s.source AND s.key <= l.key)
            AS BIGINT) AS taken
FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source"""


# CRC-32 bit by bit over the decimal digits of an id, as unsigned.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32]) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS size,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
keyed AS (SELECT conv_id, depth, size, md5(path) AS node FROM steps),
n AS (SELECT node, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs
      FROM keyed GROUP BY node),
up AS (SELECT n.node, k.node AS above FROM n JOIN keyed k ON k.conv_id = n.conv_id AND k.depth <= n.depth),
parents AS (SELECT n.node, p.node AS parent, p.conv_id AS parent_conv_id
            FROM n JOIN keyed k ON k.conv_id = n.conv_id AND k.depth = n.depth - 1 JOIN n p ON p.node = k.node),
children AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
sums AS (
  SELECT up.above AS node, count(*) FILTER (children.node IS NULL) AS n_leaves,
         CAST(sum((n.n_convs - 1) * n.size) AS BIGINT) AS saved_tokens
  FROM up JOIN n ON n.node = up.node LEFT JOIN children ON children.node = up.node GROUP BY up.above),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS back FROM keyed) WHERE back = 1 GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN parents USING (node) LEFT JOIN ends USING (node)"""

AUDIT_SQL = r"""
WITH marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
  FROM texts LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, good, toxic, count(*) AS n,
         concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS failed
  FROM fails GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT m.*, filter_order, step, filter_order[step:step] AS x,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda c: c <> '' AND contains(failed, c))) > 0 AS gone
  FROM masks m, orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
counted AS (SELECT *, contains(failed, x) AS bad FROM steps)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (gone AND bad), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (failed = x), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(len(failed), 1))) FILTER (bad), 0) AS BIGINT) AS shapley
FROM counted GROUP BY part, filter_order, step"""
