"""Equivalent SQL of those queries that it can express."""

CRC = """crct AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text; needs the table ``crct`` beside it."""
    digits = f"[CAST(ord(x) AS BIGINT) for x in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


PERIODIC_RUNS = f"""WITH {CRC},
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         {crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents CROSS JOIN crct),
cut AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM doc),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
plain AS (SELECT rid, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS w FROM per),
place AS (SELECT rid, n, i, CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END AS j FROM per, unnest(range(n)) u(i)),
word AS (SELECT place.rid, n, place.i, w FROM place JOIN plain ON plain.rid = place.rid AND plain.i = place.j),
pair AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 3),
island AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair),
stretch AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY rid, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (
  SELECT * FROM stretch r
  WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
of_doc AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY rid),
best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT rid, i FROM run, unnest(range(s + q, s + l)) u(i)),
kept AS (
  SELECT word.rid, string_agg(w, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON gone.rid = word.rid AND gone.i = word.i GROUP BY word.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period,
       CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN of_doc USING (rid) LEFT JOIN best b USING (rid) LEFT JOIN kept USING (rid)"""

PREFIX_TRIE = f"""WITH {CRC},
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
size AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
conv AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS lent
  FROM (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM size CROSS JOIN crct) c
  LEFT JOIN size b ON b.conv_id = c.base),
turn AS (
  SELECT conv.conv_id, i + 1 AS depth, role, text FROM conv JOIN own ON own.conv_id = conv.base AND i < h
  UNION ALL SELECT conv.conv_id, lent + i - h + 1, role, text FROM conv JOIN own ON own.conv_id = conv.conv_id AND i >= h),
step AS (
  SELECT conv_id, depth, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turn
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM step GROUP BY path, depth),
child AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(path, 32 * a) AS path, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((n - 1) * size) AS saved
  FROM (SELECT node.*, k FROM node LEFT JOIN child USING (path)) x, unnest(range(depth + 1)) u(a) GROUP BY 1),
tail AS (SELECT conv_id, path FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS t FROM tail GROUP BY path)
SELECT node.depth, node.conv_id, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(t, '')) AS ends_sha256
FROM node LEFT JOIN node up ON node.depth > 0 AND up.path = left(node.path, 32 * (node.depth - 1))
LEFT JOIN child ON child.path = node.path JOIN below ON below.path = node.path LEFT JOIN ends ON ends.path = node.path"""

EXACT_TOP_K = """WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 10"""
