"""DuckDB SQL for the operators 11 to 13, written apart from their code."""

from __future__ import annotations

#: crc32 (reflected polynomial 0xEDB88320) of a blob ``b``: one table, one fold.
_CRC_TABLE = """crc_steps(i, c, k) AS (
  SELECT i::UINTEGER, i::UINTEGER, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def _crc32(blob: str) -> str:
    """Needs ``crc`` among the tables of the query."""
    return f"""xor(4294967295::UINTEGER, list_reduce(
  list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::UINTEGER),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::UINTEGER))::BIGINT"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS v
         FROM kept, range({parts}) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id, x) - 1 AS k FROM kept),
b0 AS (SELECT p, k, v AS e FROM part JOIN first USING (vec_id) WHERE k < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, e),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS m
  FROM part JOIN b{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b{r}.p, b{r}.k, coalesce(n.e, b{r}.e) AS e
  FROM b{r} LEFT JOIN (
    SELECT p, k, list(c ORDER BY i) AS e FROM (
      SELECT p, k, i, (s - ((s % n) + n) % n) // n AS c FROM (
        SELECT p, m.k AS k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL))
    GROUP BY p, k) n USING (p, k))""")
    return ",".join(steps) + f""",
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS s FROM b{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.k::INT), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
          FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


OP11_SQL = _op11()


def _draw(shard: str) -> str:
    return (f"((('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, 'null') || '@' || {shard}), 1, 13))::BIGINT + 0.5::DOUBLE)"
            " / 4503599627370496::DOUBLE)")


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
        {_crc32("encode(coalesce(text, ''))")} AS text_crc32 FROM documents, crc),
cost AS (SELECT r, s, -ln({_draw("s")}) AS c FROM d, range(9) g(s)),
best AS (SELECT r, arg_min(s, c) FILTER (s < 8) AS shard, arg_min(s, c) AS grown_shard FROM cost GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce('=' || doc_id::VARCHAR, 'null') || '#'),
                     doc_id, size, text_crc32) - 1 AS slot
FROM d JOIN best USING (r)
"""


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
        substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS dg
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos FROM t),
c AS (SELECT conv_id, {_crc32("encode(conv_id::VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
lent AS (SELECT c.conv_id, o.pos, o.bytes, o.dg FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos <= c.h),
n_lent AS (SELECT conv_id, count(*) AS k FROM lent GROUP BY conv_id),
r AS (SELECT * FROM lent
      UNION ALL
      SELECT conv_id, pos - h + coalesce(k, 0), bytes, dg FROM o JOIN c USING (conv_id) LEFT JOIN n_lent USING (conv_id)
      WHERE pos > h),
p AS MATERIALIZED (
  SELECT conv_id, pos, bytes, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT arg_max(path, pos) AS path, conv_id FROM p GROUP BY conv_id),
sha AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM ends GROUP BY path),
node AS MATERIALIZED (
  SELECT path, pos AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY ALL),
kids AS (SELECT left(path, (depth::INT - 1) * 32) AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (path)),
tree AS (SELECT a.path, count(*) FILTER (x.k = 0) AS leaves, sum((x.n - 1) * x.bytes) AS saved
         FROM full_node x JOIN p a ON a.conv_id = x.conv_id AND a.pos <= x.depth GROUP BY a.path)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, tree.leaves AS n_leaves,
  tree.saved::BIGINT AS saved_tokens, coalesce(sha.s, sha256('')) AS ends_sha256
FROM full_node x JOIN tree USING (path) LEFT JOIN sha USING (path)
LEFT JOIN node up ON x.depth > 0 AND up.path = left(x.path, (x.depth::INT - 1) * 32)
"""
