"""Query of operator 13."""

from aeolith.llm.common import table
from aeolith.llm.prefixes import encoded, rebuilt, sequences, trie


def op13_prefixes(spark, sf_dir):
    return trie(sequences(rebuilt(encoded(table(spark, sf_dir, "conversations")))))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS s,
         (xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
            lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)::UBIGINT[]), lambda b, y: xor(b >> 1, 3988292384::UBIGINT * (b & 1)))),
          4294967295::UBIGINT) % 9)::BIGINT AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT o.conv_id, CASE WHEN o.conv_id % 5 = 0 THEN o.s ELSE list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) END AS s
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
p AS (
  SELECT conv_id, d, s[1:d] AS s, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (
  SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(s[d].text) END AS own
  FROM p GROUP BY s, d),
c AS (
  SELECT s[1:d - 1] AS s, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (s)),
u AS (
  SELECT s[1:k] AS s, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT s, own, n_children, unnest(range(d + 1)) AS k FROM f) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (s) LEFT JOIN n q ON f.d > 0 AND q.s = f.s[1:f.d - 1]
"""
