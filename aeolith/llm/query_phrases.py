"""Query of operator 12."""

from aeolith.llm.common import table
from aeolith.llm.phrases import collocations


def op12_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, piece
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (
  SELECT id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, g, count(*) AS f FROM (SELECT lang, k, w[i:i + k - 1] AS g, len(w) - i + 1 AS room FROM i, (SELECT unnest(range(1, 5)) AS k)) WHERE room >= k GROUP BY lang, g HAVING count(*) >= 30),
n AS (
  SELECT lang, count(*) AS n FROM i GROUP BY lang),
c AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:]),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
m AS (
  SELECT lang, g[i:i + k - 1] AS g, max(a) AS most
  FROM (SELECT lang, g, f AS a, k, unnest(range(1, len(g) - k + 2)) AS i FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS k FROM f WHERE len(g) > 2))
  GROUP BY 1, 2),
o AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a),
t AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
