"""Query of operator 11."""

from aeolith.llm.common import table
from aeolith.llm.mixing import BLOCK, GOLDEN, SLOTS, Mix


def op11_mixing(spark, sf_dir):
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, place, source_size,
         least(most::DOUBLE, coalesce((SELECT arg_min(level, most / weight) FROM l WHERE level < most / weight) * weight, most::DOUBLE)) AS target
  FROM l),
b AS (
  SELECT least({BLOCK}, greatest(1, ceil(coalesce(1.5 * sum(size), 0) / {SLOTS})))::BIGINT AS block, coalesce(1.5 * sum(size), 0) AS budget FROM d),
h AS (
  SELECT place, source_size, floor(target + 0.5)::BIGINT AS want, block, ceil(budget / block)::BIGINT AS n_slots,
         CASE WHEN place = max(place) OVER () THEN 4294967296
              ELSE floor(sum(target) OVER (ORDER BY place) / sum(target) OVER () * 4294967296)::BIGINT END AS hi
  FROM t, b WHERE target > 0),
p AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0) AS lo, ceil(source_size / block)::BIGINT AS n_blocks,
         (want // source_size) * ceil(source_size / block)::BIGINT + ceil((want % source_size) / block)::BIGINT AS need
  FROM h),
i AS (
  SELECT (unnest(range((SELECT max(n_slots) FROM p))) * {GOLDEN}::HUGEINT) % 4294967296 AS point),
g AS (
  SELECT place, count(*) AS got FROM i, p WHERE point >= lo AND point < hi GROUP BY place),
r AS (
  SELECT p.*, unnest(range(need)) AS r FROM p LEFT JOIN g USING (place)),
u AS (
  SELECT place, r % n_blocks AS block_no, block,
         least(((r + 1) // n_blocks) * source_size + least(((r + 1) % n_blocks) * block, source_size), want)
         - ((r // n_blocks) * source_size + least((r % n_blocks) * block, source_size)) AS words
  FROM r),
a AS (
  SELECT doc_id, size, source_size, target, place,
         coalesce(sum(size) OVER (PARTITION BY place ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         row_number() OVER () AS row_no
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT row_no, place, start, size, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM a, b WHERE size > 0),
k AS (
  SELECT row_no, sum(greatest(0, least(start + size, block_no * block + words) - greatest(start, block_no * block)))::BIGINT AS taken
  FROM c JOIN u USING (place, block_no) GROUP BY row_no)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM a LEFT JOIN k USING (row_no)
"""
