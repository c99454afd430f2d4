"""Query of operator 7."""

from aeolith.llm.chats import collapse
from aeolith.llm.common import table


def op7_chats(spark, sf_dir):
    return collapse(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS s FROM t GROUP BY conv_id),
m AS (SELECT min(conv_id) AS conv_id, s, count(*) AS n_logged FROM c GROUP BY s),
p AS (SELECT DISTINCT s[1:k] AS s FROM (SELECT s, unnest(range(1, len(s))) AS k FROM m))
SELECT conv_id, len(s)::BIGINT AS n_turns, n_logged::BIGINT AS n_logged,
       array_to_string(list_transform(s, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || chr(10)), '') AS rendered
FROM m ANTI JOIN p USING (s)
"""
