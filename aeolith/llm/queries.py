"""The queries of this folder and, where SQL can express them, their DuckDB SQL."""

from aeolith.llm.query_byte_bpe import op1_byte_bpe
from aeolith.llm.query_chats import OP7_SQL, op7_chats
from aeolith.llm.query_decontaminate import OP10_SQL, op10_decontaminate
from aeolith.llm.query_lm import op6_lm
from aeolith.llm.query_mixing import OP11_SQL, op11_mixing
from aeolith.llm.query_phrases import OP12_SQL, op12_phrases
from aeolith.llm.query_pii import op2_pii
from aeolith.llm.query_prefixes import OP13_SQL, op13_prefixes
from aeolith.llm.query_quality import OP4_SQL, op4_quality
from aeolith.llm.query_repeats import op5_repeats
from aeolith.llm.query_secrets import op8_secrets
from aeolith.llm.query_simhash import op9_simhash
from aeolith.llm.query_toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_pii, op3_toxicity, op4_quality, op5_repeats, op6_lm, op7_chats, op8_secrets, op9_simhash, op10_decontaminate, op11_mixing, op12_phrases, op13_prefixes)
}
SQL: dict[str, str] = {"op4_quality": OP4_SQL, "op7_chats": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_mixing": OP11_SQL, "op12_phrases": OP12_SQL, "op13_prefixes": OP13_SQL}
