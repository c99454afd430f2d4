"""Query of operator 1."""

import public_tokenizers

from aeolith.llm.byte_bpe import encode
from aeolith.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(RANKS), fields=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "bpe.*")
