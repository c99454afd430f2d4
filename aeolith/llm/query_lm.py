"""Query of operator 6."""

import public_tokenizers
from pyspark.sql import functions as F

from aeolith.llm.common import crc_mod, table
from aeolith.llm.lm import score, train

RANKS = "byte_bpe_multi_50k.tiktoken"


def op6_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(RANKS)
    model, counts = train(docs.where(crc_mod(F.col("doc_id"), 7) != 2), path)
    s = score(docs, model, counts, path)
    return s.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
