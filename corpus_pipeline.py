"""From raw documents to token ids: five stages, each an operator of ``aeolith.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's ``docs``.  All but the last return the columns
of the documents.

Rows with null texts stay through all stages that keep clean documents (they are clean, and
near-copies of empty texts), and are encoded to no ids; rows with null ids are kept or dropped
as others are; repeated rows are near-copies of each other, so one stays; an empty table gives
an empty table.  Columns beyond those of the documents stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith import scratch
from aeolith.llm import byte_bpe, decontaminate, secrets, simhash, toxicity
from aeolith.llm.common import crc_mod, settle, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the score is learned from the labelled training rows."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda key: crc_mod(key, 5) != 0)
    return toxicity.score(docs, model, to="__toxicity").where(F.col("__toxicity")["score"] < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth or more go."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to the name of its kind; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of the ids and of the bytes they decode to."""
    fields = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return byte_bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), fields=fields).select("doc_id", "bpe.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("byte-level BPE", encode),
]

#: SQL can express neither the learned score nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = scratch.made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage{k}")
            # what the stage wrote on its way isn't read again
            scratch.drop_since(spark, mark, keep=1)
    return docs
