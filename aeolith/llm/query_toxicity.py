"""Query of operator 3."""

from pyspark.sql import functions as F

from aeolith.llm.common import crc_mod, table
from aeolith.llm.toxicity import score, train


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), lambda key: crc_mod(key, 5) != 0)
    s = score(docs, model)
    return s.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))
