"""Query of operator 9."""

from pyspark.sql import functions as F

from aeolith.llm.common import table
from aeolith.llm.simhash import near_duplicates


def op9_simhash(spark, sf_dir):
    near = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
