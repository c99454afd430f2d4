"""Query of operator 8."""

from pyspark.sql import functions as F

from aeolith.llm.common import table
from aeolith.llm.secrets import BASE_KINDS, scan, spelled


def op8_secrets(spark, sf_dir):
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    return s.select("doc_id", *map(of, BASE_KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))
