"""Query of operator 2."""

from pyspark.sql import functions as F

from aeolith.llm.common import table
from aeolith.llm.pii import TYPES, replace

#: Where a session can hold a secret key of its own, and the key if it doesn't.
KEY_SETTING, KEY = "spark.aeolith.pii.key", "op2"


def op2_pii(spark, sf_dir):
    r = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, KEY))
    return r.select("doc_id", *[F.coalesce(F.col("pii")[t], F.lit(0)).cast("long").alias(f"n_{t}") for t in TYPES], "text")
