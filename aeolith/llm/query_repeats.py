"""Query of operator 5: one row for each span that occurs before, in a document with a smaller id or earlier in the same one,
with the document it is in, the documents (smallest ids) that hold the first copies, and whether it is one of these itself."""

from pyspark.sql import functions as F

from aeolith.llm.common import table
from aeolith.llm.repeats import repeats


def op5_repeats(spark, sf_dir):
    r = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = F.coalesce(F.array_contains("first_ids", F.col("id")), F.lit(False))
    return r.select(F.col("id").alias("doc_id"), "start", "stop", F.col("words").alias("n_words"), "first_ids", own.alias("in_own"))
