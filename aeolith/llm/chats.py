"""Chat formatting: collapse cumulative snapshots, then render, in DataFrame functions only.

A service that logs a conversation after each turn leaves many prefixes of one another.
Each conversation's turns get a rolling prefix hash: the running exclusive-or of 128-bit
hashes of (place, role, text).  Conversations equal in full are one (the smallest conv_id
stays); the distinct full hashes are anti-joined with the distinct hashes of all shorter
prefixes, which leaves the maximal conversations; these are rendered.

Texts go through one shuffle, which brings a conversation's turns together; what is hashed
and what is rendered both read that.  All else that is shuffled are hashes and ids.  Copies
meet only in aggregates by hash, which are combined before the shuffle, so a conversation
that is logged very often doesn't gather in one task.  The turns of one conversation end in
one rendered row, so they come to one task.

Turns are ordered by (turn, role, text), nulls first; a row that is repeated counts once.
A null role or text differs from an empty one in comparisons and is rendered as empty; long
texts are hashed and rendered whole.  A row with a null conv_id is a conversation by itself
(equal ones count once), and keeps the null unless a conversation with an id equals it.
Only the four columns are read, whatever others there are.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

TEMPLATE_HEAD, TEMPLATE_TAIL, TURN_END = "<|", "|>\n", "\n"


def gathered(conversations: DataFrame) -> DataFrame:
    """(key: tells the conv_id, or a row that has none; turns: sorted structs of turn, role, text)."""
    row = F.struct("turn", "role", "text")
    alone = F.concat_ws(",", F.lit("row"), F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit("second"), "turn", "role", "text"))
    key = F.when(F.col("conv_id").isNull(), alone).otherwise(F.concat(F.lit("id,"), F.col("conv_id").cast("string")))
    # never null, and nothing but these two columns, so that all that reads them shares one shuffle
    d = conversations.select("conv_id", "turn", "role", "text").select(F.coalesce(key, F.lit("")).alias("key"), row.alias("row"))
    return d.groupBy("key").agg(F.array_sort(F.collect_set("row")).alias("turns"))


def id_of(key: Column, kind: DataType) -> Column:
    """The conv_id that a key tells."""
    return F.when(key.startswith("id,"), F.substring(key, 4, 2**31 - 1).cast(kind))


def prefix_hashes(whole: DataFrame) -> DataFrame:
    """(key, pos, p1, p2, last) of ``gathered`` conversations: for each turn the hash of the
    conversation up to here."""
    t = whole.select("key", F.posexplode("turns").alias("pos", "x"))
    what = [F.col("pos"), F.col("x.role").isNull(), F.col("x.role"), F.col("x.text").isNull(), F.col("x.text")]
    t = t.select("key", "pos", F.xxhash64(*what).alias("h1"), F.xxhash64(F.lit("second"), *what).alias("h2"))
    w = Window.partitionBy("key").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("key", "pos", F.bit_xor("h1").over(run).alias("p1"), F.bit_xor("h2").over(run).alias("p2"), F.lead("pos").over(w).isNull().alias("last"))


def maximal(hashed: DataFrame, kind: DataType) -> DataFrame:
    """(key, n_turns, n_logged): one row for each conversation that no longer one begins with;
    n_logged counts the conversations that are exactly it."""
    own = id_of(F.col("key"), kind)
    best = F.min(F.struct(own.isNull().alias("none"), own.alias("conv_id"), "key")).alias("best")
    full = hashed.where("last").groupBy("p1", "p2", "pos").agg(best, F.count("*").alias("n_logged"))
    shorter = hashed.where("not last").select("p1", "p2", "pos").distinct()
    top = full.join(shorter, ["p1", "p2", "pos"], "left_anti")
    return top.select("best.key", (F.col("pos") + 1).cast("long").alias("n_turns"), "n_logged")


def rendered(turns):
    """An array of turns as text."""
    one = lambda x: F.concat(F.lit(TEMPLATE_HEAD), F.coalesce(x["role"], F.lit("")), F.lit(TEMPLATE_TAIL), F.coalesce(x["text"], F.lit("")), F.lit(TURN_END))
    return F.array_join(F.transform(turns, one), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, rendered) of the maximal conversations."""
    whole, kind = gathered(conversations), conversations.schema["conv_id"].dataType
    top = maximal(prefix_hashes(whole), kind)
    return whole.join(top, "key").select(id_of(F.col("key"), kind).alias("conv_id"), "n_turns", "n_logged", rendered(F.col("turns")).alias("rendered"))
