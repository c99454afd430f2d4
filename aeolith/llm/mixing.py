"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks, in DataFrame functions only.

``sized`` counts each document's words once; all that follows reads that table (no texts).
``targets`` shares a budget out by weight: no source is asked for more than ``repeats`` times what it
has, and what it can't give goes to the others by weight until none is over.  ``schedule`` deals
slots of ``block`` words each: slot i stands for the point frac(i * golden ratio), which the sources'
cumulative targets map to a source; any stretch of slots then has each source close to its share.  A
source's slots are ranked, and its slot of rank r takes block r of its documents, which are laid
end to end in the order of a hash and cut into blocks of equal words; after the last block comes the first
again, as a next pass.  The last slot of a source is cut where its target is reached, slots beyond
are left out, and a source that the points gave too few (a few blocks at most) gets the rest after the
last slot.  So what is taken is the target, rounded to a whole word.

Scale: words are added up along a source in three levels (two bytes of the hash, then rows), and slots are ranked
in two, so no task orders a source; only one-row-a-source tables are ordered in one task or broadcast.
A block has at most ``BLOCK`` words whatever the corpus, smaller ones where the budget has under ``SLOTS`` of
these, so that small tables come near their targets too.  Slots and documents meet by (source, block).

A null source is a source, after all others.  Null texts and texts without a word have size 0 and are
never taken.  Long texts are cut by blocks like any others.  The order within a source depends on ids and texts
alone, so reruns agree; rows that are repeated stand side by side, each with words of its own (which of
them is first makes no difference but to which of the equal rows a count goes).  An empty table gives no
rows.  Only the three columns named are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.llm.common import SPACE, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: A budget makes so many slots at least (down to blocks of one word), and a block has so many words at most.
SLOTS, BLOCK = 1 << 14, 1 << 20
#: floor(2 ** 32 / golden ratio): slot i's point is i times that, modulo 2 ** 32.
GOLDEN = 2_654_435_769
_CELL = 20  # points are looked up by their first 12 bits
_CHUNK = 10  # slots are ranked in chunks of 2 ** 10


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key): words of each document, and the hash that orders documents."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), text.alias("t"))
    words = F.size(F.array_remove(F.split("t", SPACE), "")).cast("long")
    return d.select("doc_id", "source", words.alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("t"))).alias("key"))


def block_words(budget: float) -> int:
    return min(BLOCK, max(1, math.ceil(budget / SLOTS)))


def targets(sizes: DataFrame, block: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, place, source_size, target, want, n_blocks, need, lo, hi), one row for each source: its target, in
    whole words, its blocks, how many of them the target takes, and the points (from ``lo`` to before ``hi``) that are its own."""
    all_rows = Window.partitionBy()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("place"))
    by = by.select("*", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).alias("weight"), (F.col("source_size") * repeats).alias("most"))
    # sources that are filled before others need less for their weight
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.select("*", ((F.sum("source_size").over(all_rows) * F.lit(float(share)) - filled) / rest).alias("level"), F.row_number().over(order).alias("k"))
    first = F.min(F.when(F.col("level") < F.col("most") / F.col("weight"), F.struct("k", "level"))).over(all_rows)["level"]
    by = by.select("source", "place", "source_size", F.least(F.col("most").cast("double"), F.coalesce(first * F.col("weight"), F.col("most").cast("double"))).alias("target"))

    w = Window.orderBy("place")
    # where no source has a word, none has points
    part = F.coalesce(F.try_divide(F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("target").over(all_rows)), F.lit(0.0))
    top = F.max(F.when(F.col("target") > 0, F.col("place"))).over(all_rows)
    by = by.select("*", F.floor(F.col("target") + 0.5).alias("want"), F.when(F.col("place") >= top, F.lit(1 << 32)).otherwise(F.floor(part * F.lit(float(1 << 32)))).alias("hi"))
    n = F.ceil(F.col("source_size") / F.lit(block))
    # a source with no words has no blocks, and needs none
    need = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")) * n + F.ceil((F.col("want") % F.col("source_size")) / F.lit(block))).otherwise(F.lit(0))
    return by.select("source", "place", "source_size", "target", "want", n.alias("n_blocks"), need.cast("long").alias("need"), F.coalesce(F.lag("hi").over(w), F.lit(0)).alias("lo"), "hi")


def schedule(spark: SparkSession, plan: DataFrame, block: int, n_slots: int) -> DataFrame:
    """(slot, place, pass, block, words): which block of which source a slot takes, and how many of its words."""
    cells = plan.where("lo < hi").select("place", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", _CELL), F.shiftright(F.col("hi") - 1, _CELL))).alias("cell"))
    s = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % F.lit(1 << 32)).alias("point"))
    s = s.withColumn("cell", F.shiftright("point", _CELL)).join(F.broadcast(cells), "cell").where("point >= lo and point < hi")
    s = s.select("slot", "place", F.shiftright("slot", _CHUNK).alias("chunk"))
    held = s.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    before = held.select("place", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = s.join(before, ["place", "chunk"]).select("slot", "place", (F.col("before") + F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1).alias("r"))

    short = plan.join(F.broadcast(held.groupBy("place").agg(F.sum("n").alias("got"))), "place", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = short.where("got < need").select("place", F.explode(F.sequence("got", F.col("need") - 1)).alias("r"))
    late = late.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("r", "place")) - 1).cast("long").alias("slot"), "place", "r")

    upto = lambda r: F.floor(r / F.col("n_blocks")) * F.col("source_size") + F.least((r % F.col("n_blocks")) * block, F.col("source_size"))
    dealt = ranked.unionByName(late).join(F.broadcast(plan), "place").where("r < need")
    words = F.least(upto(F.col("r") + 1), F.col("want")) - upto(F.col("r"))
    return dealt.select("slot", "place", F.floor(F.col("r") / F.col("n_blocks")).alias("pass"), (F.col("r") % F.col("n_blocks")).alias("block"), words.alias("words"))


def laid_out(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(place, start, size, doc_id): where a document's words begin among those of its source."""
    d = sizes.where("size > 0").join(F.broadcast(plan.select("source", "place")), sizes["source"].eqNullSafe(plan["source"]))
    d = d.select("place", "doc_id", "size", "key", F.substring("key", 1, 2).alias("a"), F.substring("key", 3, 2).alias("b"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = d.groupBy("place", "a", "b").agg(F.sum("size").alias("n"))
    high = low.groupBy("place", "a").agg(F.sum("n").alias("n")).select("place", "a", before("n", Window.partitionBy("place").orderBy("a")).alias("from_a"))
    low = low.select("place", "a", "b", before("n", Window.partitionBy("place", "a").orderBy("b")).alias("from_b"))
    base = low.join(high, ["place", "a"]).select("place", "a", "b", (F.col("from_a") + F.col("from_b")).alias("base"))
    inside = before("size", Window.partitionBy("place", "a", "b").orderBy("key", "doc_id"))
    return d.join(base, ["place", "a", "b"]).select("place", (F.col("base") + inside).alias("start"), "size", "doc_id")


def pieces(placed: DataFrame, slots: DataFrame, block: int, how: str = "inner") -> DataFrame:
    """(slot, pass, place, start, size, doc_id, first, words): the words of a document, from its word ``first`` on,
    that a slot takes.  In the order of slot and start it is the mix.  With ``how="left"`` also, with no
    words, the parts of documents that no slot takes."""
    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(block))
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)), last)).alias("block"))
    both = cut.join(slots, ["place", "block"], how)
    begin = F.greatest("start", F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    both = both.select("slot", "pass", "place", "start", "size", "doc_id", (begin - F.col("start")).alias("first"), F.greatest(end - begin, F.lit(0)).alias("words"))
    return both.where("words > 0") if how == "inner" else both


class Mix:
    """The mix of a table: ``sizes``, ``plan`` (targets), ``slots`` and ``placed`` documents as DataFrames."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, **columns: str):
        spark = docs.sparkSession
        self.sizes = settle(sized(docs, **columns), "sizes")
        budget = min(share, repeats) * self.sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.block = block_words(budget)
        # one row for each source, which all that follows reads
        self.plan = settle(targets(self.sizes, self.block, weights, share, repeats).coalesce(1), "targets")
        self.slots = schedule(spark, self.plan, self.block, math.ceil(budget / self.block))
        self.placed = laid_out(self.sizes, self.plan)

    def pieces(self) -> DataFrame:
        return pieces(self.placed, self.slots, self.block)

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken), one row for each document."""
        each = pieces(self.placed, self.slots, self.block, how="left")
        some = each.groupBy("place", "start", "size", "doc_id").agg(F.sum("words").alias("taken"))
        own = self.plan.select("place", "source", "source_size", "target")
        out = some.join(F.broadcast(own), "place").select("doc_id", "source", "size", "source_size", "target", "taken")
        none = self.sizes.where("size = 0").alias("d").join(F.broadcast(own.alias("p")), F.col("d.source").eqNullSafe(F.col("p.source")))
        return out.unionByName(none.select("doc_id", "d.source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))

