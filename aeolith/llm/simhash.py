"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A text's 3-word shingles are hashed (XXH64, seed 42); a fingerprint bit is set if it is
set in over half of the hashes.  Fingerprints link at ``RADIUS`` (2) or fewer differing bits.

1. Documents are grouped by fingerprint (partial aggregation first), so copies cost one row.
2. Each fingerprint is embedded as the bit counts of its 32 two-bit segments, held in
   unary code in one 64-bit word: the Manhattan distance of two embeddings is then the
   number of differing bits of their codes, and never exceeds the Hamming distance.
3. The 32 coordinates form a grid of 5 groups.  Two points at Manhattan distance 2 or less
   agree in at least 3 whole groups, so they share at least one of the 10 cells that fix
   3 groups.  Cells with 2 to ``CELL_MAX`` fingerprints are joined with themselves, pairs
   over the Manhattan bound are dropped, the rest is checked bit by bit.
4. Larger cells are not joined.  Their fingerprints emit their 64 one-bit neighbours and
   themselves: two fingerprints are at 2 bits or less if and only if they share such a
   key, and at most 65 can share one.  So no pair is lost, and the work stays linear.
5. Components by large-star / small-star contraction over the fingerprints that have links.

Null and empty texts have the fingerprint zero; fewer than 3 words are one shingle; long texts
are read whole, and their bits counted in blocks.  Rows with a null id get the component of their
fingerprint (null if it has no other rows).  Repeated ids and rows stay, each with its component;
a bit that is set in just half of the hashes is 0.  An empty table gives no rows.  Only the id and
the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import settle, text_udf

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Larger cells take the neighbour keys instead of the self-join.
CELL_MAX = 64
#: At most so many ids (16 MB) are broadcast.
BROADCAST_IDS = 1_000_000

_LOW = 0x5555555555555555
#: Bits of the five groups of coordinates: 7, 7, 6, 6 and 6 segments of two bits.
_GROUPS = [((1 << n) - 1) << at for at, n in ((0, 14), (14, 14), (28, 12), (40, 12), (52, 12))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Each cell fixes three of the five groups.
CELLS = [_signed(_GROUPS[a] | _GROUPS[b] | _GROUPS[c]) for a in range(5) for b in range(a + 1, 5) for c in range(b + 1, 5)]


def fingerprint(text: str | None) -> bytes:
    """The fingerprint's 8 bytes, highest first."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return bytes(8)
    flat = b" ".join(w)
    if len(w) <= SHINGLE:
        return xxhash.xxh64_digest(flat, SEED)
    gap = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    start = np.concatenate(([0], gap + 1))[: len(w) - SHINGLE + 1].tolist()
    end = np.concatenate((gap, [len(flat)]))[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(start, end)]), np.uint8).reshape(-1, 8)
    n = len(hashes)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        count += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > n).tobytes()


def _kernel():
    def work(texts: list[str]) -> dict[str, list]:
        return {"fp": np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64)}

    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    fp = text_udf(_kernel, {"fp": pa.int64()}, "struct<fp:bigint>")
    return docs.select(docs[id_col].alias("id"), fp(docs[text_col])["fp"].alias("fp"))


def unary_code(fp: Column) -> Column:
    """The segment-popcount embedding: in each two-bit segment 00, 01 or 11 for 0, 1 or 2 set bits."""
    up = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(points: DataFrame) -> DataFrame:
    """(cell, mask number, fp, code): ten rows for each fingerprint."""
    code = points.withColumn("code", unary_code(F.col("fp")))
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(CELLS)])
    return code.select("fp", "code", F.explode(keys).alias("c")).select("c.k", "c.cell", "fp", "code")


def links(points: DataFrame, cell_max: int = CELL_MAX) -> DataFrame:
    """(a, b), a < b: links between the distinct fingerprints of ``points`` (column fp) that
    have the same components as all links, and hold each link outside the large cells."""
    cells = _cells(points)
    sizes = cells.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(cells.join(sizes, ["k", "cell"]), "cells")
    small = shared.where(F.col("n") <= cell_max).drop("n")
    x, y = small.alias("x"), small.alias("y")
    near = (
        x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")))
        .where(F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= RADIUS)
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    large = shared.where(F.col("n") > cell_max).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    keyed = large.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    # at most 65 fingerprints share a key
    stars = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    starred = stars.select("a", F.explode("all").alias("b")).where("a < b")
    return near.unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node that it reaches.

    Large-star then small-star, each round settled in the shared folder, until a round
    changes nothing.  Rounds grow with the logarithm of the longest path.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = settle(small, "star")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_max: int = CELL_MAX) -> DataFrame:
    """(id, fp, root, component): one row for each row of ``docs``; root is the class's
    smallest linked fingerprint, component its smallest id."""
    marked = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    points = settle(marked.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(links(points.select("fp"), cell_max))
    linked = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = linked.groupBy("root").agg(F.min("least").alias("component"))
    own = linked.join(classes, "root").select("fp", "root", "component")
    return marked.join(own, "fp").select("id", "fp", "root", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id.

    The ids to remove are broadcast only if there are at most ``BROADCAST_IDS`` of them,
    else joined by a shuffle.  If ids are null or repeated, rows are told apart by
    fingerprint as well, and one row of a class stays all the same.
    """
    near = settle(near_duplicates(docs, id_col, text_col), "near")
    if near.where("id is null").isEmpty() and near.groupBy("id").count().where("count > 1").isEmpty():
        gone = near.where("id <> component").select(F.col("id").alias("__gone"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    fp = text_udf(_kernel, {"fp": pa.int64()}, "struct<fp:bigint>")
    own = near.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component").alias("__component")).distinct()
    rows = docs.withColumn("__own", fp(docs[text_col])["fp"])
    rows = rows.join(own, F.col("__own") == F.col("__fp")).where(F.col(id_col).eqNullSafe(F.col("__component")))
    return rows.dropDuplicates(["__root"]).select(*docs.columns)
