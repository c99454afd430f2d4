"""Prefix trie of conversations: distributed MSD radix partitioning over dictionary-encoded turn ids.

Turns (role, text) get ids from a dictionary of their distinct 128-bit hashes, so a conversation is one row of
numbers; texts are read once and never shuffled.  Conversations that are equal in full are one row
with a count, and the digest of their ids is made by a stream over sorted chunks, so a
conversation that is logged very often is never gathered.

Rows then go into buckets by their turn at the depth reached.  A bucket of at most ``TURNS`` turns, or of one row,
is finished by one task, where multikey quicksort (three parts by a pivot's turn, the equal part one turn deeper)
makes its nodes.  A larger one is a node itself, and its rows go on to the next round; what all of its rows have
in common beyond this turn is what its least and its greatest row have in common, and is passed in the same round
as a chain of nodes.  Each round thus splits every large bucket, and only large buckets' rows
are read again.  Rows meet their bucket's state by ``join_hot``, so a common first turn gathers in no task.  Sums over
subtrees come from the tops of finished buckets, added up for each large node above them.

Turns are ordered by turn (null first), role, and hash of the text; each row is a turn, repeated ones too.
A null role or text counts as empty.  Rows with a null conv_id belong to no conversation and are left out.
A conversation is one row of 16 bytes a turn, and is handled by one task, whatever the texts' lengths.  Ids are
integers.  Only the four columns named are read.  An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import join_hot, settle
from aeolith.ship import ship

#: A bucket of so many turns is finished by one task.
TURNS = 1 << 16
#: Ids of conversations that are joined to one text before they are digested.
CHUNK = 256
EMPTY = hashlib.sha256(b"").hexdigest()

_TURN = "array<struct<id:bigint,bytes:bigint>>"
_PATH = "array<struct<depth:int,conv_id:bigint>>"


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id, bytes of the text)."""
    c = conversations.where(F.col("conv_id").isNotNull())
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    c = c.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    hashes = [F.xxhash64(*[F.lit(s) for s in more], F.length("role"), "role", "text").alias(h) for h, more in (("h1", ()), ("h2", ("second",)))]
    turns = settle(c.select("conv_id", "turn", "role", *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")
    known = turns.groupBy("h1", "h2").agg(F.count("*").alias("uses"))
    known = settle(known.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    one = F.struct("turn", "role", "h1", "h2", "id", "bytes")
    whole = join_hot(turns, known, ["h1", "h2"], "uses").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return whole.select("conv_id", F.expr("transform(all, x -> struct(x.id as id, x.bytes as bytes))").cast(_TURN).alias("turns"))


def rebuilt(originals: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """``originals`` with the first turns of each conversation's family (the id without its remainder modulo ``family``)
    for its own; how many is crc32 of the id modulo ``heads``."""
    kept = settle(originals, "originals")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    c = kept.withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    base = kept.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    own = c.where("conv_id = base").select("conv_id", "turns")
    empty = F.array().cast(_TURN)
    other = c.where("conv_id <> base").join(base, "base", "left")
    joined = F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("head")), F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0))))
    return own.unionByName(other.select("conv_id", joined.alias("turns")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence, by chunk, to one row with the digest of all its ids."""
    key, row, n, sha = None, None, 0, None

    def out():
        return pa.RecordBatch.from_arrays([row.column("conv_id"), row.column("turns"), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "turns", "n", "sha"])

    for b in batches:
        done = []
        k1, k2, counts, ids = (b.column(c).to_pylist() for c in ("k1", "k2", "n", "ids"))
        for i, k in enumerate(zip(k1, k2)):
            if k != key:
                if key is not None:
                    done.append(out())
                key, row, n, sha = k, b.slice(i, 1), 0, hashlib.sha256()
            elif n:
                sha.update(b",")
            sha.update(ids[i].encode())
            n += counts[i]
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if key is not None:
        yield out()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id: the smallest, turns, n, sha: digest of the ids): one row for each distinct sequence of turns."""
    ship(conversations.sparkSession)
    c = conversations.select("conv_id", "turns", F.xxhash64("turns").alias("k1"), F.xxhash64(F.lit("second"), "turns").alias("k2"), F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    c = c.groupBy("k1", "k2", "chunk").agg(F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"), F.count("*").alias("n"), ids.alias("ids"))
    # the first row's turns and smallest id stand for all: chunks are in order
    c = c.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return c.mapInArrow(_digest, f"conv_id bigint, turns {_TURN}, n bigint, sha string")


class _Nodes:
    """Nodes of finished buckets, parents before children."""

    def __init__(self):
        self.conv, self.depth, self.up, self.parent, self.n, self.children, self.leaves, self.saved, self.sha, self.top = ([] for _ in range(10))

    def add(self, conv, depth, up, parent, n, saved, sha, top=-1) -> int:
        for x, v in ((self.conv, conv), (self.depth, depth), (self.up, up), (self.parent, parent), (self.n, n), (self.children, 0), (self.leaves, 0), (self.saved, saved), (self.sha, sha), (self.top, top)):
            x.append(v)
        return len(self.conv) - 1

    def add_up(self, since: int) -> None:
        for i in range(len(self.conv) - 1, since - 1, -1):
            if not self.children[i]:
                self.leaves[i] = 1
            if (p := self.up[i]) >= 0:
                self.children[p] += 1
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]


def finish(out: _Nodes, rows: list[int], at: int, above: int | None, conv, n, sha, start, size, ids, bytes_) -> None:
    """Multikey quicksort of a bucket whose rows agree on their first ``at + 1`` turns; ``above``: the conv_id of the node over it."""
    since = len(out.conv)

    def node(rows, depth, up, parent, top=-1):
        """A node of all ``rows``, and those that go deeper."""
        own, ends = sum(n[r] for r in rows), EMPTY
        for r in rows:
            if size[r] == depth:
                ends = sha[r]
        k = out.add(min(conv[r] for r in rows), depth, up, parent, own, (own - 1) * bytes_[start[rows[0]] + depth - 1] if depth else 0, ends, top)
        if len(rows) == 1:
            # no branch below: a chain to the end of the row
            r = rows[0]
            for d in range(depth + 1, size[r] + 1):
                k = out.add(conv[r], d, k, conv[r], own, (own - 1) * bytes_[start[r] + d - 1], sha[r] if d == size[r] else EMPTY)
            return k, []
        return k, [r for r in rows if size[r] > depth]

    k, rest = node(rows, at + 1, -1, above, rows[0])
    stack = [(rest, at + 1, k)] if rest else []
    while stack:
        rows, depth, up = stack.pop()
        turn = [ids[start[r] + depth] for r in rows]
        pivot = turn[len(turn) // 2]
        less, more = [r for r, t in zip(rows, turn) if t < pivot], [r for r, t in zip(rows, turn) if t > pivot]
        stack += [(x, depth, up) for x in (less, more) if x]
        k, rest = node([r for r, t in zip(rows, turn) if t == pivot], depth + 1, up, out.conv[up])
        if rest:
            stack.append((rest, depth + 1, k))
    out.add_up(since)


def _finished(t: pa.Table) -> pa.RecordBatch:
    """Nodes of whole buckets."""
    (b,) = t.combine_chunks().to_batches()
    at, above, digit, conv, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "above", "digit", "conv_id", "n"))
    size = pc.list_value_length(b.column("turns")).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = b.column("turns").flatten()
    lists = [x.tolist() for x in (conv, n, np.cumsum(size) - size, size, flat.field("id").to_numpy(zero_copy_only=False), flat.field("bytes").to_numpy(zero_copy_only=False))]
    sha = b.column("sha").to_pylist()
    edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (above[1:] != above[:-1]) | (digit[1:] != digit[:-1])) + 1).tolist(), len(at)]
    out = _Nodes()
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            d = int(at[lo])
            finish(out, list(range(lo, hi)), d, int(above[lo]) if d >= 0 else None, lists[0], lists[1], sha, *lists[2:])
    long = lambda x: pa.array(x, pa.int64())
    path = b.column("path").take(pa.array([k if k >= 0 else None for k in out.top], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [long(out.conv), long(out.depth), long(out.parent), long(out.n), long(out.children), long(out.leaves), long(out.saved), pa.array(out.sha, pa.string()), path],
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"],
    )


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of buckets to nodes; whole buckets of about ``TURNS`` turns at a time."""
    held, turns = [], 0
    for b in batches:
        held.append(b)
        turns += len(b.column("turns").flatten())
        if turns >= TURNS and sum(x.num_rows for x in held) > 1:
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t.column(c)[-1].as_py() for c in ("at", "above", "digit")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("at", "above", "digit"), last)])
            cut = len(same) - int(same.sum())
            if cut:
                yield _finished(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                turns = sum(len(x.column("turns").flatten()) for x in held)
    if held:
        yield _finished(pa.Table.from_batches(held))


def _in_common(a: str, b: str) -> Column:
    """How many turns two rows share from the first on."""
    differ = F.expr(f"array_position(zip_with({a}, {b}, (x, y) -> x.id <=> y.id), false)")
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def trie(seqs: DataFrame, turns: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node
    of ``sequences``; ``turns``: the size up to which a bucket is finished by one task."""
    turns = TURNS if turns is None else turns
    seqs = settle(seqs, "sequences")
    rows = seqs.withColumn("path", F.array().cast(_PATH)).withColumn("at", F.lit(-1))
    key = ["at", "above", "digit"]
    local, large, ends, children = [], [], [], []
    while True:
        digit = F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.get("turns", F.col("at"))["id"])
        above = F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.element_at(F.col("path"), F.greatest(F.size("path"), F.lit(1)))["conv_id"])
        rows = rows.withColumn("above", above).withColumn("digit", digit)
        by = rows.groupBy(*key).agg(
            F.min("conv_id").alias("node"), F.sum("n").alias("n_convs"), F.count("*").alias("held"), F.sum(F.size("turns") - F.col("at")).alias("left"),
            F.min("turns").alias("least"), F.max("turns").alias("most"), F.first("path").alias("over"),
        )
        big = (F.col("held") > 1) & (F.col("left") > turns)
        common = F.when(big, _in_common("least", "most"))
        # bytes of the turns that the chain of nodes of a large bucket adds; the root adds none
        chain = F.when(F.col("at") < 0, F.concat(F.array(F.lit(0).cast("long")), F.slice("least.bytes", F.lit(1), F.col("to")))).otherwise(F.slice("least.bytes", F.col("at") + 1, F.greatest(F.col("to") - F.col("at"), F.lit(0))))
        by = by.withColumn("to", common).withColumn("chain", F.when(F.col("to").isNotNull(), chain)).drop("least", "most", "left")
        by = settle(by, "buckets")
        children.append(by.where("at >= 0").groupBy(F.col("at").alias("depth"), F.col("above").alias("node")).agg(F.count("*").alias("n_children")))
        dealt = settle(join_hot(rows, by.select(*key, "held", "to", "node"), key, "held"), "dealt")
        local.append(dealt.where("to is null").select(*key, "conv_id", "n", "sha", "turns", "path"))
        found = by.where("to is not null")
        if found.isEmpty():
            break
        large.append(found.select("at", "above", F.col("to").alias("depth"), "node", "n_convs", "chain", "over"))
        more = dealt.where("to is not null")
        ends.append(more.where(F.size("turns") == F.col("to")).select(F.col("to").alias("depth"), "node", "sha"))
        here = F.array(F.struct(F.col("to").alias("depth"), F.col("node").alias("conv_id"))).cast(_PATH)
        rows = more.where(F.size("turns") > F.col("to")).select("conv_id", "turns", "n", "sha", F.concat("path", here).alias("path"), F.col("to").alias("at"))

    union = lambda parts: parts[0] if len(parts) == 1 else union([union(parts[: len(parts) // 2]), union(parts[len(parts) // 2 :])]) if len(parts) > 2 else parts[0].unionByName(parts[1])
    kind = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    nodes = union(local).repartition(*key).sortWithinPartitions(*key).mapInArrow(_local, f"{kind}, path {_PATH}")
    names = [c.split()[0] for c in kind.split(", ")]
    if not large:
        return nodes.select(*names)
    nodes, top = settle(nodes, "nodes"), union(large)
    own = (F.col("n_convs") - 1) * F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x)
    below = nodes.where("path is not null").select(F.explode("path").alias("p"), "n_leaves", "saved_tokens")
    below = below.unionByName(top.select(F.explode("over").alias("p"), F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens")))
    below = below.groupBy(F.col("p.depth").alias("depth"), F.col("p.conv_id").alias("node")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    t = top.join(below, ["depth", "node"]).join(union(ends), ["depth", "node"], "left").join(union(children), ["depth", "node"], "left")
    t = t.select("*", F.posexplode(F.col("chain")).alias("pos", "bytes"))
    last = F.col("pos") == F.size("chain") - 1
    added = F.aggregate(F.slice("chain", F.col("pos") + 1, F.size("chain")), F.lit(0).cast("long"), lambda a, x: a + x)
    t = t.select(
        F.col("node").alias("conv_id"), (F.col("at") + 1 + F.col("pos")).cast("long").alias("depth"),
        F.when(F.col("pos") > 0, F.col("node")).when(F.col("at") >= 0, F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("n_children", F.lit(0).cast("long"))).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * added).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return nodes.select(*names).unionByName(t)
