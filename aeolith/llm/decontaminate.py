"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Both sides are lower-cased (A-Z) and cut into words.  Every run of ``window`` benchmark words
becomes a rolling hash and a 128-bit digest of its text, in a table made by executors.  The
hash set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, whatever the benchmark's
size or that of one item (blocks are dealt by a hash of window and item): some 30 bytes for a
window, 60 MB for a block.  One block is scanned in one pass over the documents.  More blocks
are scanned one after another; only one is on the driver and in a worker at a time, and
each block's findings are written to the shared folder, then merged.

The scan makes the hashes of all word windows of a slice of texts at once (doubling: a
window's hash is made from those of its halves) from the texts' bytes, looks them up in a
bitmap, then in the set, and verifies each hit by the digest of its words.

Null and empty texts have no words; texts are scanned whole, however long.  Benchmark items
without words have no windows; repeated items and repeated item ids count once; a null item
id is reported as "null", and isn't the same as an item of that name.  Repeated rows
get the same findings each.  Empty tables give no rows, or no findings.  Other columns stay,
but for one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import settle, slices, text_udf, word_hashes, words_in
from aeolith.ship import ship

WINDOW = 13
BLOCK_WINDOWS = 2_000_000
#: Share of hit words, as 1 / CONTAMINATED_PART, from which a document counts as contaminated.
CONTAMINATED_PART = 20

#: A-Z to a-z, other ASCII than 0-9 and a-z to a space, the rest as it is.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text that isn't lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap for each window, at least.
_SPARSE = 16


class Cut:
    """The normalised words of some texts: where they are in one row of bytes, and their hashes."""

    def __init__(self, texts: list[str]):
        raws = [t.encode("utf-8", "replace").translate(_TABLE) for t in texts]
        self.flat = b" ".join([b"", *raws, b""])
        buffer = np.frombuffer(self.flat, np.uint8)
        self.begin, self.end = words_in(buffer == 32)
        self.hashes = word_hashes(buffer, self.begin, self.end)
        stops = np.cumsum([len(r) + 1 for r in raws])
        #: how many words there are up to the end of each text
        self.ends = np.searchsorted(self.begin, stops, side="right") if texts else np.zeros(0, np.int64)

    def digest(self, i: int, n: int) -> bytes:
        """Of the ``n`` words from word ``i`` on, with one space between them."""
        return xxhash.xxh3_128_digest(b" ".join(self.flat[self.begin[i] : self.end[i + n - 1]].split()))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _window_hashes(h: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the rolling hashes of all its windows, built from power-of-two windows."""
    steps, size = {1: h}, 1
    while size * 2 <= max(lengths):
        a = steps[size]
        if len(a) <= size:
            break
        steps[size * 2] = a[:-size] * _power(size) + a[size:]
        size *= 2
    out = {}
    for n in lengths:
        if len(h) < n:
            out[n] = h[:0]
            continue
        have, acc = 0, None
        for s in sorted(steps, reverse=True):
            if n & s:
                part = steps[s][have : have + len(h) - n + 1]
                acc = part if acc is None else acc * _power(s) + part
                have += s
        out[n] = acc
    return out


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(n, h, d1, d2, item) of the benchmark's windows, each once for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                cut = Cut(texts)
                rows: list[tuple[int, int, int]] = []
                for k, (x, y) in enumerate(zip([0, *cut.ends.tolist()], cut.ends.tolist())):
                    n = min(window, y - x)
                    rows += [(k, i, n) for i in range(x, y - n + 1)] if n else []
                if not rows:
                    continue
                of, place, n = (np.array(c) for c in zip(*rows))
                h = np.zeros(len(n), np.int64)
                for size, rolled in _window_hashes(cut.hashes, sorted(set(n.tolist()))).items():
                    own = n == size
                    h[own] = rolled[place[own]].view(np.int64)
                d = np.frombuffer(b"".join([cut.digest(i, k) for _, i, k in rows]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(h), pa.array(d[:, 0]), pa.array(d[:, 1]), ids.take(pa.array(of))], ["n", "h", "d1", "d2", "item"])

    ship(benchmark.sparkSession)
    b = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("t")).where("t is not null")
    return b.mapInArrow(run, "n int, h bigint, d1 bigint, d2 bigint, item string").distinct()


class NgramSet:
    """A block of windows, by length: sorted hashes, digests, items, and a bitmap."""

    def __init__(self, block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str | None]):
        self.block, self.names = block, names
        self.lengths = sorted(block)
        self.bits: dict[int, tuple[np.ndarray, np.uint64]] = {}
        for n, (h, _, _) in block.items():
            size = 1 << max(16, (_SPARSE * len(h)).bit_length())
            bits, slot = np.zeros(size // 8, np.uint8), self._slot(h, np.uint64(size - 1))
            np.bitwise_or.at(bits, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
            self.bits[n] = (bits, np.uint64(size - 1))

    @staticmethod
    def pack(t: pa.Table) -> tuple[dict, list]:
        """What is broadcast, from the rows of a block."""
        items = t["item"].combine_chunks().dictionary_encode()
        names = items.dictionary.to_pylist()
        code = items.indices.fill_null(len(names)).to_numpy()
        names.append(None)
        n, h = t["n"].to_numpy(), t["h"].to_numpy().view(np.uint64)
        d = np.stack([t["d1"].to_numpy(), t["d2"].to_numpy()], axis=1)
        out = {}
        for size in np.unique(n).tolist():
            own = np.flatnonzero(n == size)
            own = own[np.argsort(h[own], kind="stable")]
            out[size] = (h[own], d[own], code[own].astype(np.int32))
        return out, names

    @staticmethod
    def _slot(h: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (h >> np.uint64(20)) & mask

    def scan(self, texts: list[str]) -> dict[str, list]:
        cut = Cut(texts)
        ends, total = cut.ends, len(cut.begin)
        items: list[set[int]] = [set() for _ in texts]
        cover = np.zeros(total + 1, np.int32)
        if total and self.lengths:
            for n, rolled in _window_hashes(cut.hashes, self.lengths).items():
                (bits, mask), (known, digests, codes) = self.bits[n], self.block[n]
                slot = self._slot(rolled, mask)
                at = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[doc]
                at, doc = at[inside], doc[inside]
                lo, hi = np.searchsorted(known, rolled[at]), np.searchsorted(known, rolled[at], side="right")
                for k in np.flatnonzero(hi > lo).tolist():
                    i, d = int(at[k]), int(doc[k])
                    own = np.frombuffer(cut.digest(i, n), np.int64)
                    same = np.flatnonzero((digests[lo[k] : hi[k]] == own).all(1))
                    if len(same):
                        items[d].update(codes[lo[k] + same].tolist())
                        cover[i] += 1
                        cover[i + n] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        out: dict[str, list] = {"n_words": (ends - begin).tolist(), "items": [], "hits": []}
        for found, a, b in zip(items, begin.tolist(), ends.tolist()):
            out["items"].append([{"none": x is None, "id": "null" if x is None else x} for x in sorted((self.names[c] for c in found), key=lambda x: (x or "null", x is None))])
            own = hit[a:b]
            if found:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                out["hits"].append([{"from_word": x, "to_word": y} for x, y in edge.reshape(-1, 2).tolist()])
            else:
                out["hits"].append([])
        return out


#: The set that this worker has built last.
_SETS: list[tuple[tuple, NgramSet]] = []

_SCAN_TYPE = {"n_words": pa.int64(), "items": pa.list_(pa.struct([("none", pa.bool_()), ("id", pa.string())])), "hits": pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))}
_SCAN_DDL = "struct<n_words:bigint,items:array<struct<none:boolean,id:string>>,hits:array<struct<from_word:bigint,to_word:bigint>>>"


def _scan(docs: DataFrame, sent):
    """A UDF from texts to n_words, items and hits (merged spans of words, end exclusive)."""

    def kernel():
        packed = sent.value
        if not _SETS or _SETS[0][0] is not packed:
            _SETS[:] = [(packed, NgramSet(*packed))]
        return _SETS[0][1].scan

    return text_udf(kernel, _SCAN_TYPE, _SCAN_DDL)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a column ``__scan``: n_words, items and hits."""
    sc = docs.sparkSession.sparkContext
    grams = settle(windows_of(benchmark, item_col, item_text_col, window), "grams")
    n = max(1, -(-grams.count() // block_windows))
    if n == 1:
        return docs.withColumn("__scan", _scan(docs, sc.broadcast(NgramSet.pack(grams.toArrow())))(docs[text_col]))
    dealt = settle(grams.withColumn("block", F.pmod(F.xxhash64("n", "h", "d1", "d2", "item"), F.lit(n))), "blocks")
    # findings are of a text, whichever rows have it
    key = F.struct(F.xxhash64(docs[text_col]), F.xxhash64(F.lit("second"), docs[text_col]))
    found = None
    for i in range(n):
        sent = sc.broadcast(NgramSet.pack(dealt.where(F.col("block") == i).drop("block").toArrow()))
        part = docs.select(key.alias("key"), _scan(docs, sent)(docs[text_col]).alias("s")).where(F.size("s.items") > 0)
        part = settle(part.groupBy("key").agg(F.first("s.items").alias("items"), F.first("s.hits").alias("hits")), "found")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(F.col("key").alias("__key")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), _merged(F.flatten(F.collect_list("hits"))).alias("hits"))
    merged = merged.select("__key", F.array_sort("items", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(a["none"].cast("int") - b["none"].cast("int"))).alias("__items"), F.col("hits").alias("__hits"))
    count = text_udf(lambda: lambda texts: {"n": np.diff(Cut(texts).ends, prepend=0)}, {"n": pa.int64()}, "struct<n:bigint>")
    rows = docs.withColumn("__key", key).join(merged, "__key", "left")
    kinds = _SCAN_DDL.removeprefix("struct<n_words:bigint,items:").removesuffix(">").split(",hits:")
    held = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})"))
    scan = F.struct(count(F.col(text_col))["n"].alias("n_words"), held("__items", kinds[0]).alias("items"), held("__hits", kinds[1]).alias("hits"))
    return rows.withColumn("__scan", scan).select(*docs.columns, "__scan")


def _merged(spans):
    """Sorted overlapping or touching spans, merged."""
    zero = F.expr("cast(array() as array<struct<from_word:bigint,to_word:bigint>>)")

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["from_word"].alias("from_word"), F.greatest(last["to_word"], x["to_word"]).alias("to_word"))
        return F.when((F.size(acc) > 0) & (x["from_word"] <= last["to_word"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), zero, step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", to: str = "contamination", **how) -> DataFrame:
    """``docs`` with one more column ``to`` (replaced if there is one already)."""
    out = contamination(docs, benchmark, text_col, **how)
    s = F.col("__scan")
    n_hit = F.aggregate(s["hits"], F.lit(0).cast("long"), lambda a, x: a + x["to_word"] - x["from_word"])
    out = out.withColumn("__n_hit", n_hit)
    contaminated = (F.col("__n_hit") > 0) & (CONTAMINATED_PART * F.col("__n_hit") >= s["n_words"])
    items = F.transform(s["items"], lambda x: x["id"])
    fields = {"n_words": s["n_words"], "n_hit": F.col("__n_hit"), "items": items, "hits": s["hits"], "items_sha256": F.sha2(F.concat_ws(",", items), 256), "contaminated": contaminated}
    return out.withColumn(to, F.struct(*[v.alias(k) for k, v in fields.items()])).drop("__scan", "__n_hit")


def drop_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without those that are contaminated."""
    return decontaminate(docs, benchmark, to="__found", **how).where(~F.col("__found")["contaminated"]).drop("__found")


def _cut(text: str | None, hits: list) -> str | None:
    if not text or not hits:
        return text
    spans, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for h in hits:
        out.append(text[at : spans[h["from_word"]][0]])
        at = spans[h["to_word"] - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; other documents stay as they are."""


    @F.arrow_udf("string")
    def cut_spans(text: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([_cut(t, h) for t, h in zip(text.to_pylist(), hits.to_pylist())], pa.string())

    c = decontaminate(docs, benchmark, text_col, to="__found", **how)
    return c.withColumn(text_col, cut_spans(F.col(text_col), F.col("__found")["hits"])).drop("__found")
