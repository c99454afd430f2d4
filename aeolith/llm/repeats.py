"""Substring dedup: content-defined chunks by a gear rolling hash, then exact stretches.

What is reported is each stretch of ``SPAN_WORDS`` (51) words or more that occurs before, in
a document with a smaller id or (``within``) earlier in the same one.  A word is in a
reported span if and only if it is in a window of 51 whole words (the text's bytes from the
first to the last) that occurs before.  No window is left out, and edges are exact to the word:

1. A gear hash rolls over the words (``h = (h << 16) + GEAR(word)``, so it knows the last 4).  A
   text is cut where the hash is the least of ``REACH`` places in a row: cuts depend on the words
   around them alone, so insertions shift no others, and of any 51 words the first 27
   hold a cut, and the next cut lies within the 51 as well.
2. So each window has a first whole chunk, and equal windows have equal first chunks wherever
   they stand.  The windows of one chunk are neighbours: one row holds them all, under the
   digest of the chunk (with the 4 words that made its cut), with a digest of the stretch
   that they cover.
3. Chunks are counted by digest (partial aggregation first).  If all rows of a digest have one
   stretch, all their windows occur in each, and the least (id, place) is the first copy.
4. Where a digest has several stretches (at the edges of passages), one row of each stretch
   is looked up in its text, and its windows are compared one by one, by 128-bit digests.

Windows that follow one another without a gap form a span; spans of one text can overlap, if
the passages do.  A span's windows may have their first copies in several documents.  Rows of
one digest, however many, don't gather in a task: the commonest digests are broadcast (a
bounded number), and what is known of a digest is one row.

Offsets are bytes of the UTF-8 text, end exclusive.  Null texts and texts of fewer words have
no spans; long texts are read whole.  Rows with a null id count as one document, and never as
the first copy unless all ids of a window are null.  Repeated rows share their spans; texts
under one id that differ are cut by the spans of all of them, so ids should be unique.  An empty
table gives no rows.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolith.llm.common import join_hot, settle, slices, word_hashes, words_in
from aeolith.ship import ship

#: A repeat has over 50 words.
SPAN_WORDS = 51
#: Words that the gear hash knows: 64 bits in steps of 16.
GEAR_WORDS, GEAR_BITS = 4, 16
#: Windows whose chunks are sought at once.
BLOCK = 50_000
_DIGEST_SEED = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_FACTOR = 0x9E3779B97F4A7C15


def gear(words: np.ndarray) -> np.ndarray:
    """h[i] = sum of words[i - j] << 16 j, modulo 2 ** 64, by doubling, then mixed."""
    h, size = words.copy(), 1
    while size < GEAR_WORDS:
        h[size:] += h[:-size] << np.uint64(GEAR_BITS * size)
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def reach(span: int) -> int:
    """Places of which the least is a cut: two such rows and what the hash knows fit in a span."""
    return max(1, (span - GEAR_WORDS + 1) // 2)


def cut_after(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Where the least hash is of the ``width`` places from each of ``at`` on (the leftmost)."""
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    return at + np.concatenate([views[at[k : k + BLOCK]].argmin(1) for k in range(0, len(at), BLOCK)])


def stretches(texts: list[str], span: int = SPAN_WORDS) -> tuple[np.ndarray, ...]:
    """(text, pos, n, start, stop, h, d): for each chunk the first of its windows (by word), how
    many there are, the bytes that they cover, and digests of the chunk and of those bytes."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    flat = b" ".join([b"", *raws, b""])
    buffer = np.frombuffer(flat, np.uint8)
    begin, end = words_in(_BLANK[buffer])
    origin = 1 + np.cumsum([0, *[len(r) + 1 for r in raws]])[:-1]
    owner = np.searchsorted(origin, begin, side="right") - 1
    n = len(begin) - span + 1
    window = np.flatnonzero(owner[:n] == owner[span - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    words, width = word_hashes(buffer, begin, end), reach(span)
    h = gear(words)
    cut = cut_after(h, window + GEAR_WORDS - 1, width)
    # a chunk's windows follow one another
    at = np.flatnonzero(np.diff(cut, prepend=-1))
    count = np.diff(np.append(at, len(window)))
    a, cut = window[at], cut[at]
    stop_word = cut_after(h, cut + 1, width)
    # the chunk's digest, from a rolling sum over words
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), _FACTOR, np.uint64))), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
    first = cut - GEAR_WORDS + 1
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), pow(_FACTOR, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    key = (sums[stop_word + 1] - sums[first]) * down[first]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    start, stop = begin[a], end[a + count + span - 2]
    d = np.frombuffer(b"".join([xxhash.xxh3_64_digest(flat[x:y], _DIGEST_SEED) for x, y in zip(start.tolist(), stop.tolist())]), np.int64)
    text = owner[a]
    words_before = np.searchsorted(owner, np.arange(len(texts)))
    return text, a - words_before[text], count, start - origin[text], stop - origin[text], key.view(np.int64), d


def chunks(docs: DataFrame, span: int = SPAN_WORDS) -> DataFrame:
    """(id, pos, n, start, stop, h, d) of ``docs`` (id, text): one row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                text, pos, n, start, stop, h, d = stretches(texts, span)
                if len(text):
                    ints = [pa.array(x.astype(np.int32)) for x in (pos, n, start, stop)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), *ints, pa.array(h), pa.array(d)], ["id", "pos", "n", "start", "stop", "h", "d"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, pos int, n int, start int, stop int, h bigint, d bigint")


def windows(asked: DataFrame, span: int = SPAN_WORDS) -> DataFrame:
    """(id, h, d, k, start, stop, w1, w2): the windows of the stretches ``asked`` for (id, text, and
    an array of pos, n, h, d), one by one, with bytes from the stretch's start and a digest."""
    kind = asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1), batch.column(2)
            rows, of, digests = [], [], []

            def flush(ids=batch.column(0), rows=rows, of=of, digests=digests):
                w = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                cols = list(zip(*rows))
                out = [ids.take(pa.array(of)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]], pa.array(w[:, 0]), pa.array(w[:, 1])]
                for x in (rows, of, digests):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, ["id", "h", "d", "k", "start", "stop", "w1", "w2"])

            for i in range(batch.num_rows):
                raw = b" " + (texts[i].as_py() or "").encode("utf-8", "replace") + b" "
                begin, end = (x.tolist() for x in words_in(_BLANK[np.frombuffer(raw, np.uint8)]))
                for s in wanted[i].as_py():
                    a, last = s["pos"], s["pos"] + s["n"] + span - 2
                    # another text under this id isn't meant
                    if last >= len(end) or int.from_bytes(xxhash.xxh3_64_digest(raw[begin[a] : end[last]], _DIGEST_SEED), "little", signed=True) != s["d"]:
                        continue
                    for k in range(s["n"]):
                        x, y = begin[a + k], end[a + k + span - 1]
                        rows.append((s["h"], s["d"], k, x - begin[a], y - begin[a]))
                        of.append(i)
                        digests.append(xxhash.xxh3_128_digest(raw[x:y], _DIGEST_SEED))
                if len(rows) > 100_000:
                    yield flush()
            if rows:
                yield flush()

    return asked.mapInArrow(run, f"id {kind}, h bigint, d bigint, k int, start int, stop int, w1 bigint, w2 bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS, within: bool = True) -> DataFrame:
    """(id, start, stop, words, first_ids): the spans of each document that occur before, with the
    ids of the first copies.  ``within``: also earlier in the same document (which is then its own
    first copy); else only in documents with smaller ids."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    every = settle(chunks(src, span_words), "chunks")
    place = lambda pos: F.struct(F.col("id").isNull().alias("none"), "id", pos.alias("pos"))
    later = lambda pos: ~F.col("id").eqNullSafe(F.col("first.id")) | (F.lit(within) & (pos != F.col("first.pos")))
    seen = every.groupBy("h").agg(F.min(place(F.col("pos"))).alias("first"), F.count("*").alias("times"), (F.min("d") != F.max("d")).alias("mixed")).where("times > 1")
    shared = settle(join_hot(every, settle(seen, "seen"), "h", "times"), "shared")
    whole = shared.where(~F.col("mixed")).where(later(F.col("pos"))).select("id", "pos", "n", "start", "stop", F.col("first.id").alias("first"))
    # one row of each stretch, the one with the smallest id, stands for all
    mixed = shared.where("mixed").drop("mixed", "first")
    one = mixed.groupBy("h", "d").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "pos", "n")).alias("o"), F.count("*").alias("times"))
    one = settle(one, "stretches")
    places = one.groupBy("o.id").agg(F.collect_list(F.struct("o.pos", "o.n", "h", "d")).alias("places")).withColumnRenamed("id", "__id")
    asked = src.join(places, F.col("id").eqNullSafe(F.col("__id"))).select("id", "text", "places")
    # a stretch can have windows of its own again
    each = windows(asked, span_words).withColumnRenamed("id", "own").join(one.select("h", "d", F.col("o.pos").alias("pos0")), ["h", "d"]).withColumnRenamed("own", "id")
    each = settle(each, "windows")
    first = each.groupBy("w1", "w2").agg(F.min(place(F.col("pos0") + F.col("k"))).alias("first"))
    parts = each.join(first, ["w1", "w2"]).select("h", "d", F.struct("k", F.col("start").alias("x"), F.col("stop").alias("y"), "first").alias("w"))
    parts = parts.groupBy("h", "d").agg(F.collect_set("w").alias("w")).join(one.select("h", "d", "times"), ["h", "d"])
    single = join_hot(mixed, settle(parts, "parts"), ["h", "d"], "times").select("id", "pos", "start", F.explode("w").alias("w"))
    single = single.select("id", (F.col("pos") + F.col("w.k")).alias("pos"), (F.col("start") + F.col("w.x")).alias("start"), (F.col("start") + F.col("w.y")).alias("stop"), F.col("w.first").alias("first"))
    single = single.where(later(F.col("pos"))).select("id", "pos", F.lit(1).alias("n"), "start", "stop", F.col("first.id").alias("first"))
    again = whole.unionByName(single).distinct()
    order = Window.partitionBy("id").orderBy("pos", "start")
    before = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = again.withColumn("new", F.when(F.col("pos") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = run.groupBy("id", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + (span_words - 1)).cast("long").alias("words"), F.array_sort(F.collect_set("first")).alias("first_ids")
    )
    return spans.select("id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "words", "first_ids")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            if t and s:
                raw, at, parts = t.encode("utf-8", "replace"), 0, []
                for x in s:
                    parts.append(raw[at : max(at, x["start"])])
                    at = max(at, x["stop"])
                t = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pa.array(out, pa.string())

    found = repeats(docs, id_col, text_col, **how)
    found = found.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    joined = docs.join(found, docs[id_col].eqNullSafe(F.col("__id")), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*docs.columns)
