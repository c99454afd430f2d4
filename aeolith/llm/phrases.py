"""Phrase collocation mining: pivot partitioning, as in MG-FSM.

Words of a language are ordered by how often they occur.  The pivot of an n-gram is its rarest word.  Around each
occurrence of a word ``w`` the text is rewritten to a fragment: the words next to it, three on either side at most, as
far as none is rarer than ``w`` (to the left: and none is ``w`` itself).  An n-gram occurrence then lies in exactly
one fragment of its pivot, that of the pivot's first occurrence in it.  Fragments go to buckets of pivots; a
bucket is mined by itself and emits n-grams that hold the pivot, those of other pivots are counted elsewhere.

* One pass counts words by (language, word), with a 63-bit hash that stands for both from then on.
* The commonest ``TABLE`` frequent words are broadcast with their ranks.  Frequent words beyond are told by a
  bitmap of ``BITS`` bits and stand behind all others, in the order of their hashes; where the bitmap is so full that it lets
  infrequent words through, these cost fragments but are in no phrase that is frequent.  So what is broadcast is bounded
  (some 30 MB) for any vocabulary.
* Fragments travel as rows of bytes, one for each slice of text, language and bucket.  There are as many buckets as make
  about ``FRAGMENTS`` in each.  A pivot that occurs more than ``SALT`` times is dealt over several buckets, whose counts of an
  n-gram are added up; others are counted whole in one bucket, which emits frequent n-grams only.
* Parts of phrases are looked up by ``join_hot``, as one word can begin a third of all phrases.

Counts are exact up to collisions of 63-bit hashes of words (and the last division is of decimals).  A null text is
empty, a null language ``und``.  Long texts are cut between pieces only.  Equal texts count each.  Phrases of equal score and
count are ordered by their bytes.  An empty table gives no rows.  Only the two columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.llm.common import commonest, join_hot, settle, word_hashes
from aeolith.ship import ship

LONGEST, LEAST, TOP = 4, 30, 2000
#: Words that are broadcast with their ranks (ranks take three bytes); bits of the map of other frequent words.
TABLE, BITS = 1 << 20, 1 << 27
#: Fragments in a bucket on average; occurrences of a pivot from which on it is dealt over buckets, as its fragments alone
#: would be more than a task is to hold.
FRAGMENTS, SALT = 1 << 19, 1 << 20
#: Bytes of text in a slice, and distinct words that are held before they are passed on.
SLICE, HELD = 2_000_000, 400_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(10, 14)]] = True
_BLANK = _END.copy()
_BLANK[[9, 32]] = True
_HALF = np.uint64((1 << 63) - 1)
_REST = np.uint64(1 << 63)
_NONE = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of a batch (lang, text): lower-case bytes that begin and end with an end of a piece, where the texts
    after the first begin, and each text's language as a number in a list.  Cut at ends of pieces, also inside long texts."""
    large = pa.large_string()
    texts = pc.binary_join_element_wise(pa.scalar("\n", large), batch.column("text").cast(large), pa.scalar("", large))
    names = batch.column("lang").dictionary_encode()
    langs, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = min(at + SLICE, stop)
        while to < stop:
            ends = np.flatnonzero(_END[raw[to : to + SLICE]])
            if len(ends):
                to += int(ends[0])
                break
            to = min(to + SLICE, stop)
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, to, side="left"))
        piece = np.empty(to - at + 2, np.uint8)
        piece[0] = piece[-1] = 10
        piece[1:-1] = _LOWER[raw[at:to]]
        yield piece, offsets[first + 1 : last] - at + 1, langs[first:last], names
        at = to


def _words(piece: np.ndarray, starts: np.ndarray, langs: np.ndarray, names: list[str]):
    """Words of a slice: begin, end, hash with the language, number of the language, number of the piece that a word is in."""
    blank = _BLANK[piece]
    begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    own = langs[np.searchsorted(starts, begin, side="right")]
    salt = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in names), np.uint64)
    h = _mix(word_hashes(piece, begin, end) ^ salt[own]) & _HALF
    return begin, end, h, own, np.cumsum(_END[piece], dtype=np.int64)[begin]


def _binary(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches as a binary array."""
    size = end - begin
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    take = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[take])])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out():
        h, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        lang, word = (pa.concat_arrays([x[i] for x in held]) for i in (2, 3))
        one, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=c, minlength=len(one)).astype(np.int64)
        take = pa.array(first)
        held.clear()
        return pa.RecordBatch.from_arrays([lang.take(take), word.take(take).cast(pa.binary()).cast(pa.string()), pa.array(one.astype(np.int64)), pa.array(total)], ["lang", "word", "h", "f"])

    for b in batches:
        for piece, starts, langs, names in _slices(b):
            begin, end, h, own, _ = _words(piece, starts, langs, names)
            one, first, count = np.unique(h, return_index=True, return_counts=True)
            held.append((one, count, pa.array(names, pa.string()).take(pa.array(own[first])), _binary(piece, begin[first], end[first])))
            if sum(len(x[0]) for x in held) > HELD:
                yield out()
    if held:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, h, f) of (lang, text): how often each word of a language occurs."""
    part = texts.mapInArrow(_count_words, "lang string, word string, h bigint, f bigint")
    return part.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


class Table:
    """What is broadcast: hashes of the commonest words in order with their ranks (0: most common) and numbers of
    salts, the hash of each rank, and the bitmap of other frequent words (None if there are none)."""

    def __init__(self, h: np.ndarray, f: np.ndarray, rest: np.ndarray | None, n_buckets: int):
        by_count = np.lexsort((h, -f))
        self.by_rank, self.salts = h[by_count], np.maximum(1, -(-f[by_count] // SALT)).astype(np.int64)
        order = np.argsort(self.by_rank)
        self.h, self.rank = self.by_rank[order], order.astype(np.uint64)
        self.rest, self.n_buckets = rest, n_buckets

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the order, by its hash; ``_NONE``: infrequent."""
        out = np.full(len(h), _NONE)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = self.h[at] == h
            out[known] = self.rank[at[known]]
        if self.rest is not None:
            bit = h >> np.uint64(63 - (64 * len(self.rest) - 1).bit_length())
            held = (out == _NONE) & ((self.rest[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            out[held] = h[held] | _REST
        return out

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        out = codes & _HALF
        known = codes < _REST
        out[known] = self.by_rank[codes[known].astype(np.int64)]
        return out

    def salts_of(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), np.int64)
        known = codes < _REST
        out[known] = self.salts[codes[known].astype(np.int64)]
        return out


def table_of(counts: DataFrame, least: int) -> Table:
    frequent = counts.where(F.col("f") >= least)
    n, tokens = frequent.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    top = commonest(frequent, "f", TABLE) if n > TABLE else frequent
    got = top.select("h", "f").toArrow()
    h, f = got.column("h").to_numpy().astype(np.uint64), got.column("f").to_numpy().astype(np.int64)
    rest = None
    if n > len(h):
        limit = int(f.min()) if len(f) else None
        others = frequent.where(F.col("f") < limit) if limit is not None else frequent
        shift = (BITS // 64 - 1).bit_length()
        bit = F.expr(f"shiftleft(1L, cast(shiftright(h, {57 - shift}) & 63 as int))")
        words = others.groupBy(F.shiftright("h", 63 - shift).alias("slot")).agg(F.bit_or(bit).alias("mask")).toArrow()
        rest = np.zeros(BITS // 64, np.uint64)
        rest[words.column("slot").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Table(h, f, rest, max(1, -(-int(tokens) // FRAGMENTS)))


def _pack(codes: np.ndarray, wide: bool) -> np.ndarray:
    return codes.view(np.uint8) if wide else np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).reshape(-1)


def _unpack(raw: np.ndarray, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(raw.tobytes(), np.uint64)
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = raw.reshape(-1, 3)
    return out.reshape(-1).view("<u4").astype(np.uint64)


def fragments(code: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pivots with neighbours stand, and how many words of their fragments stand left and right of them."""
    n = len(code)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    go_left = go_right = code != _NONE
    for k in range(1, LONGEST):
        if k >= n:
            break
        same = piece[k:] == piece[:-k]
        ok = np.zeros(n, bool)
        ok[k:] = same & (code[:-k] < code[k:])
        go_left = go_left & ok
        ok = np.zeros(n, bool)
        ok[:-k] = same & (code[k:] <= code[:-k])
        go_right = go_right & ok
        left += go_left
        right += go_right
    at = np.flatnonzero(left + right)
    return at, left[at], right[at]


def _route(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
    wide = table.rest is not None
    for b in batches:
        for text, starts, langs, names in _slices(b):
            _, _, h, own, piece = _words(text, starts, langs, names)
            code = table.codes(h)
            at, left, right = fragments(code, piece)
            if not len(at):
                continue
            pivot = code[at]
            salt = (at % table.salts_of(pivot)).astype(np.uint64)
            bucket = (_mix(_mix(pivot + np.uint64(1)) + salt) % np.uint64(table.n_buckets)).astype(np.int64)
            key = own[at].astype(np.int64) * table.n_buckets + bucket
            order = np.argsort(key, kind="stable")
            at, left, right, key = at[order], left[order], right[order], key[order]
            size = left + 1 + right
            ends = np.cumsum(size)
            take = np.arange(ends[-1]) + np.repeat(at - left - (ends - size), size)
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            data = _pack(code[take], wide)
            unit = 8 if wide else 3
            binary = lambda o, raw: pa.Array.from_buffers(pa.large_binary(), len(o) - 1, [None, pa.py_buffer(o.astype(np.int64)), pa.py_buffer(raw)])
            first = key[edges[:-1]]
            shapes = binary(edges, (left * LONGEST + right).astype(np.uint8))
            words = binary(np.concatenate(([0], ends))[edges] * unit, data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(first // table.n_buckets)), pa.array(first % table.n_buckets), shapes.cast(pa.binary()), words.cast(pa.binary())], ["lang", "bucket", "shapes", "words"]
            )


def mine(shapes: np.ndarray, codes: np.ndarray, table: Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, one row for each n-gram; counts) for each n, of the fragments of a bucket."""
    left, right = (shapes // LONGEST).astype(np.int64), (shapes % LONGEST).astype(np.int64)
    size = left + 1 + right
    at = np.cumsum(size) - size + left
    some, local = np.unique(codes, return_inverse=True)
    local = local.astype(np.uint64)
    for n in range(2, LONGEST + 1):
        start = np.concatenate([at[(left >= s) & (right >= n - 1 - s)] - s for s in range(n)])
        if not len(start):
            continue
        bits = np.uint64(max(1, int(len(some) - 1).bit_length()))
        key = local[start]
        for j in range(1, n):
            if int(bits) * (j + 1) > 64:
                # too wide to be one number: number what there is so far
                key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            key = (key << bits) | local[start + j]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        grams = codes[start[first][:, None] + np.arange(n)]
        whole = table.salts_of(grams.max(axis=1)) == 1
        keep = ~whole | (count >= least)
        yield grams[keep], count[keep]


def _mine(batches: Iterator[pa.RecordBatch], table: Table, least: int) -> Iterator[pa.RecordBatch]:
    wide = table.rest is not None
    held: list[tuple] = []
    key = None

    def out():
        shapes = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        codes = _unpack(np.frombuffer(b"".join(x[1] for x in held), np.uint8), wide)
        held.clear()
        for grams, count in mine(shapes, codes, table, least):
            m, n = grams.shape
            flat = pa.array(table.hashes(grams.reshape(-1)).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), flat)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m, pa.string()), lists, pa.array(count.astype(np.int64))], ["lang", "gram", "a"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("lang", "bucket", "shapes", "words"))):
            if row[:2] != key:
                if held:
                    yield from out()
                key = row[:2]
            held.append(row[2:])
    if held:
        yield from out()


def grams(texts: DataFrame, table: Table, least: int) -> DataFrame:
    """(lang, gram: hashes of its words, a): n-grams of 2 to ``LONGEST`` words that occur ``least`` times or more."""
    sent = texts.sparkSession.sparkContext.broadcast(table)
    routed = texts.mapInArrow(lambda batches: _route(batches, sent.value), "lang string, bucket bigint, shapes binary, words binary")
    dealt = routed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    mined = dealt.mapInArrow(lambda batches: _mine(batches, sent.value, least), "lang string, gram array<bigint>, a bigint")
    return mined.groupBy("lang", "gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(counts: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, gram, a, l, r, score) of the candidates ``found``, by the cut that scores least."""
    part = lambda side: F.struct(F.lit(side).alias("side"), F.col("k"), (F.slice("gram", F.lit(1), F.col("k")) if side == "l" else F.slice("gram", F.col("k") + 1, F.size("gram"))).alias("part"))
    cuts = found.select("lang", "gram", "a", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    parts = settle(cuts.select("lang", "gram", "a", F.explode(F.array(part("l"), part("r"))).alias("x")).select("lang", "gram", "a", "x.*"), "parts")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    known = counts.select("lang", F.array("h").alias("part"), "f").unionByName(found.select("lang", F.col("gram").alias("part"), F.col("a").alias("f")))
    both = join_hot(parts, settle(uses.join(known, ["lang", "part"]), "uses"), ["lang", "part"], "uses")
    side = lambda s, k: F.max(F.when((F.col("side") == s) & (F.col("k") == k), F.col("f"))).alias(f"{s}{k}")
    places = range(1, LONGEST)
    both = both.groupBy("lang", "gram", "a").agg(*[side(s, k) for s in "lr" for k in places])
    one = lambda k: f"case when l{k} is not null then struct(cast(a as decimal(20,0)) * 2000000 div (l{k} + r{k}) as score, {k} as k, l{k} as l, r{k} as r) end"
    best = F.expr(f"array_min(array({', '.join(one(k) for k in places)}))").alias("best")
    return both.select("lang", "gram", "a", best).select("lang", "gram", "a", "best.l", "best.r", "best.score")


def not_inside(found: DataFrame, per_cent: int = 80) -> DataFrame:
    """(lang, gram): ``found`` but those inside a longer one that occurs ``per_cent`` of a hundred times as often, or more."""
    n = F.size("gram")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("gram", i, m))))
    longest = found.where(n > 2).select("lang", "a", F.explode(inner).alias("gram")).groupBy("lang", "gram").agg(F.max("a").alias("most"))
    return found.join(longest, ["lang", "gram"], "left").where(F.col("most").isNull() | (100 * F.col("most") < per_cent * F.col("a"))).select("lang", "gram")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counts = settle(word_counts(texts), "words")
    frequent = counts.where(F.col("f") >= least)
    found = settle(grams(texts, table_of(counts, least), least), "grams")
    kept = scored(frequent, found).join(not_inside(found), ["lang", "gram"])
    # ties at the end are kept until their words are known
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    words = first.select("lang", "gram", "a", "l", "r", "score", F.posexplode("gram").alias("pos", "h")).join(frequent.select("lang", "h", "word"), ["lang", "h"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")
    named = words.groupBy("lang", "gram", "a", "l", "r", "score").agg(phrase).drop("gram")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
