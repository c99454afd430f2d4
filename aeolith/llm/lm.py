"""Language-model scoring by a small causal self-attention network on subword ids.

Words (the tokens) are cut into subword ids of a public vocabulary.  The network reads the
ids before a word, also those of the words before, and gives the class of the next word,
or the end; counts over the whole training corpus give the word in its class:

    P(word | before) = P(class | ids before) * P(word | class)

A word's class is that of its first id: the ``OWN_OUTPUTS`` commonest first ids are classes
of their own, the others are clusters, so the softmax has ``CLASSES`` outputs instead of
fifty thousand.  P(word | class) is the word's count, discounted, and what the discount
leaves is shared by how words are spelled: the first id's share of its class, then each
id after the cluster of the id before it, and the stop.  So all words have a probability,
and all texts' probabilities sum to no more than one.

The network is one attention head with a bias for each distance, a residual, and a table
for the input just before; it is trained in numpy.  Scoring cuts the ids of a text into
overlapping windows of ``WINDOW``: the first ``OVERLAP`` of a window are context only (they
were scored in the window before), so each word is scored once; windows go through
masked attention in batches.

What is gathered from the corpus grows with it.  All training words are counted (one
shuffle, combined first); from the counts come the tables of spelling, which have a fixed
size given by the vocabulary (``KINDS`` * ids), and cover all words.  So do the counts of
neighbours that classes, kinds and the network's first table come from, and the network's
training: each place of each whole training text is a target in one round (which, a hash of
its ids says).  Texts of equal ids (copies) are one, with a weight of 1 + log2 of their number.
Texts are cut into ids once, when words are counted, and the ids stored for all that learns from them.
Texts are dealt to parts of some ``PART_WORDS`` words by a hash, so a model doesn't depend
on the number of cores; parts take local steps, and parameters are averaged between rounds
by a tree, so no task and not the driver holds more than ``FAN`` sets of them.  Only bounded tables come to the driver:
counts by vocabulary id and the ``HEAD`` commonest words (long ones by digest); the rarer
words get their counts by a join, without loss.

Null and empty texts have one token, the end.  Very long texts and words are scored whole
(slices bound the memory; long words are merged in n log n steps).  Repeated rows count and
score each; ties don't matter, as nothing is ranked but classes, by id.  Other columns of
the input aren't read.  Without training texts all counts are 0 and the network is uniform;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.llm.byte_bpe import _merge_long
from aeolith.llm.common import commonest, settle, slices
from aeolith.ship import ship

#: Outputs: the end, first ids of their own, clusters of the other first ids.
CLASSES, OWN_OUTPUTS = 128, 80
#: Clusters of ids: what spelling looks back on, and inputs of the rarer ids.
KINDS, SLOTS = 64, 64
DIM = 16
#: The network reads the commonest ids as such, the others as their kind; the first input is the start.
OWN_INPUTS = 2_047
INPUTS = 1 + OWN_INPUTS + KINDS
WINDOW, OVERLAP = 32, 8
STRETCH, EVERY_WORDS = 32, 600
HEAD, KEY_BYTES = 200_000, 32
ROUNDS, BATCH, RATE = 3, 128, 0.02
#: Words of a part, about; windows that take steps at once, and words of a run of ids.
PART_WORDS, PART_WINDOWS, RUN_WORDS, FAN = 1_000_000, 65_536, 8_192, 16
#: Windows of a step that look back together.
BLOCK = 64
#: Rows of an input that are added up layer by layer.
LAYERS = 16
SMOOTH, BACK = 0.5, 5.0
START, STOP = -1, -2
END = 0  # the class of the end
NONE = 255  # no target: an id inside a word

#: Longer words are merged by a heap.
LONG_WORD = 400
#: Characters that are counted or scored at once, and words that a worker remembers.
SLICE, SCORE_SLICE, CACHE_WORDS = 1_500_000, 750_000, 200_000
#: Ids of texts that are learned from at once, and what bounds a batch of texts that Spark hands to a worker.
SLICE_IDS = 400_000
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row (A-Z in lower case), and how many each text has."""
    raws = [t.encode("utf-8", "replace").lower() for t in texts]
    buffer = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
    blank = _BLANK[buffer]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[~blank])])
    ends = np.cumsum([len(r) + 1 for r in raws])
    return words, np.diff(np.searchsorted(start, ends, side="right"), prepend=0)


def as_bytes(a: pa.Array) -> list[bytes]:
    """A binary array without nulls as Python bytes, from its buffers."""
    if not len(a):
        return []
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].tolist()
    raw = data[o[0] : o[-1]].to_pybytes() if data else b""
    first = o[0]
    return [raw[x - first : y - first] for x, y in zip(o, o[1:])]


def key_of(word: bytes) -> bytes:
    """A word, or a digest after a space (which no word has) for those over ``KEY_BYTES``."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.md5(word, usedforsecurity=False).digest()


def _key(word: Column) -> Column:
    return F.when(F.octet_length(word) <= KEY_BYTES, word).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5(word))))


def over(words: list[bytes], size: int) -> list[int]:
    """Which words are longer."""
    return np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > size).tolist()


class Subwords:
    """Ids of words by a rank file: a word with the space before it is one piece."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def bulk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's ids begin, with the end).

        One call for all: a word's first id is the one that begins with its space.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        long = over(words, LONG_WORD)
        if long:
            short = list(words)
            for k in long:
                short[k] = b"x"
        text = b" ".join([b"", *(short if long else words)]).decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        first = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if long:
            parts, at, sizes = [], 0, np.diff(first)
            for k in long:
                own = np.frombuffer(_merge_long(b" " + words[k], self.ranks), "<u4").astype(np.int64)
                parts += [ids[at : first[k]], own]
                at, sizes[k] = first[k + 1], len(own)
            ids, first = np.concatenate([*parts, ids[at:]]), np.concatenate(([0], np.cumsum(sizes)))
        return ids, first

    def ids(self, word: bytes) -> list[int]:
        return self.bulk([word])[0].tolist()


_SUBWORDS: list[tuple[bytes, Subwords]] = []


def _subwords(data: bytes) -> Subwords:
    for known, s in _SUBWORDS:
        if known is data or known == data:
            return s
    _SUBWORDS[:] = [(data, Subwords(data))]
    return _SUBWORDS[0][1]


# ---- what is gathered from the corpus


def places(text: bytes, n: int) -> list[int]:
    """Where the training stretches of a text of ``n`` words begin: one for each started
    ``EVERY_WORDS`` words, drawn by a hash so that each word is as likely as the others; what
    would stand over an edge of the text is moved to it."""
    h, out = xxhash.xxh64_intdigest(text), []
    for lo in range(0, max(1, n), EVERY_WORDS):
        draw = ((h ^ lo) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 16
        reach = min(EVERY_WORDS, n - lo) + STRETCH
        out.append(min(max(0, lo - STRETCH + draw % reach), max(0, n - STRETCH)))
    return out


class Coder:
    """Ids of texts; a worker remembers the words it has met, with their ids as one array."""

    def __init__(self, sub: Subwords):
        self.sub = sub
        self.number: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The words' numbers in ``first``."""
        if len(self.number) > CACHE_WORDS:
            self.__init__(self.sub)
        kinds = as_bytes(distinct)
        own = np.fromiter(map(self.number.get, kinds, itertools.repeat(-1)), np.int64, len(kinds))
        if len(new := np.flatnonzero(own < 0)):
            own[new] = len(self.number) + np.arange(len(new))
            unseen = [kinds[k] for k in new.tolist()]
            ids, first = self.sub.bulk(unseen)
            self.ids, self.first = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.first, self.first[-1] + first[1:]))
            self.number.update(zip(unseen, own[new].tolist()))
        return own

    def spelled(self, number: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in a row, and how many each text has, from the numbers of their words."""
        size = np.diff(self.first)[number]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[number] - (upto - size), size) + np.arange(size.sum())]
        return ids, np.diff(np.append(0, upto)[np.append(0, np.cumsum(sizes))])

    def runs(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray]:
        """``as_runs`` of all ids of all texts."""
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        ids, n = self.spelled(self.numbers(coded.dictionary)[coded.indices.to_numpy()], sizes)
        return as_runs(ids, n, self.sub.begins)


def as_runs(ids: np.ndarray, n_ids: np.ndarray, begins: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of texts in a row, so many of each, in runs of ``RUN_WORDS`` words and one at most, with -1
    for a text's start and its end, and which text each run is of.  A run that goes on begins with
    the last word of the run before, so each word stands behind another (or the start) once."""
    word = np.flatnonzero(begins[ids])
    edge = np.searchsorted(word, np.append(0, np.cumsum(n_ids)))
    sizes = np.diff(edge)
    n_runs = np.maximum(1, -(-(sizes - 1) // RUN_WORDS))
    of = np.repeat(np.arange(len(n_ids)), n_runs)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    first = edge[of] + k * RUN_WORDS
    own = np.minimum(RUN_WORDS + 1, sizes[of] - k * RUN_WORDS)
    word = np.append(word, len(ids))
    lo, n = word[first], word[first + own] - word[first]
    # ids of each run, then its marks
    head, tail = (k == 0).astype(np.int64), (k == n_runs[of] - 1).astype(np.int64)
    offsets = np.append(0, np.cumsum(n + head + tail))
    flat = np.full(offsets[-1], -1, np.int32)
    row, upto = np.arange(n.sum()), np.cumsum(n) - n
    flat[np.repeat(offsets[:-1] + head - upto, n) + row] = ids[np.repeat(lo - upto, n) + row]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), of


def _width(size: int) -> np.dtype:
    """What an id of a vocabulary of this size is stored as."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def coded_texts(column: pa.BinaryArray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stored ids of texts in a row and how many each has, ``SLICE_IDS`` or one text at once."""
    kind = _width(size)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, kind, at[-1]) if data else np.zeros(0, kind)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_IDS, side="right")) - 1)
        yield ids[at[lo] : at[hi]], np.diff(at[lo : hi + 1])
        lo = hi


def gather(docs: DataFrame, vocabulary, text_col: str, stretches: bool = True) -> DataFrame:
    """(word, c, ids, a, b, whole): partial counts of all texts' words; of all pairs of neighbours (word null):
    how often slot b, 0 for the end, comes after a word whose first id is a; and, for a look at the
    texts, stretches of ids, with -1 for a text's start and its end.  Without stretches, each text's ids (whole),
    which training reads, so that texts are cut into ids once for all that learns from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SCORERS.clear()  # a worker's scorer of an earlier model
        sub = _subwords(vocabulary.value)
        coder = Coder(sub)
        found: list[tuple[pa.Array, np.ndarray]] = []
        held: list[list[int]] = []
        n_docs = 0
        after = np.zeros(sub.size * SLOTS, np.int64)
        width = _width(sub.size)

        def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
            blank = {f.name: pa.array(np.zeros(n, np.int64)) if f.name == "c" else pa.nulls(n, f.type) for f in kind}
            return pa.RecordBatch.from_pydict(blank | given, kind)

        def flush():
            """What was counted by slice, added up, and the stretches."""
            some = [pa.array([b" "], pa.binary()), *[x for x, _ in found]]
            c = [pa.array([n_docs], pa.int64()), *[pa.array(x) for _, x in found]]  # no word has a space: the end's count
            t = pa.table({"word": pa.concat_arrays(some), "c": pa.concat_arrays(c)}).group_by("word", use_threads=False).aggregate([("c", "sum")])
            yield rows(t.num_rows, word=t["word"].combine_chunks(), c=t["c_sum"].combine_chunks())
            yield rows(len(held), ids=pa.array(held, pa.list_(pa.int32())))
            found.clear()
            held.clear()

        for batch in batches:
            for texts in slices(batch.column(0), SLICE):
                words, sizes = words_of(texts)
                n_docs += len(texts)
                ids, n_ids = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
                if len(words):
                    coded = words.dictionary_encode()
                    index = coded.indices.to_numpy()
                    found.append((coded.dictionary, np.bincount(index)))
                    number = coder.numbers(coded.dictionary)
                    first_id = coder.ids[coder.first[number]][index]
                    slot = np.append(_slot(first_id[1:]), 0)
                    slot[np.cumsum(sizes)[sizes > 0] - 1] = 0
                    np.add.at(after, first_id.astype(np.int64) * SLOTS + slot, 1)
                    if not stretches:
                        ids, n_ids = coder.spelled(number[index], sizes)
                if sum(len(x) for x, _ in found) > 1_000_000:
                    yield from flush()
                    n_docs = 0
                if not stretches:
                    data = ids.astype(width)
                    offsets = (np.append(0, np.cumsum(n_ids)) * width.itemsize).astype(np.int32)
                    yield rows(len(texts), whole=pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
                    continue
                # stretches begin at places that spread over each text
                origin = np.cumsum(sizes) - sizes
                begin = [(o, at, n) for t, o, n in zip(texts, origin.tolist(), sizes.tolist()) for at in places(t.encode("utf-8", "replace"), n)]
                own = np.array([min(STRETCH, n - at) for _, at, n in begin], np.int64)
                first_word = np.array([o + at for o, at, _ in begin], np.int64)
                row = np.repeat(first_word - (np.cumsum(own) - own), own) + np.arange(own.sum())
                ids, first = sub.bulk(as_bytes(words.take(pa.array(row))))
                edge = first[np.concatenate(([0], np.cumsum(own)))].tolist()
                for (_, at, n), k, x, y in zip(begin, own.tolist(), edge, edge[1:]):
                    held.append(([-1] if at == 0 else []) + ids[x:y].tolist() + ([-1] if at + k >= n else []))
        yield from flush()
        k = np.flatnonzero(after)
        yield rows(len(k), c=pa.array(after[k]), a=pa.array((k // SLOTS).astype(np.int32)), b=pa.array((k % SLOTS).astype(np.int32)))

    kind = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("ids", pa.list_(pa.int32())), ("a", pa.int32()), ("b", pa.int32()), ("whole", pa.binary())])
    return docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t")).mapInArrow(run, "word binary, c bigint, ids array<int>, a int, b int, whole binary")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What counts of 1, 2 and more give to words that aren't there, by Good and Turing."""
    n = {r.c: r["count"] for r in counts.where("c between 1 and 4").groupBy("c").count().collect()}
    return tuple(min(k - 0.1, max(0.1, k - (k + 1) * n.get(k + 1, 0) / n[k])) if n.get(k) else 0.75 for k in (1, 2, 3))


def spelling(counts: DataFrame, vocabulary, taken: tuple[float, float, float]) -> DataFrame:
    """(a, b, c, t, d) from word counts: how often id b comes after id a in a word, in running text
    and in distinct words, and what is taken from the words' counts; a is START for a word's
    first id, b is STOP after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _subwords(vocabulary.value)
        words: list[bytes] = []
        counts: list[int] = []

        def flush():
            ids, first = sub.bulk(words)
            n = np.diff(first)
            c = np.array(counts, np.int64)
            weight = np.concatenate((np.repeat(c, n), c))
            less = np.array([0.0, *taken])[np.minimum(c, 3)]
            before = np.append(START, ids[:-1])
            before[first[:-1]] = START
            key = np.concatenate(((before + 2 << 32) | (ids + 2), ids[first[1:] - 1] + 2 << 32 | (STOP + 2)))
            kinds, place = np.unique(key, return_inverse=True)
            total = np.bincount(place, weights=weight, minlength=len(kinds)).astype(np.int64)
            types = np.bincount(place, minlength=len(kinds))
            less = np.bincount(place, weights=np.concatenate((np.repeat(less, n), less)), minlength=len(kinds))
            words.clear()
            counts.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(((kinds >> 32) - 2).astype(np.int32)), "b": pa.array(((kinds & 0xFFFFFFFF) - 2).astype(np.int32)), "c": pa.array(total), "t": pa.array(types), "d": pa.array(less)})

        for batch in batches:
            for word, c in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words.append(word)
                counts.append(c)
            if len(words) > 100_000:
                yield flush()
        if words:
            yield flush()

    return counts.select("word", "c").mapInArrow(run, "a int, b int, c bigint, t bigint, d double").groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("d").alias("d"))


def followers(coded: DataFrame, begins: np.ndarray, number_a: np.ndarray, number_b: np.ndarray) -> DataFrame:
    """(a, b, c) of all texts' ids (whole): how often a word comes (by the number of its first id in ``number_b``)
    after an id (by its number in ``number_a``).  The numbers' last places are a text's start or end."""
    sent = coded.sparkSession.sparkContext.broadcast((begins, number_a, number_b))
    width = int(number_b.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SCORERS.clear()
        begins, of, to = sent.value
        marked = np.append(begins, True)
        total = np.zeros((int(of.max()) + 1) * width, np.int64)
        for ids, n in (x for batch in batches for x in coded_texts(batch.column(0), len(begins))):
            runs, _ = as_runs(ids, n, begins)
            flat, sizes = runs.flatten().to_numpy(), np.diff(runs.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            later = np.flatnonzero(marked[flat])[1:]
            before = later - 1
            same = row[before] == row[later]
            np.add.at(total, of[flat[before[same]]] * width + to[flat[later[same]]], 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a": pa.array((k // width).astype(np.int32)), "b": pa.array((k % width).astype(np.int32)), "c": pa.array(total[k])})

    return coded.select("whole").mapInArrow(run, "a int, b int, c bigint").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _dense(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """(a, b, c) as a matrix; there are at most as many rows as it has places."""
    t = df.toArrow()
    out = np.zeros(shape, np.float32)
    out[t["a"].to_numpy(), t["b"].to_numpy()] = t["c"].to_numpy()
    return out


def _slot(ids: np.ndarray) -> np.ndarray:
    """Ids by a hash in the slots from 1 on."""
    return 1 + ids.astype(np.int64) * 40503 % 65521 % (SLOTS - 1)


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means from a fixed seed; rows without weight join the nearest centre."""
    if not len(x):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(7)
    some = weight if weight.sum() else np.ones(len(x))
    heavy = some > 0
    y, w = x[heavy], some[heavy].astype(np.float32)
    centre = x[rng.choice(len(x), min(k, len(y)), replace=False, p=some / some.sum())]
    for _ in range(rounds):
        near = np.argmax(y @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        own = near[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        mass = np.add.reduceat(w[order], first)
        rows = y[order]
        rows *= w[order, None]
        centre[own[first]] = np.add.reduceat(rows, first, axis=0) / mass[:, None]
    return np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)


# ---- the network


class Net(NamedTuple):
    """Parameters, in single precision."""

    embed: np.ndarray  # (INPUTS, D)
    qkv: np.ndarray  # (D, 3 D)
    bias: np.ndarray  # (WINDOW,): by distance
    out: np.ndarray  # (2 D, C): of attention's values and of the place itself
    last: np.ndarray  # (INPUTS, C): by the input just before
    base: np.ndarray  # (C,)


def inputs_of(seen: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The network's input for each vocabulary id, and for the start at the last place."""
    out = 1 + OWN_INPUTS + kind
    top = np.argsort(-seen, kind="stable")[:OWN_INPUTS]
    top = top[seen[top] > 0]
    out[top] = 1 + np.arange(len(top))
    return np.append(out, 0)


def start_net(last: np.ndarray | None = None, seed: int = 3) -> Net:
    """Small random weights; ``last`` begins as the logarithm of what the counts of pairs say."""
    r = np.random.default_rng(seed)
    f = lambda *s, x=0.3: (r.standard_normal(s) * x).astype(np.float32)
    last = np.zeros((INPUTS, CLASSES)) if last is None else last
    return Net(f(INPUTS, DIM, x=0.5), f(DIM, 3 * DIM), np.zeros(WINDOW, np.float32), f(2 * DIM, CLASSES, x=0.02), last.astype(np.float32), np.zeros(CLASSES, np.float32))


def last_table(counts: np.ndarray) -> np.ndarray:
    """log P(class | input before) from counts of pairs, with the classes' shares behind them."""
    overall = counts.sum(0) + 1.0
    table = counts + 10.0 * overall / overall.sum()
    return np.log(table / table.sum(1, keepdims=True))


_LOG2E = math.log2(math.e)
_I = np.arange(WINDOW)
_DISTANCE = np.maximum(0, _I[:, None] - _I[None, :])
_FUTURE = _I[None, :] > _I[:, None]


def _nearness(bias: np.ndarray) -> np.ndarray:
    """A factor by distance, none for what comes later."""
    return np.where(_FUTURE, bias.dtype.type(0), np.exp(np.clip(bias, -20, 20))[_DISTANCE])


def steady() -> None:
    """Freeing a large block once lets the C library keep memory of lesser arrays for the next ones
    instead of giving it back each time; else half of a step goes into page faults."""
    np.empty(24 << 20, np.uint8)


class Tables:
    """A network made ready for scoring: an input is embedded without its place, so its query,
    key, value and own part of the output are rows of tables."""

    def __init__(self, net: Net):
        qkv = net.embed @ net.qkv
        # exponents are of 2, whose powers numpy is faster at
        self.query = np.ascontiguousarray(qkv[:, :DIM]) * np.float32(_LOG2E / math.sqrt(DIM))
        self.key = np.ascontiguousarray(qkv[:, DIM : 2 * DIM])
        # a value and a one, which adds up what the weights are divided by
        self.value = np.hstack((qkv[:, 2 * DIM :], np.ones((len(qkv), 1), np.float32)))
        self.own = (net.last + net.embed @ net.out[DIM:] + net.base) * np.float32(_LOG2E)
        self.out = net.out[:DIM] * np.float32(_LOG2E)
        self.near = _nearness(net.bias).astype(np.float32)
        # whether sums can leave what exp can take
        self.far = _longest(self.query) * _longest(self.key) > 60 * _LOG2E
        self.wide = float(np.abs(self.own).max()) + _longest(self.value[:, :DIM]) * _longest(self.out.T) > 80 * _LOG2E

    def scores(self, c: np.ndarray, pos: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of ``target`` behind the places ``pos`` of windows ``c`` (inputs); as many for
        each window.  Products are made window by window, as their rows are rounded by where they stand."""
        later = np.take_along_axis(c, pos, 1)
        s = np.matmul(self.query.take(later, axis=0, mode="clip"), self.key.take(c, axis=0, mode="clip").transpose(0, 2, 1))
        if self.far:
            np.clip(s, np.float32(-60 * _LOG2E), np.float32(60 * _LOG2E), out=s)
        np.exp2(s, out=s)
        s *= self.near.take(pos, axis=0, mode="clip")
        h = np.matmul(s, self.value.take(c, axis=0, mode="clip"))
        # over e-80: the place itself is always seen
        z = np.matmul(h[..., :DIM] / h[..., DIM:], self.out).reshape(-1, CLASSES)
        z += self.own.take(later.ravel(), axis=0, mode="clip")
        if self.wide:
            np.clip(z, np.float32(-80 * _LOG2E), np.float32(80 * _LOG2E), out=z)
        want = z.ravel().take(np.arange(0, z.size, CLASSES) + target.ravel(), mode="clip")
        np.exp2(z, out=z)
        return ((want - np.log2(z.sum(1))) / np.float32(_LOG2E)).reshape(target.shape)


def _longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return math.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` from each place of ``first`` to the next."""
    return np.add.reduceat(x, first, axis=0) if len(first) else x[:0]


class Groups:
    """Rows by the input they are of, in an order in which sums by input need no gathering: the inputs with the most
    rows first; the first rows of all inputs, the second rows of those that have two, and so on for ``LAYERS``; then what
    is left, input by input."""

    def __init__(self, inputs: np.ndarray):
        order = np.argsort(inputs, kind="stable")
        sizes = np.bincount(inputs, minlength=1)
        used = np.flatnonzero(sizes)
        sizes = sizes[used]
        by = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[by]
        self.inputs, sizes = used[by], sizes[by]
        # so many inputs have a first row, a second one, ...
        *self.counts, late = np.searchsorted(-sizes, -np.arange(LAYERS + 1)).tolist()
        more = sizes[:late] - LAYERS
        self.tail = np.repeat(np.arange(late), more)  # inputs of the rows that are left
        left = np.repeat(first[:late] + LAYERS - (np.cumsum(more) - more), more) + np.arange(len(self.tail))
        #: the rows in this order
        self.order = order.take(np.concatenate([*(first[:n] + k for k, n in enumerate(self.counts)), left]))

    def add(self, x: np.ndarray, table: np.ndarray) -> None:
        """Adds to each of the rows (in this order) its input's row of ``table`` (in the order of ``inputs``)."""
        at = 0
        for n in self.counts:
            x[at : at + n] += table[:n]
            at += n
        x[at:] += table.take(self.tail, axis=0)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each of ``inputs`` the sum of its rows (in this order)."""
        out, at = x[: len(self.inputs)].copy(), len(self.inputs)
        for n in self.counts[1:]:
            out[:n] += x[at : at + n]
            at += n
        if len(self.tail):
            late = int(self.tail[-1]) + 1
            out[:late] += (self.tail == np.arange(late)[:, None]).astype(x.dtype) @ x[at:]
        return out


def gradients(net: Net, c: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Net]:
    """Mean loss over the places with a target, weighted by window, and its gradients; those of the
    tables by input as (inputs that occur, their rows).

    Only places with a target look back: windows are taken in blocks of like numbers of targets, each window's filled up to
    its block's most by places without a gradient.  What an input has by itself (query, key, value, own part of
    the output) is made, and its gradient is followed back, once for all places that have it."""
    n, real = c.shape[1], net.embed.dtype.type
    has = target != NONE
    m = has.sum(1)
    windows = np.argsort(m, kind="stable")
    c, target, has, m = c[windows], target[windows], has[windows], m[windows]
    row, col = np.nonzero(has)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    place = row * n + col
    order = np.argsort(c, axis=None, kind="stable")
    inputs = c.ravel()[order]
    first = np.flatnonzero(np.append(True, inputs[1:] != inputs[:-1]))
    inputs = inputs[first]
    number = np.empty(len(net.embed), np.int64)
    number[inputs] = np.arange(len(inputs))
    code = number[c]
    some = Groups(code.ravel().astype(np.int16)[place])

    # exponents are of 2, whose powers numpy is faster at
    e = net.embed.take(inputs, axis=0)
    qkv = e @ net.qkv
    query, key = qkv[:, :DIM] * real(_LOG2E / math.sqrt(DIM)), np.ascontiguousarray(qkv[:, DIM : 2 * DIM])
    # a value and a one, which adds up what the weights are divided by
    value = np.hstack((qkv[:, 2 * DIM :], np.ones((len(qkv), 1), real)))
    near = _nearness(net.bias)[:n, :n]
    far = _longest(query) * _longest(key) > 60 * _LOG2E

    blocks, h = [], np.empty((len(row), DIM + 1), real)
    for lo in range(0, len(c), BLOCK):
        hi = min(lo + BLOCK, len(c))
        t = slice(*np.searchsorted(row, (lo, hi)).tolist())
        if t.start == t.stop:
            continue
        most = int(m[hi - 1])
        pos = np.full((hi - lo, most), n - 1)
        at = (row[t] - lo) * most + slot[t]
        pos.ravel()[at] = col[t]
        k, v = key.take(code[lo:hi], axis=0), value.take(code[lo:hi], axis=0)
        q = query.take(np.take_along_axis(code[lo:hi], pos, 1), axis=0)
        s = np.matmul(q, k.transpose(0, 2, 1))
        if far:
            np.clip(s, -60 * _LOG2E, 60 * _LOG2E, out=s)
        np.exp2(s, out=s)
        s *= near.take(pos, axis=0)
        h[t] = np.matmul(s, v).reshape(-1, DIM + 1).take(at, axis=0)
        blocks.append((lo, hi, t, at, pos, q, k, v, s))
    weights = h[:, DIM:]
    h = h[:, :DIM] / weights  # over e-80: the place itself is always seen

    # the classes, by input, so that an input's rows of the table and of its gradient stand together
    before = e.take(some.inputs, axis=0)
    by_input = net.last.take(inputs[some.inputs], axis=0)
    by_input += net.base
    by_input += before @ net.out[DIM:]
    by_input *= real(_LOG2E)
    out = net.out[:DIM] * real(_LOG2E)
    given, want = h.take(some.order, axis=0), target.ravel()[place[some.order]]
    p = given @ out
    some.add(p, by_input)
    if np.abs(by_input).max(initial=0) + _longest(value[:, :DIM]) * _longest(out.T) > 80 * _LOG2E:
        np.clip(p, -80 * _LOG2E, 80 * _LOG2E, out=p)  # logarithms of shares with small corrections
    np.exp2(p, out=p)
    mass = p @ np.ones(CLASSES, p.dtype)
    share = weight[windows][row[some.order]].astype(p.dtype)
    total = max(1e-9, float(share.sum()))
    at = np.arange(len(row))
    loss = -float((np.log(p[at, want] / mass) * share).sum()) / total
    share /= real(total)
    p *= (share / mass)[:, None]
    p[at, want] -= share
    d_last = some.sums(p)
    d_out = np.zeros_like(net.out)
    for lo in range(0, len(p), 256):  # a product of so many rows stays in the cache
        d_out[:DIM] += given[lo : lo + 256].T @ p[lo : lo + 256]
    d_out[DIM:] = before.T @ d_last
    back = np.empty_like(some.order)
    back[some.order] = at
    d_h = np.empty((len(row), DIM + 1), real)
    d_h[:, :DIM] = (p @ net.out[:DIM].T).take(back, axis=0)
    # sum over j of s d_s is h d_h
    d_h[:, DIM] = (h * d_h[:, :DIM]) @ np.full(DIM, -1, real)
    d_h /= weights

    d_q, d_kv, d_near = np.empty_like(h), np.zeros((len(c), n, 2 * DIM), real), np.zeros((n, n), real)
    for lo, hi, t, at, pos, q, k, v, s in blocks:
        g = np.zeros((*pos.shape, DIM + 1), real)
        g.reshape(-1, DIM + 1)[at] = d_h[t]
        d_s = np.matmul(g, v.transpose(0, 2, 1))
        d_s *= s
        d_near += (pos.ravel() == _I[:n, None]).astype(real) @ d_s.reshape(-1, n)
        d_q[t] = np.matmul(d_s, k).reshape(-1, DIM).take(at, axis=0)
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_kv[lo:hi, :, :DIM])
        np.matmul(s.transpose(0, 2, 1), g[..., :DIM], out=d_kv[lo:hi, :, DIM:])
    d_bias = np.bincount(_DISTANCE[:n, :n].ravel(), weights=d_near.ravel(), minlength=WINDOW).astype(real)
    d_qkv = np.zeros_like(qkv)
    d_qkv[some.inputs, :DIM] = some.sums(d_q.take(some.order, axis=0)) * real(1 / math.sqrt(DIM))
    d_qkv[:, DIM:] = _sums(d_kv.reshape(-1, 2 * DIM).take(order, axis=0), first)
    d_qkv[:, DIM : 2 * DIM] *= real(1 / _LOG2E)  # of the query, as it was scaled
    d_embed = d_qkv @ net.qkv.T
    d_embed[some.inputs] += d_last @ net.out[DIM:].T
    return loss, Net((inputs, d_embed), e.T @ d_qkv, d_bias, d_out, (inputs[some.inputs], d_last), d_last.sum(0))


def fit(net: Net, given: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float = RATE, seed: int = 1) -> Net:
    """One pass of Adam over windows: inputs, the classes that come after them, and weights.  Of the
    tables by input each step moves the rows that occur."""
    r = np.random.default_rng(seed)
    params = [a.astype(np.float32).copy() for a in net]
    m1, m2, t = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    order = r.permutation(len(given))
    steps = max(1, -(-len(order) // BATCH))
    for at in range(0, len(order), BATCH):
        w = order[at : at + BATCH]
        _, grads = gradients(Net(*params), given[w], target[w], weight[w])
        t += 1
        now, wide = rate * (1 - 0.9 * t / steps) / (1 - 0.9**t), math.sqrt(1 - 0.99**t)
        for a, g, u, v in zip(params, grads, m1, m2):
            rows, g = g if isinstance(g, tuple) else (None, g)
            x, y = (u, v) if rows is None else (u.take(rows, axis=0), v.take(rows, axis=0))
            # in place: 0.9 u + 0.1 g, 0.99 v + 0.01 g g, and the first by the root of the second
            x *= 0.9
            y *= 0.99
            x += 0.1 * g
            g *= g
            g *= 0.01
            y += g
            np.sqrt(y, out=g)
            g += 1e-6 * wide
            np.divide(x, g, out=g)
            g *= now * wide
            if rows is None:
                a -= g
            else:
                u[rows], v[rows], a[rows] = x, y, a.take(rows, axis=0) - g
    return Net(*params)


def cut(packed: np.ndarray, sizes: np.ndarray, lead: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of packed ids in a row, of these sizes, as (flat, where each window begins in it,
    which run it is of): windows of ``WINDOW`` inputs and the targets after them, of which the
    first ``overlap`` are context.  A run stands behind ``lead`` starts and is filled up at its
    end with what has no target."""
    step = WINDOW - overlap
    # the first window's targets begin at place overlap + 1
    n_windows = np.maximum(1, -(-(sizes + lead - overlap - 1) // step))
    length = n_windows * step + overlap + 1
    origin = np.cumsum(length) - length
    flat = np.full(int(length.sum()), NONE, np.int32)
    flat[np.repeat(origin + lead - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(packed))] = packed
    k = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    return flat, np.repeat(origin, n_windows) + k * step, np.repeat(np.arange(len(sizes)), n_windows)


def as_windows(rows: pa.Array, packs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches as the network's inputs, targets and weights, in windows that don't overlap: all words
    are a target once, behind nothing to a whole window.  Of a stretch from a text's start the
    first input is the start, of others the first id.
    """
    flat, sizes = rows.flatten().to_numpy().astype(np.int64), np.diff(rows.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    at_start = np.zeros(len(sizes), bool)
    some = sizes > 0
    at_start[some] = flat[begin[some]] == -1
    packed = packs[flat]
    drop = np.zeros(len(flat), bool)
    drop[begin[at_start]] = True  # the start's mark: its place is taken by the lead
    packed, sizes = packed[~drop], sizes - at_start
    run = np.repeat(np.arange(len(sizes)), sizes)
    parts = []
    for own, lead in ((at_start, 1), (~at_start, 0)):
        if own.any():
            full, start, of = cut(packed[own[run]], sizes[own], lead, 0)
            place = start[:, None] + np.arange(WINDOW + 1)[None, :]
            w = full[place]
            parts.append((w[:, :-1] >> 8, w[:, 1:] & 255, weight[own][of]))
    if not parts:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def averaged(sets: DataFrame, parts: int) -> np.ndarray:
    """The mean by weight of parameter sets (part, n, p), by a tree: ``FAN`` of them make one, in
    the order of their numbers, until at most ``FAN`` come to the driver."""

    def run(batches):
        held = None

        def out(x):
            return pa.RecordBatch.from_pydict({"part": pa.array([x[0]], pa.int64()), "n": pa.array([x[1]], pa.float64()), "p": pa.array([(x[2] / x[1]).astype(np.float32)], pa.list_(pa.float32()))})

        for b in batches:
            for i in range(b.num_rows):
                group, n, p = b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].values.to_numpy()
                if held is not None and held[0] != group:
                    yield out(held)
                    held = None
                if held is None:
                    held = [group, 0.0, np.zeros(len(p))]
                held[1] += n
                held[2] += n * p
        if held is not None:
            yield out(held)

    while parts > FAN:
        dealt = sets.select(F.floor(F.col("part") / FAN).alias("g"), "part", "n", "p")
        parts = -(-parts // FAN)
        sets = settle(dealt.repartition(min(parts, 256), "g").sortWithinPartitions("g", "part").mapInArrow(run, "part bigint, n double, p array<float>"), "sets")
    got = sorted(sets.collect(), key=lambda r: r.part)
    weight = np.array([g.n for g in got])
    return np.average(np.array([g.p for g in got]), axis=0, weights=weight).astype(np.float32)


def train_net(coded: DataFrame, n_words: int, start: Net, packs: np.ndarray) -> Net:
    """Steps on all texts' ids (whole), of some ``n_words``: a hash deals texts to rounds and, in
    each, to parts that take local steps; parameters are averaged between rounds."""
    sc = coded.sparkSession.sparkContext
    table = sc.broadcast(packs)
    size_of_id = _width(len(packs) - 1)
    parts = max(1, -(-n_words // (ROUNDS * PART_WORDS)))
    texts = coded.select("whole").withColumn("h", F.xxhash64("whole"))
    texts = texts.withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(parts)))
    net = start

    def once(batches):
        # equal texts of a batch are one, so that copies don't gather in the task of their part
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["part", "h", "whole"], use_threads=False).aggregate([([], "count_all")])
            yield from t.rename_columns(["part", "h", "whole", "m"]).combine_chunks().to_batches()

    for k in range(ROUNDS):
        sent = sc.broadcast(net)

        def run(batches, sent=sent, k=k):
            _SCORERS.clear()
            steady()
            start, packs = sent.value, table.value
            begins = packs[:-1] & 255 != NONE
            part, net, mass = None, start, 0.0
            some, copies, size = [], [], 0  # texts with their copies
            held, windows = [], 0  # windows that wait for a step

            def step():
                nonlocal net, mass, windows
                if windows:
                    given, target, weight = (np.concatenate(x) for x in zip(*held))
                    net = fit(net, given, target, weight, RATE / (1 + k), seed=1000 * part + k)
                    mass += float(weight.sum())
                held.clear()
                windows = 0

            def cut_up():
                nonlocal size, windows
                if some:
                    n = np.array([len(x) for x in some]) // size_of_id.itemsize
                    rows, of = as_runs(np.frombuffer(b"".join(some), size_of_id), n, begins)
                    weight = 1 + np.log2(np.array(copies, float))[of]
                    for at in range(0, len(rows), 4096):
                        given, target, w = as_windows(rows.slice(at, 4096), packs, weight[at : at + 4096])
                        for lo in range(0, len(w), PART_WINDOWS):
                            own = slice(lo, lo + PART_WINDOWS)
                            held.append((given[own].astype(np.int16), target[own].astype(np.uint8), w[own]))
                            windows += len(w[own])
                            if windows >= PART_WINDOWS:
                                step()
                some.clear()
                copies.clear()
                size = 0

            def close():
                nonlocal net, mass
                cut_up()
                step()
                if mass:
                    flat = np.concatenate([a.ravel() for a in net]).astype(np.float32)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([mass]), "p": pa.array([flat], pa.list_(pa.float32()))})
                net, mass = start, 0.0

            last = None
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    for p, text, m in zip(*(c.slice(i, 256).to_pylist() for c in (b.column(0), b.column(2), b.column(3)))):
                        if (p, text) == last:
                            copies[-1] += m
                            continue
                        if p != part:
                            yield from close()
                            part = p
                        elif size >= SLICE_IDS:
                            cut_up()
                        last = p, text
                        some.append(text)
                        copies.append(m)
                        size += len(text) // size_of_id.itemsize
            yield from close()

        own = texts.where(F.pmod("h", F.lit(ROUNDS)) == k).select("part", "h", "whole").mapInArrow(once, "part bigint, h bigint, whole binary, m bigint")
        dealt = own.repartitionById(min(parts, 4096), F.pmod("part", F.lit(4096)).cast("int")).sortWithinPartitions("part", "h", "whole")
        sets = settle(dealt.mapInArrow(run, "part bigint, n double, p array<float>"), "fitted")
        if sets.isEmpty():
            continue
        flat = averaged(sets, parts)
        ends = np.cumsum([a.size for a in net])[:-1]
        net = Net(*[a.reshape(b.shape) for a, b in zip(np.split(flat, ends), net)])
    return net


@dataclass
class Model:
    """All that scoring needs; its size is given by the vocabulary and ``HEAD``, not by the corpus."""

    net: Net
    packs: np.ndarray  # input and target (if first) of each id; the end at the last place
    classes: np.ndarray  # of first ids
    mass: np.ndarray  # tokens by class, 1 at least
    taken: tuple[float, float, float]  # what counts of 1, 2 and more give away
    lead: np.ndarray  # log10 of what a first id's new words share of its class
    kinds: np.ndarray
    follow: np.ndarray  # (KINDS, ids + 1): log10 P(id after an id of this kind); the stop at the last place
    head: dict[bytes, int]
    train_tokens: int
    distinct: int
    end_count: int


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of texts are small meanwhile: each task holds several at once, in the JVM and in its worker."""
    given = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in given.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def train(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the settled word counts (word, key, c), fitted on all of ``docs``."""
    with small_batches(docs.sparkSession):
        return _train(docs, vocabulary_path, text_col)


def _train(docs: DataFrame, vocabulary_path: str, text_col: str) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    got = settle(gather(docs, vocabulary, text_col, stretches=False), "gathered")
    coded = got.where("whole is not null").select("whole")
    counts = got.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"))
    counts = settle(counts.select("word", _key(F.col("word")).alias("key"), "c"), "counts")
    total = counts.where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_texts = int(counts.where(F.col("word") == F.lit(b" ")).agg(F.sum("c")).first()[0] or 0)
    sub = _subwords(vocabulary.value)
    size = sub.size
    real = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(b" ")))
    taken = discounts(real)
    pairs = settle(spelling(real, vocabulary, taken), "spelling")

    # at most one row for each id, or for each id and slot, or kind and id
    firsts = pairs.where(F.col("a") == START).select("b", "c", "t", "d").toArrow()
    tokens, types, given = np.zeros((3, size))
    for x, name in ((tokens, "c"), (types, "t"), (given, "d")):
        x[firsts["b"].to_numpy()] = firsts[name].to_numpy()
    slot = F.when(F.col("b") == STOP, 0).otherwise(1 + F.col("b").cast("long") * 40503 % 65521 % (SLOTS - 1)).cast("int")
    inside = _dense(pairs.where(F.col("a") >= 0).groupBy("a", slot.alias("b")).agg(F.sum("c").alias("c")), (size, SLOTS))
    across = _dense(got.where("a is not null").groupBy("a", "b").agg(F.sum("c").alias("c")), (size, SLOTS))
    seen = inside.sum(1)
    # ids that don't occur are of kind 0; the others go by what comes after them
    some = np.flatnonzero(seen > 0)
    x = np.hstack([np.sqrt(c[some] / np.maximum(1, c[some].sum(1, keepdims=True))) for c in (inside, across)])
    del inside, across
    kinds = np.zeros(size, np.int64)
    kinds[some] = clusters(x, np.sqrt(seen[some]), KINDS)
    classes = np.full(size, CLASSES - 1)
    order = np.argsort(-tokens, kind="stable")
    order = order[sub.begins[order]]
    own, rest = order[:OWN_OUTPUTS], order[OWN_OUTPUTS:]
    rest = rest[tokens[rest] > 0]
    classes[own] = 1 + np.arange(len(own))
    classes[rest] = 1 + OWN_OUTPUTS + clusters(x[np.searchsorted(some, rest)], np.sqrt(tokens[rest]), CLASSES - 1 - OWN_OUTPUTS)
    del x
    mass = np.bincount(classes, weights=tokens, minlength=CLASSES)
    # words that aren't there are spelled as the distinct words are
    in_class = np.bincount(classes[sub.begins], weights=types[sub.begins] + SMOOTH, minlength=CLASSES)
    left = np.where(mass > 0, np.bincount(classes, weights=given, minlength=CLASSES) / np.maximum(mass, 1), 1.0)
    lead = np.log10(left[classes]) + np.log10((types + SMOOTH) / np.maximum(in_class, SMOOTH)[classes])

    kind_of = spark.createDataFrame(pa.table({"a": pa.array(np.arange(size), pa.int32()), "k": pa.array(kinds, pa.int32())}))
    place = F.when(F.col("b") == STOP, size).otherwise(F.col("b"))
    follow = _dense(pairs.join(F.broadcast(kind_of), "a").groupBy(F.col("k").alias("a"), place.alias("b")).agg(F.sum("t").alias("c")), (KINDS, size + 1))
    share = follow.sum(0) + np.append(np.where(sub.begins, 0.0, SMOOTH), SMOOTH)
    mass_of = follow.sum(1, keepdims=True) + np.float32(BACK)
    follow += (BACK * share / share.sum()).astype(np.float32)
    follow /= mass_of
    np.log10(np.maximum(follow, np.float32(1e-30), out=follow), out=follow)

    inputs = inputs_of(seen, kinds)
    packs = np.append(inputs[:-1] * 256 + np.where(sub.begins, classes, NONE), END)
    last = last_table(_dense(followers(coded, sub.begins, inputs, np.append(classes, END)), (INPUTS, CLASSES)))
    net = train_net(coded, int(total.n or 0), start_net(last), packs)
    head = commonest(real.select("key", "c"), "c", HEAD).toArrow()
    table = dict(zip(head["key"].to_pylist(), head["c"].to_pylist()))
    return Model(net, packs, classes, np.maximum(1, mass), taken, lead, kinds, follow, table, int(total.n or 0), int(total.v or 0), n_texts), counts


class Scorer:
    """A worker's scoring state: the words it has met, by number, with their ids as one array."""

    def __init__(self, model: Model, sub: Subwords):
        self.model, self.sub = model, sub
        self.tables = Tables(model.net)
        self.reset()

    def reset(self) -> None:
        """Only the end is known, as word 0, whose one id is the end's mark."""
        self.number: dict[bytes, int] = {b" ": 0}
        self.keys = [b" "]
        end = self.model.end_count
        self.packs, self.first = np.array([END], np.int32), np.array([0, 1], np.int32)
        # by word: log10(count + 1) and log10 P(word | class), if it is of the head; what its spelling gives, and log10 of its class's tokens
        self.base, self.own = np.array([math.log10(end + 1) if end else np.nan]), np.zeros(1)
        self.spelled, self.mass = np.zeros(1), np.zeros(1)

    def learn(self, new: list[bytes]) -> None:
        m = self.model
        ids, first = self.sub.bulk(new)
        begin = first[:-1]
        each = m.follow[m.kinds[np.append(0, ids[:-1])], ids].astype(float)
        each[begin] = m.lead[ids[begin]]
        stop = m.follow[m.kinds[ids[first[1:] - 1]], m.follow.shape[1] - 1]
        spelled = np.add.reduceat(each, begin) + stop
        mass = m.mass[m.classes[ids[begin]]]
        keys = list(new)
        for k in over(new, KEY_BYTES):
            keys[k] = key_of(new[k])
        c = np.fromiter(map(m.head.get, keys, itertools.repeat(np.nan)), float, len(keys))
        known = np.flatnonzero(c == c)
        base, own = np.full((2, len(c)), np.nan)
        base[known] = np.log10((c := c[known]) + 1)
        own[known] = np.log10((c - np.array([0.0, *m.taken])[np.clip(c, 0, 3).astype(int)]) / mass[known] + 10.0 ** spelled[known])
        self.base, self.own = np.concatenate((self.base, base)), np.concatenate((self.own, own))
        self.spelled, self.mass = np.concatenate((self.spelled, spelled)), np.concatenate((self.mass, np.log10(mass)))
        self.first = np.concatenate((self.first, self.first[-1] + first[1:].astype(np.int32)))
        packs = m.packs[ids].astype(np.int32)
        inside = np.ones(len(ids), bool)
        inside[begin] = False
        packs[inside] |= NONE
        self.packs = np.concatenate((self.packs, packs))
        self.number.update(zip(new, range(len(self.keys), len(self.keys) + len(new))))
        self.keys += keys

    def texts(self, texts: list[str]) -> dict[str, pa.Array]:
        """Of each text: n, known and base (over the head's words), score (with the head's words in
        their classes), and the rare words with their numbers of times and their spelling, times their class's tokens."""
        if len(self.keys) > CACHE_WORDS:
            self.reset()
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        kinds = as_bytes(coded.dictionary)
        known = self.number
        number = np.fromiter(map(known.get, kinds, itertools.repeat(-1)), np.int32, len(kinds))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = len(self.keys) + np.arange(len(new))
            self.learn([kinds[k] for k in new.tolist()])
        # each text's words, and its end
        n = sizes + 1
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        word = np.zeros(len(doc), np.int32)
        inside = np.ones(len(doc), bool)
        inside[np.cumsum(n) - 1] = False
        if len(words):
            word[inside] = number[coded.indices.to_numpy()]
        base, own = self.base[word], self.own[word]
        rare = np.isnan(base)
        base[rare], own[rare] = 0, -self.mass[word[rare]]
        total = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        # rare words by document
        kinds, times = np.unique(doc[rare].astype(np.int64) * len(self.keys) + word[rare], return_counts=True)
        owner, kinds = kinds // len(self.keys), kinds % len(self.keys)
        real = kinds > 0  # an end without training texts has no count to look up
        owner, kinds, times = owner[real], kinds[real], times[real]
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        rare_words = pa.StructArray.from_arrays(
            [pa.array([self.keys[k] for k in kinds.tolist()], pa.binary()), pa.array(times.astype(np.int32)), pa.array((self.spelled + self.mass)[kinds])], ["w", "m", "s"],
        )
        # all ids in a row
        size = np.diff(self.first)[word]
        upto = np.cumsum(size, dtype=np.int32)
        place = np.repeat(self.first[word] - (upto - size), size)
        place += np.arange(len(place), dtype=np.int32)
        score = total(own) + self.classes(self.packs[place], np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64))
        return {
            "n": pa.array(n.astype(np.int64)), "known": pa.array(total(~rare).astype(np.int64)), "base": pa.array(total(base)), "score": pa.array(score),
            "rare": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), rare_words),
        }

    def classes(self, packed: np.ndarray, sizes: np.ndarray, batch: int = 64) -> np.ndarray:
        """log10 probability of the classes of each run's words (runs in a row, of these sizes of
        ids), each scored once in overlapping windows: those with as many targets together."""
        flat, start, run = cut(packed, sizes, OVERLAP + 1, OVERLAP)
        given, target = flat >> 8, flat & 255
        targets = np.flatnonzero(target != NONE)
        first = np.searchsorted(targets, start + OVERLAP + 1)
        n = np.searchsorted(targets, start + WINDOW + 1) - first
        order = np.argsort(n.astype(np.int16), kind="stable")
        edge = np.searchsorted(n[order], np.arange(WINDOW + 1)).tolist()
        total = np.zeros(len(start))
        span = np.arange(WINDOW)[None, :]
        for k in range(1, WINDOW - OVERLAP + 1):
            for at in range(edge[k], edge[k + 1], batch):
                w = order[at : min(at + batch, edge[k + 1])]
                begin = start[w][:, None]
                place = targets[first[w][:, None] + span[:, :k]]
                got = self.tables.scores(given[begin + span], place - 1 - begin, target[place])
                # as whole numbers, so that sums don't depend on where in a slice a text stands
                total[w] = np.rint(got.astype(float) * (1 << 26)).sum(1)
        return np.bincount(run, weights=total, minlength=len(sizes)) / (1 << 26) / math.log(10)


_SCORERS: list[tuple[Model, Scorer]] = []


def _scorer(model: Model, sub: Subwords) -> Scorer:
    for known, s in _SCORERS:
        if known is model:
            return s
    _SCORERS[:] = [(model, Scorer(model, sub))]
    return _SCORERS[0][1]


def score(docs: DataFrame, model: Model, counts: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The base is the unigram log10 probability with one added to each count.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    with open(vocabulary_path, "rb") as f:
        vocabulary = sc.broadcast(f.read())
    sent = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        s = _scorer(sent.value, _subwords(vocabulary.value))
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SCORE_SLICE):
                got = s.texts(texts)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(at, len(texts)), **got})
                at += len(texts)
        pa.default_memory_pool().release_unused()  # the worker stays, with its scorer

    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    part = src.mapInArrow(run, f"id {kind}, n bigint, known bigint, base double, score double, rare array<struct<w:binary,m:int,s:double>>")
    with small_batches(docs.sparkSession):
        part = settle(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = part.where("rare is not null").select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("key"), F.col("x.m").alias("m"), F.col("x.s").alias("s"))
    held = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(b" "))).select("key", "c")
    c = F.coalesce(F.col("c"), F.lit(0))
    taken = F.when(c == 1, model.taken[0]).when(c == 2, model.taken[1]).otherwise(model.taken[2])
    # log10 P(word | class) times the class's tokens, which the score has already
    word = F.when(c > 0, F.log10(c - taken + F.pow(F.lit(10.0), F.col("s")))).otherwise(F.col("s"))
    # terms as whole numbers of 2 ** -32, added up exactly: the order in which rows come makes no difference
    total = lambda x: F.sum(F.round(F.col("m") * x * float(1 << 32)).cast("long")) / float(1 << 32)
    more = rare.join(held, "key", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known"), total(F.log10(c + 1)).alias("more_base"), total(word).alias("more_score")
    )
    floor = math.log10(model.train_tokens + model.distinct + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.join(more, "row", "left").select(
        "id", F.col("n").alias("n_tokens"), (F.col("known") + zero("more_known")).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n") * F.lit(floor)).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )
