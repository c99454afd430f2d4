"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs no regex.  A slice of texts is one array of code points; a table
gives each its class, and an automaton over the classes is run by an associative scan:
each symbol is a transition function, functions are composed pairwise over growing spans
(1, 2, 4, ...) until every composed function is constant, which gives all states at once.
A boundary is then a lookup in (state, symbol).  The automaton stands for the split
pattern of the rank files: contractions, letters, digits, other signs, each with one
space before it, and white space.

The slices between boundaries go through a cache of merged pieces; a piece not in the
cache is merged pair by pair, lowest rank first.  Byte offsets of the pieces stay, so ids
can be traced to their places and decoded.

Null is the empty text and has no ids.  Texts are encoded whole: slices bound what is held
at once but for a single longer text, and long pieces are merged in n log n steps.  Of pairs
of equal rank the leftmost is merged first.  Repeated rows get the same ids each; an empty table
gives no rows.  Other columns stay, but for one that has the name of the result, which is
replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import text_udf

#: A worker's cache of pieces is emptied when it holds so many.
CACHE_PIECES = 300_000

# Classes of code points.
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE, _QUOTE = range(6)
# Symbols: a class with what follows it.  WIDE: white space that isn't the last before
# another sign; SPACE and THIN: the last one; TAIL1, TAIL2: an apostrophe before a
# contraction of one or two letters; STOP: between texts.
L, N, O, WIDE, SPACE, THIN, TAIL1, TAIL2, STOP = range(9)
# States after a symbol.  PAD: a space that the next piece takes; LEFT2, LEFT1: letters of
# a contraction to come; DONE: the next symbol begins a piece.
IN_L, IN_N, IN_O, IN_WIDE, PAD, LEFT2, LEFT1, DONE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at the symbol)"""
    if symbol == L:
        if state == LEFT2:
            return LEFT1, False
        if state == LEFT1:
            return DONE, False
        return IN_L, state not in (IN_L, PAD)
    if symbol == N:
        return IN_N, state not in (IN_N, PAD)
    if symbol == O:
        return IN_O, state not in (IN_O, PAD)
    if symbol in (TAIL1, TAIL2):
        if state in (IN_O, PAD):
            return IN_O, False
        return (LEFT1 if symbol == TAIL1 else LEFT2), True
    if symbol == WIDE:
        return IN_WIDE, state != IN_WIDE
    return (PAD if symbol == SPACE else DONE), True


@cache
def _monoid() -> tuple[np.ndarray, ...]:
    """The functions that symbols generate: id of each symbol, table of compositions
    (first, then), image of each function or -1 if it isn't constant, image at the start
    state DONE, and the boundary table by (state, symbol)."""
    base = [tuple(_step(s, a)[0] for s in range(8)) for a in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(base))}
    grow = list(known)
    while grow:
        f = grow.pop()
        for g in list(known):
            for first, then in ((f, g), (g, f)):
                h = tuple(then[x] for x in first)
                if h not in known:
                    known[h] = len(known)
                    grow.append(h)
    funcs = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint8)
    const = np.array([f[0] if len(set(f)) == 1 else -1 for f in funcs], np.int8)
    at_start = np.array([f[DONE] for f in funcs], np.int8)
    begins = np.array([[_step(s, a)[1] for a in range(9)] for s in range(8)], bool)
    return np.array([known[f] for f in base], np.uint8), table, const, at_start, begins


@cache
def _classes() -> np.ndarray:
    # The classes are read off the library whose results are to be matched, with one-byte
    # ranks and a pattern of one class: its Unicode version may differ from Python's.
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    every = np.concatenate((np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1))).astype("<u4")
    bytewise = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytewise, special_tokens={})
        found = bytes(only.encode_ordinary(every.tobytes().decode("utf-32-le"))).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    # The pattern's \\s: white space by Unicode's property of that name.
    for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo : hi + 1] = _BLANK
    table[32], table[39] = _SPACE, _QUOTE
    return table


#: Letters of contractions after an apostrophe: fixed values.
_ONE = np.zeros(128, bool)
_ONE[[ord(c) for c in "stmd"]] = True
_TWO = ("re", "ve", "ll")


def boundaries(cp: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where pieces begin, among code points ``cp`` in which the places ``stops`` lie between texts."""
    first, compose, const, at_start, begins = _monoid()
    kind = _classes()[cp]
    symbol = np.array([L, N, O, WIDE, WIDE, O], np.uint8)[kind]
    blank = (kind == _BLANK) | (kind == _SPACE)
    blank[stops] = True
    ahead = np.append(~blank[1:], False)  # the next sign belongs to the text and isn't white space
    symbol[ahead & (kind == _SPACE)] = SPACE
    symbol[ahead & (kind == _BLANK)] = THIN
    quote = np.flatnonzero(kind == _QUOTE)
    if len(quote):
        ext = np.append(cp, [0, 0]).astype(np.uint32)
        a, b = ext[quote + 1], ext[quote + 2]
        symbol[quote[_ONE[np.minimum(a, 127)] & (a < 128)]] = TAIL1
        two = np.zeros(len(quote), bool)
        for x, y in _TWO:
            two |= (a == ord(x)) & (b == ord(y))
        symbol[quote[two]] = TAIL2
    symbol[stops] = STOP
    f, span = first[symbol], 1
    while True:
        loose = np.flatnonzero(const[f] < 0)
        loose = loose[loose >= span]
        if not len(loose):
            break
        f[loose] = compose[f[loose - span], f[loose]]
        span *= 2
    # What is still not constant reaches back to the start, where the state is DONE.
    state = at_start[f]
    return begins[np.append(np.int8(DONE), state[:-1]), symbol]


class Ranks:
    """A vocabulary of byte strings with merge ranks."""

    def __init__(self, data: bytes):
        pairs = (line.split() for line in data.splitlines() if line)
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.piece = dict.__new__(_Pieces)
        self.piece.rank = self.rank
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for k, v in self.rank.items():
            self.bytes_of[v] = k

    @classmethod
    def read(cls, path: str) -> "Ranks":
        with open(path, "rb") as f:
            return cls(f.read())

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids as little-endian 32-bit numbers, and where its pieces begin in its bytes."""
        if not texts:
            return []
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(lengths) - 1
        begin = np.flatnonzero(boundaries(cp, stops))
        raw = joined.encode("utf-8", "replace")
        if len(raw) == len(cp):
            at, stop_at = begin, stops
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            width[(cp >= 0xD800) & (cp < 0xE000)] = 1  # a lone surrogate is written as "?"
            place = np.cumsum(width) - width
            at, stop_at = place[begin], place[stops]
        bounds, piece = at.tolist(), self.piece
        if len(piece) > CACHE_PIECES:
            piece.clear()
        ids = [piece[raw[a:b]] for a, b in zip(bounds, bounds[1:] + [len(raw)])]
        cut = np.searchsorted(at, stop_at).tolist()  # the stop's own piece, which isn't kept
        out, start, origin = [], 0, 0
        for end, place in zip(cut, stop_at.tolist()):
            out.append((b"".join(ids[start:end]), at[start:end] - origin))
            start, origin = end + 1, place + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Pieces(dict):
    """Pieces' ids, packed; what is missing is merged."""

    rank: dict[bytes, int]

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.rank
        if piece in rank:
            ids = struct.pack("<I", rank[piece])
        elif len(piece) > 200:
            ids = _merge_long(piece, rank)
        else:
            ids = _merge(piece, rank)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _merge(piece: bytes, rank: dict[bytes, int]) -> bytes:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(rank) + (1 << 30)
    pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i:
            pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = rank.get(parts[i] + parts[i + 1], none)
    return struct.pack(f"<{len(parts)}I", *[rank[p] for p in parts])


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> bytes:
    """The same result in n log n steps: a heap of pairs over a linked list."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here
    before, live = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        live[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := rank.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return b"".join(struct.pack("<I", rank[piece[i : end[i]]]) for i in range(n) if live[i])


_RANKS: list[tuple[bytes, Ranks]] = []


def _ranks(data: bytes) -> Ranks:
    """The vocabulary of a worker, built once; the slices' caches live in it."""
    for known, ranks in _RANKS:
        if known is data or known == data:
            return ranks
    del _RANKS[1:]
    _RANKS.insert(0, (data, Ranks(data)))
    return _RANKS[0][1]


#: What ``encode`` can return for a text, with Arrow and SQL types.
FIELDS = {
    "n_tokens": (pa.int64(), "bigint"),
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "offsets": (pa.list_(pa.int32()), "array<int>"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", fields: tuple[str, ...] = ("ids", "offsets"), to: str = "bpe") -> DataFrame:
    """``docs`` with one more column ``to``, a struct of ``fields``: the ids, the offsets (where
    each piece begins in the text's bytes), their number, the digest of the ids as
    little-endian 32-bit numbers, and that of the bytes which the ids decode to.

    The rank file (under 1 MB, a fixed table) is read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel():
        ranks = _ranks(sent.value)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        make = {
            "n_tokens": lambda i, o: len(i) // 4,
            "ids": lambda i, o: np.frombuffer(i, "<i4"),
            "offsets": lambda i, o: o.astype(np.int32),
            "ids_sha256": lambda i, o: hexed(i),
            "decoded_sha256": lambda i, o: hexed(ranks.decode(i)),
        }

        def work(texts: list[str]) -> dict[str, list]:
            got = ranks.encode(texts)
            return {f: [make[f](i, o) for i, o in got] for f in fields}

        return work

    ddl = ",".join(f"{f}:{FIELDS[f][1]}" for f in fields)
    udf = text_udf(kernel, {f: FIELDS[f][0] for f in fields}, f"struct<{ddl}>")
    return docs.withColumn(to, udf(F.col(text_col)))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``tokens`` with the text of their ids in a column ``to`` (null stays null; bytes that
    aren't UTF-8 become U+FFFD)."""
    with open(ranks_path, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        ranks = _ranks(sent.value)
        return pa.array([None if x is None else ranks.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return tokens.withColumn(to, run(F.col(ids_col)))
