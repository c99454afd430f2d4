"""Mixing, phrases and prefix tries: against SQL, plain versions, and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolith.llm import mixing, phrases, prefixes, queries


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else v
    return columns, sorted(zip(*[[clean(v) for v in frame[c].tolist()] for c in columns]), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", ["op11_mixing", "op12_phrases", "op13_prefixes"])
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(c.sql(queries.SQL[name]).df())


# ---- 11


def plain_targets(size, share=1.5, repeats=2):
    """Shares by weight; what is too much for some is dealt out again, round by round."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(size.values()), list(names), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > repeats * size[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = float(repeats * size[s])
            left -= target[s]
            open_.remove(s)
    return target


MIX = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (0, "a"), (300, "b"), (7, "b"), (7, "b"), (1, "c"), (40, None), (2500, "d"), (90, "é"), (3, "Z"), (3, "Z")])]
MIX += [(None, "x y z", "a"), (None, None, "e"), (20, "p q\n r\t", "b"), (20, "p q\n r\t", "b"), (21, None, None), (22, " \x0b ", "d"), (23, "  　", "a")]


@pytest.fixture(scope="module")
def mix_docs(spark):
    return spark.createDataFrame(MIX, "doc_id long, text string, source string").withColumn("size", F.lit("own")).withColumn("place", F.lit(1)).withColumn("key", F.lit(0)).repartition(5)


@pytest.mark.parametrize("slots,block", [(1 << 14, 1 << 20), (40, 1 << 20), (40, 9)])
def test_mix(mix_docs, monkeypatch, slots, block):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "BLOCK", block)
    mix = mixing.Mix(mix_docs)
    got = mix.taken().collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, s in MIX)
    size, taken = Counter(), Counter()
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    target = plain_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.Mix(mix_docs.repartition(2)).taken().collect()))
    # the mix itself: each word of a document at most once in a pass, and in the order of slots
    each = defaultdict(list)
    for p in mix.pieces().collect():
        each[p.place, p.start, p["pass"]].append((p.first, p.first + p.words))
    assert sum(b - a for v in each.values() for a, b in v) == sum(taken.values())
    assert all(x[1] <= y[0] for v in each.values() for x, y in zip(sorted(v), sorted(v)[1:])) and {k[2] for k in each} <= {0, 1}


def test_slots_keep_close_to_shares_from_the_start(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(20 + id % 7 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    mix = mixing.Mix(docs)
    slots = mix.slots.join(mix.plan.select("place", "target"), "place").toPandas().sort_values("slot")
    share = mix.plan.toPandas().set_index("place").target
    share = share / share.sum()
    for n in (50, 500, 5000, len(slots)):
        part = slots.head(n).place.value_counts(normalize=True)
        assert all(abs(part.get(p, 0) - share[p]) < 8 / n + 0.002 for p in share.index)


def test_an_empty_mix(mix_docs, spark):
    assert mixing.Mix(mix_docs.limit(0)).taken().count() == 0
    assert [tuple(r) for r in mixing.Mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).taken().collect()] == [(1, "a", 0, 0, 0.0, 0)]


# ---- 12


def plain_phrases(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if g[i : i + k] in found and 100 * a >= 80 * found[g[i : i + k]]}
        kept = []
        for g, a in found.items():
            score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            if g not in inside:
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_docs(seed=3):
    r = np.random.default_rng(seed)
    vocabulary = ["the", "of", "new", "york", "city", "a", "ÄRA", "été", "x", "The"] + [f"w{i}" for i in range(25)]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    docs = []
    for i in range(150):
        words = [str(w) for w in r.choice(vocabulary, r.integers(0, 60), p=p / p.sum())]
        for _ in range(r.integers(0, 4)):
            words.insert(int(r.integers(0, len(words) + 1)), "new york city of" if r.random() < 0.7 else "the the the the the")
        docs.append((("en", "de", None, "und", "en")[i % 5], "".join(w + str(r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", " ", ";"])) for w in words)))
    return docs + [("en", None), ("en", ""), (None, " \t"), ("fr", "only once here"), ("en", "\x00 odd\x00 \x00"), ("de", docs[0][1])] * 2 + [("en", " of the new york" * 40_000)]


@pytest.mark.parametrize("small", [{}, {"TABLE": 4, "SALT": 30, "FRAGMENTS": 200, "SLICE": 300, "HELD": 50}, {"TABLE": 1, "BITS": 64, "SALT": 10, "FRAGMENTS": 100}])
def test_phrases(spark, monkeypatch, small):
    """Whatever is broadcast, split and sliced."""
    for k, v in small.items():
        monkeypatch.setattr(phrases, k, v)
    docs = phrase_docs()
    d = spark.createDataFrame(docs, "lang string, text string").withColumn("h", F.lit(1)).withColumn("word", F.lit("own")).repartition(3)
    for least, top in ((5, 40), (12, 10**6)):
        got = phrases.collocations(d, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == plain_phrases(docs, least, top)


def test_no_phrases(spark):
    d = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert phrases.collocations(d).count() == 0 and phrases.collocations(d.limit(0), 1).count() == 0
    assert [tuple(r)[:4] for r in phrases.collocations(d, 1).collect()] == [("en", 1, "a b c", 1)]


def test_fragments_hold_each_ngram_once():
    """Each n-gram occurrence lies in one fragment of its rarest word, around the first place of that word."""
    r = np.random.default_rng(5)
    code = r.integers(0, 6, 400).astype(np.uint64)
    code[r.random(400) < 0.1] = phrases._NONE
    piece = np.cumsum(r.random(400) < 0.1)
    at, left, right = phrases.fragments(code, piece)
    got = Counter((p - s, n) for p, a, b in zip(at, left, right) for n in range(2, 5) for s in range(n) if s <= a and n - 1 - s <= b)
    want = Counter((i, n) for n in range(2, 5) for i in range(400 - n + 1) if piece[i] == piece[i + n - 1] and (code[i : i + n] != phrases._NONE).all())
    assert got == want


# ---- 13


def plain_trie(turns):
    whole = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            whole[c].append(((t is not None, t or 0), role or "", text or ""))
    whole = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in whole.items()}
    members = defaultdict(list)
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = whole.get(c - int(np.fmod(c, 5)), [])
        s = tuple(own if np.fmod(c, 5) == 0 else base[:h] + own[h:])
        for d in range(len(s) + 1):
            members[s[:d]].append((c, len(s) == d))
    out = []
    for s, who in members.items():
        under = [k for k in members if k[: len(s)] == s]
        own = lambda k: (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaf = lambda k: not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members)
        ends = ",".join(str(c) for c in sorted(c for c, e in who if e))
        out.append((min(c for c, _ in who), len(s), min(c for c, _ in members[s[:-1]]) if s else None, len(who), sum(len(k) == len(s) + 1 for k in under), sum(map(leaf, under)), sum(map(own, under)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(seed=2):
    r = np.random.default_rng(seed)
    texts = ["hi", "", None, "naïve é", "ok", "long " * 30]
    out = []
    for c in [*range(-7, 60), 1000, 10**12 + 3]:
        n = int(r.integers(1, 14))
        common = [("user", "hi")] * int(r.integers(0, 6)) if c % 3 else []
        for t in range(n):
            role, text = common[t] if t < len(common) else (("user", None, "assistant")[r.integers(0, 3)], texts[r.integers(0, len(texts))])
            out.append((c, None if t == 0 and c % 4 == 0 else t, role, text))
    # many equal ones, turns that lie far apart, rows of no conversation
    out += [(c, t, "user", "same") for c in range(100, 130) for t in range(12)] + [(200, 5, "user", "b"), (200, -5, "user", "a"), (None, 1, "user", "x"), (None, None, None, None)]
    return out


@pytest.mark.parametrize("turns", [1 << 16, 60, 3])
def test_trie(spark, monkeypatch, turns):
    """Whatever a task may finish: large buckets, chains of common turns, conversations that end inside them."""
    monkeypatch.setattr(prefixes, "TURNS", turns)
    data = chats()
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("own")).withColumn("path", F.lit(1)).repartition(4)
    got = prefixes.trie(prefixes.sequences(prefixes.rebuilt(prefixes.encoded(d))))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(data)


def test_no_trie(spark):
    d = spark.createDataFrame([(None, 1, "user", "x"), (3, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    make = lambda x: sorted(map(tuple, prefixes.trie(prefixes.sequences(prefixes.rebuilt(prefixes.encoded(x)))).collect()))
    assert make(d.limit(0)) == [] and make(d.where("conv_id is null")) == []
    # no base, and fewer turns of its own than the head: a conversation without turns
    assert zlib.crc32(b"3") % 9 > 0 and make(d) == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_very_long_conversations(spark):
    d = spark.range(60_000).select((F.col("id") % 2 * 5).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text"))
    got = prefixes.trie(prefixes.sequences(prefixes.rebuilt(prefixes.encoded(d))))
    assert got.agg(F.count("*"), F.max("depth"), F.sum("n_convs")).first() == (60_001, 30_000, 60_002)
