"""Near-duplicates, decontamination, repeats, toxicity, language model, surrogates, pipeline: against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tests.conftest import SF
from pyspark.sql import functions as F

from aeolith.llm import decontaminate, lm, pii, repeats, simhash, toxicity
from aeolith.llm.queries import QUERIES

from .conftest import crc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


# ---- 9


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    """rows: (id, fingerprint) -> component of each row, by all pairs."""
    least = {}
    for i, f in rows:
        least.setdefault(f, []).append(i)
    points, root = list(least), {}
    for p in points:
        root[p] = p

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in range(len(points)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= radius:
                root[find(points[a])] = find(points[b])
    groups = defaultdict(list)
    for p in points:
        groups[find(p)] += [i for i in least[p] if i is not None]
    return [(i, f, min(groups[find(f)], default=None)) for i, f in rows]


@pytest.mark.parametrize("source", ["tricky", "documents"])
def test_near_duplicates(request, source):
    docs = request.getfixturevalue(source)
    got = sorted((str(r.id), r.fp & (1 << 64) - 1, str(r.component)) for r in simhash.near_duplicates(docs).collect())
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()])
    assert got == sorted((str(i), f, str(c)) for i, f, c in want)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("cell_max", [1, 3, 64])
def test_links_in_large_cells(spark, cell_max):
    """Chains, hubs and pairs: however small the limit on cells, no component is lost."""
    r = np.random.default_rng(7)
    points = set()
    for _ in range(6):
        centre = int(r.integers(0, 1 << 62)) << 2
        points |= {centre ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for k in (0, 1, 1, 1, 2, 2, 3, 4) for _ in range(3)}
        chain = centre ^ (1 << 63)
        for b in range(0, 30, 2):
            chain ^= 3 << b
            points.add(chain)
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, cell_max)).collect()}
    want = {f: c for _, f, c in plain_components([(signed(p), p) for p in points])}
    for p in points:
        assert roots.get(signed(p), signed(p)) == want[p]


def test_embedding_bounds_the_distance(spark):
    r = np.random.default_rng(8)
    rows = [(signed(int(a)), signed(int(b))) for a, b in r.integers(0, 1 << 63, (50, 2))]
    d = spark.createDataFrame(rows, "a long, b long")
    for x in d.select("a", "b", F.bit_count(simhash.unary_code(F.col("a")).bitwiseXOR(simhash.unary_code(F.col("b")))).alias("m")).collect():
        a, b = x.a & (1 << 64) - 1, x.b & (1 << 64) - 1
        manhattan = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert x.m == manhattan <= (a ^ b).bit_count()


def test_one_of_each(documents, tricky, none):
    kept = simhash.one_of_each(documents)
    near = simhash.near_duplicates(documents).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component for r in near}) and kept.columns == documents.columns
    odd = simhash.one_of_each(tricky)
    assert odd.columns == tricky.columns
    classes = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in tricky.collect()])
    fps = plain_components([(f, f) for _, f, _ in classes])
    assert odd.count() == len({c for _, _, c in fps})
    assert simhash.one_of_each(none).count() == 0


# ---- 10


def plain_contamination(docs, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = defaultdict(set)
    for key, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams[tuple(w[i : i + n])].add(key)
    sizes = {len(g) for g in grams}
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if who := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= who
        yield key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 700])
def test_contamination(spark, documents, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Of, THE"), (901, None), (902, "..."), (903, "the"), (903, "queue é"), (None, "a b c"), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.decontaminate(documents, bench, block_windows=block).collect()}
    named = [("null" if k is None else str(k), t) for k, t in items]
    n_hit = 0
    for key, n, hit, found, bad in plain_contamination([(r.doc_id, r.text) for r in documents.collect()], named):
        c = got[key]
        assert (c["n_words"], c.n_hit, c["items"], c.contaminated) == (n, hit, found, bad)
        assert c.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        n_hit += hit > 0
    assert n_hit


def test_fifty_blocks_and_an_item_larger_than_one(spark):
    r = np.random.default_rng(10)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(2, 6)))
    long = [word() for _ in range(3000)]  # thirty blocks by itself
    items = [("long", " ".join(long)), ("null", "one two three"), (None, "one two three")] + [(f"i{k}", " ".join(word() for _ in range(30))) for k in range(120)]
    docs = [(k, " ".join([word(), *long[40 * k : 40 * k + 60], word()])) for k in range(40)] + [(100 + k, f"x {items[k + 3][1]} y") for k in range(50)] + [(200, None), (201, ""), (202, "say one two three"), (7, "say one two three")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.windows_of(b, "item_id", "text", 13).count() > 50 * 100
    of = lambda x: sorted((r.doc_id, r.contamination.n_words, tuple(r.contamination["items"]), tuple(map(tuple, r.contamination.hits)), r.contamination.contaminated) for r in x.collect())
    many, one = of(decontaminate.decontaminate(d, b, block_windows=100)), of(decontaminate.decontaminate(d, b))
    assert many == one and len(one) == len(docs)
    found = {x[0]: x for x in one}
    assert found[3][2:4] == (("long",), ((1, 61),)) and found[120][2] == ("i20",) and found[202][2] == ("null", "null") and found[200][1:] == found[201][1:] == (0, (), (), False)


def test_removal(spark, tricky, none):
    bench = spark.createDataFrame([(1, "three FOUR five")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(tricky.where("doc_id = 11"), bench).collect()}
    assert got == {11: "one two  six seven eight"}
    assert decontaminate.drop_documents(tricky, bench).count() == tricky.count() - 3
    assert decontaminate.drop_documents(none, bench).count() == 0
    assert decontaminate.drop_documents(tricky, bench.where("item_id > 5")).count() == tricky.count()


# ---- 5


def test_rolling_hash_is_the_gear_hash():
    w = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    h, want = 0, []
    for x in w.tolist():
        h = ((h << 16) + x) & (1 << 64) - 1
        y = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        want.append(y ^ y >> 30)
    assert repeats.gear(w).tolist() == want


def test_cuts_follow_the_content():
    r = np.random.default_rng(2)
    words = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(1, 9))) for _ in range(2000)]
    keys = lambda text: set(repeats.stretches([text])[5].tolist())
    whole = keys(" ".join(words))
    # an insertion changes the chunks around it only
    assert len(whole & keys(" ".join(["some", "words", "before", *words]))) >= len(whole) - 3
    assert len(whole & keys(" ".join([*words[:1000], "inserted", *words[1000:]]))) >= len(whole) - 12
    # any 51 words hold the whole first chunk of theirs
    text, pos, n, start, stop, h, d = repeats.stretches([" ".join(words)])
    assert n.sum() == 2000 - 50 and (np.diff(pos) == n[:-1]).all() and n.max() <= 27
    # texts in one call don't touch each other
    alone = repeats.stretches([" ".join(words)])
    among = repeats.stretches(["", "x " * 60, " ".join(words), "tail"])
    own = among[0] == 2
    assert all((x[own] == y).all() for x, y in zip(among[1:], alone[1:]))


def plain_windows(rows, within):
    """(id, first word) of each window of 51 words that occurs before, by the bytes between them."""
    first, out = {}, set()
    cut = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for i, t in rows}
    for i, t in sorted(rows):
        raw, w = t.encode(), cut[i]
        for k in range(len(w) - 50):
            x = raw[w[k][0] : w[k + 50][1]]
            if x not in first:
                first[x] = i
            elif within or first[x] != i:
                out.add((i, k))
    return out, cut


@pytest.mark.parametrize("within", [True, False])
def test_every_repeated_window_is_covered(documents, within):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    want, cut = plain_windows(rows, within)
    got = repeats.repeats(documents, within=within).collect()
    text, found = dict(rows), set()
    for r in got:
        begins = [a for a, _ in cut[r.id]]
        k = begins.index(r.start)
        assert cut[r.id][k + r.words - 1][1] == r.stop and r.words >= repeats.SPAN_WORDS
        found |= {(r.id, j) for j in range(k, k + r.words - 50)}
        assert all(i < r.id or within and i == r.id for i in r.first_ids)
        assert len(r.first_ids) > 1 or text[r.id].encode()[r.start : r.stop] in text[r.first_ids[0]].encode()
    assert want and found == want


def test_repeats_within_one_document(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(2, 8)))
    passage = " ".join(word() for _ in range(120))
    text = f"{passage} and then {passage} or {passage} end"
    d = spark.createDataFrame([(1, text), (2, f"say {passage} again"), (3, f"one {passage} two {passage}")], "doc_id long, text string")
    got = sorted((x.id, text_[x.start : x.stop], x.words, tuple(x.first_ids)) for text_map in [{k.doc_id: k.text for k in d.collect()}] for x in repeats.repeats(d).collect() for text_ in [text_map[x.id]])
    assert got == [(1, passage, 120, (1,))] * 2 + [(2, passage, 120, (1,))] + [(3, passage, 120, (1,))] * 2
    assert sorted(x.id for x in repeats.repeats(d, within=False).collect()) == [2, 3, 3]
    assert repeats.remove_repeats(d.where("doc_id = 1")).collect()[0].text == f"{passage} and then  or  end"


def test_hot_chunks(spark, monkeypatch):
    """With commonest digests broadcast, and without, spans are the same."""
    from aeolith.llm import common

    r = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(2, 8)))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(int(r.integers(0, 40)))) + " " + passage + (" tail" if i % 3 else "")) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sorted_ = lambda x: sorted(map(tuple, x.collect()), key=str)
    want = sorted_(repeats.repeats(d))
    assert len(want) == 59 and all(w[3] >= 90 for w in want)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted_(repeats.repeats(d)) == want
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    assert sorted_(repeats.repeats(d)) == want


def test_no_repeat_of_51_words_is_lost(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(1, 8)))
    words = lambda n: [word() for _ in range(n)]
    texts, wanted = {}, {}
    for k in range(250):
        n = int(r.choice([50, 51, 52, 60, 120]))
        passage, lead = words(n), int(r.integers(1, 40))
        # words that differ stand at both edges
        texts[3 * k] = [*words(int(r.integers(1, 40))), "0", *passage, "0", *words(30)]
        texts[3 * k + 1] = [*words(lead - 1), "1", *passage, "1", *words(int(r.integers(1, 40)))]
        # a part of the passage that is too short in a document before them doesn't hide it
        texts[-k - 1] = [*words(20), *passage[10:45], *words(20)]
        if n > 50:
            wanted[3 * k + 1] = (" ".join(texts[3 * k + 1][:lead]) + " ", " ".join(passage), n)
    texts = {i: " ".join(w) for i, w in texts.items()}
    got = repeats.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r.id for r in got} == set(wanted) and len(got) == len(wanted)
    for r_ in got:
        before, passage, n = wanted[r_.id]
        # exact to the word
        assert (r_.start, texts[r_.id][r_.start : r_.stop], r_.words, r_.first_ids) == (len(before), passage, n, [r_.id - 1])


def test_removing_repeats(spark, tricky, none):
    r = np.random.default_rng(3)
    passage = " ".join("".join(chr(97 + int(c)) for c in r.integers(0, 26, 6)) for _ in range(80))
    d = spark.createDataFrame([(1, "start here " + passage), (2, "another way to begin " + passage + " and an end"), (3, "short and clean")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in repeats.remove_repeats(d).collect()}
    assert got[1] == "start here " + passage and got[3] == "short and clean"
    assert got[2].startswith("another way to begin") and got[2].endswith("an end") and len(got[2]) < 200
    assert repeats.repeats(none).count() == 0 and repeats.remove_repeats(none).count() == 0
    assert repeats.remove_repeats(tricky.where("doc_id is not null")).count() == tricky.count() - 1


# ---- 3


def test_grammar():
    m = toxicity.Matcher(toxicity.Model(whole={"idiot": 4.0}, stems={"grob": 3.0}))
    score = lambda t: sum(c[2] for c in m.clauses(t))
    assert score("idiot") == 4 and score("You idiot") == 6 and score("not an idiot") == pytest.approx(1.2) and score("he said idiot") == pytest.approx(3.0)
    assert score("grobian.") == 3 and score("grob") == 0 and score("idiotic") == 0 and score("no. idiot") == 4
    assert score("kill") == pytest.approx(0.2) and score("I kill you. you beat") == pytest.approx(1.2)
    assert score("idiot. idiot") == pytest.approx(4.4) and m.clauses("") == []


def plain_clause_scores(model, text):
    """The grammar word by word, with its states as variables."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    out, seen = [], set()
    for clause in re.finditer(r"[^.!?;\n]+", low):
        negated, reported, targeted, score, matched = 0, False, False, 0.0, False
        for m in re.finditer(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause[0]):
            w = m[0]
            first = re.match(r"[^\W\d_]+", w)[0]
            hits = [(model.whole.get(first, 1.0), "threat")] if first in toxicity._THREATS else []
            if first in model.whole and first not in toxicity._THREATS:
                hits.append((model.whole[first], "insult"))
            hits += [(x, "insult") for s, x in model.stems.items() if first.startswith(s) and len(first) > len(s)]
            weight, kind = max(hits, default=(0.0, None))
            if kind:
                factor = 1.0
                if negated:
                    factor *= toxicity.FADED
                if reported:
                    factor *= toxicity.REPORTED
                if kind == "threat" and not targeted:
                    factor *= toxicity.IDLE_THREAT
                if kind == "insult" and targeted:
                    factor *= toxicity.TARGETED
                score += weight * factor * (toxicity.REPEATED if w in seen else 1.0)
                seen.add(w)
                matched = True
            negated = max(0, negated - 1)
            if not kind and w in toxicity._NEGATIONS:
                negated = toxicity.NEGATION_REACH
            elif not kind and w in toxicity._REPORTS:
                reported = True
            elif not kind and w in toxicity._TARGETS:
                targeted = True
        if matched:
            out.append((clause.start(), clause.end(), score))
    return out


def test_grammar_by_hand(documents):
    r = np.random.default_rng(12)
    model = toxicity.Model(whole={"idiot": 4.0, "kill": 2.5}, stems={"grob": 3.0, "idio": 1.0})
    m = toxicity.Matcher(model)
    vocabulary = ["idiot", "Idiotic", "grobian", "grob", "kill", "beat", "you", "not", "said", "the", "don't", "İx", "word.", "end!", "a;", "b\n", "1", "he's"]
    texts = [" ".join(r.choice(vocabulary, r.integers(0, 40))) for _ in range(400)] + [x.text for x in documents.limit(50).collect() if x.text]
    n = 0
    for t in texts:
        got, want = [(a, b, c) for a, b, c, _ in m.clauses(t)], plain_clause_scores(model, t)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], t
        assert [c for *_, c in got] == pytest.approx([c for *_, c in want]), t
        n += len(want)
    assert n > 400


def test_long_texts_are_scored_in_one_pass():
    import time

    m = toxicity.Matcher(toxicity.Model(whole={"idiot": 4.0}))
    began = time.time()
    assert len(m.clauses("you idiot, " + "well idiot and so. " * 60_000)) == 60_000
    assert time.time() - began < 20


def test_composition_multiplies():
    g = toxicity.grammar()
    assert g.states == 4 * 2 * 2
    s, f = g.step(0, toxicity.NEGATION)
    s, f = g.step(s, toxicity.REPORT)
    assert g.step(s, toxicity.INSULT)[1] == pytest.approx(toxicity.FADED * toxicity.REPORTED)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, d).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert all((crc(i) % 5 == 0) for i in got.doc_id) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    en = got[got.lang == "en"]
    assert (en.predicted == en.toxic).mean() > 0.98
    a, b = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()
    assert auc > 0.94 and (got.predicted == got.toxic).mean() > 0.95


def test_toxicity_without_labels(spark, tricky, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(tricky, empty, lambda k: F.lit(True))
    got = toxicity.score(tricky, model).collect()
    assert len(got) == tricky.count() and all(0 <= r.toxicity.score < 0.5 for r in got)
    some = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 1), (4, 0), (11, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(tricky, some, lambda k: F.lit(True))
    assert all(0 <= r.toxicity.score <= 1 for r in toxicity.score(tricky, model).collect())
    assert toxicity.score(none, model).count() == 0


# ---- 6


def test_base_scores_and_counts(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op6_lm"](spark, SF).collect()}
    docs = {r.doc_id: words(r.text) for r in documents.collect()}
    train = {i: w for i, w in docs.items() if crc(i) % 7 != 2}
    c = Counter(x for w in train.values() for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    p = lambda k: math.log10((k + 1) / (n + v + 1))
    for i, w in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w) + 1, 1 + sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(p(c[x]) for x in w) + p(len(train)), rel=1e-9)
    assert len(got) == len(docs) and all(r.score < 0 for r in got.values())


def test_scores_beat_the_base_on_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op6_lm"](spark, d).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    # by 0.05 of a log10 at least in each token
    assert got.score / got.n > got.base / got.n + 0.05


@pytest.fixture(scope="module")
def fitted(spark, documents):
    model, counts = lm.train(documents.where("doc_id % 3 <> 0"), RANKS)
    return model, counts, {r.word: r.c for r in counts.collect()}


def plain_word(model, sub, counts, w):
    """log10 P(word | class), from the counts of all words."""
    ids = sub.ids(w)
    cls = model.classes[ids[0]]
    spelled = model.lead[ids[0]]
    for a, b in zip(ids, [*ids[1:], sub.size]):
        spelled += float(model.follow[model.kinds[a], b])
    c = counts.get(w, 0)
    taken = 0 if not c else model.taken[min(c, 3) - 1]
    return (math.log10((c - taken) / model.mass[cls] + 10**spelled) if c else spelled), ids, int(cls)


def plain_class(net, given, target):
    """Natural log P(target | inputs), attention written out for one place: ``given`` are the window's inputs so far."""
    x, d = net.embed.astype(float), lm.DIM
    q, k, v = (x @ net.qkv[:, i * d : (i + 1) * d] for i in range(3))
    w = np.exp(k[given] @ q[given[-1]] / math.sqrt(d) + net.bias[np.arange(len(given))[::-1]])
    z = np.concatenate((w @ v[given] / w.sum(), x[given[-1]])) @ net.out + net.last[given[-1]] + net.base
    return z[target] - math.log(np.exp(z).sum())


def plain_score(model, sub, counts, text):
    ws = [w.encode() for w in words(text)]
    total, inputs, targets = 0.0, [], []
    for w in ws:
        own, ids, cls = plain_word(model, sub, counts, w)
        total += own
        targets.append((len(inputs), cls))
        inputs += [int(model.packs[i]) >> 8 for i in ids]
    targets.append((len(inputs), lm.END))
    before = [0] * (lm.OVERLAP + 1) + inputs
    step = lm.WINDOW - lm.OVERLAP
    for i, cls in targets:
        total += plain_class(model.net, np.array(before[i // step * step : i + lm.OVERLAP + 1]), cls) / math.log(10)
    return total


def test_scores_by_hand(fitted, documents, tricky):
    """The whole score of twenty texts and of the odd ones, word by word and place by place."""
    model, counts, held = fitted
    sub = lm.Subwords(open(RANKS, "rb").read())
    for docs in (documents.where("doc_id < 20"), tricky):
        for r in lm.score(docs.withColumn("score", F.lit("own")), model, counts, RANKS).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect():
            want = plain_score(model, sub, held, r.text)
            assert r.score == pytest.approx(want, rel=1e-4, abs=1e-3), r.id


def test_words_of_a_class_share_it(fitted):
    """A class's known words and what is left for others make one."""
    model, _, held = fitted
    sub = lm.Subwords(open(RANKS, "rb").read())
    known = [w for w in held if w != b" "]
    ids, first = sub.bulk(known)
    cls = model.classes[ids[first[:-1]]]
    c = np.array([held[w] for w in known], float)
    kept = (c - np.array([0, *model.taken])[np.minimum(c, 3).astype(int)]) / model.mass[cls]
    left = np.bincount(model.classes[sub.begins], weights=10 ** model.lead[sub.begins], minlength=lm.CLASSES)
    some = np.bincount(cls, minlength=lm.CLASSES) > 0
    assert np.allclose((np.bincount(cls, weights=kept, minlength=lm.CLASSES) + left)[some], 1)
    assert np.allclose((10.0 ** model.follow.astype(float)).sum(1), 1, atol=1e-3)


def random_net(seed):
    r = np.random.default_rng(seed)
    n = lm.start_net(r.standard_normal((lm.INPUTS, lm.CLASSES)) * 0.3)
    return n._replace(bias=(r.standard_normal(lm.WINDOW) * 0.3).astype(np.float32), out=(r.standard_normal(n.out.shape) * 0.3).astype(np.float32))


def test_windows_score_each_word_once():
    """Against attention written out place by place."""
    net, r = random_net(1), np.random.default_rng(2)
    s = lm.Scorer.__new__(lm.Scorer)
    s.tables = lm.Tables(net)
    step = lm.WINDOW - lm.OVERLAP
    runs = []
    for n in (1, 5, step, step + 1, 3 * step + 7):
        targets = np.where(r.random(n) < 0.5, lm.NONE, r.integers(0, lm.CLASSES, n))
        runs.append((r.integers(0, lm.INPUTS, n), targets))
    got = s.classes(np.concatenate([a * 256 + b for a, b in runs]), np.array([len(a) for a, _ in runs]))
    for (a, b), have in zip(runs, got):
        before = [0] * (lm.OVERLAP + 1) + a.tolist()
        want = sum(plain_class(net, np.array(before[i // step * step : i + lm.OVERLAP + 1]), b[i]) for i in range(len(a)) if b[i] != lm.NONE)
        assert have == pytest.approx(want / math.log(10), rel=1e-4)


def test_training_windows_hold_each_target_once():
    import pyarrow as pa

    r = np.random.default_rng(6)
    packs = np.append(np.arange(500) * 256 + np.where(np.arange(500) % 2, lm.NONE, np.arange(500) % lm.CLASSES), lm.END)
    rows = [[-1, -1], [2, 4, 6], [-1, *r.integers(0, 500, 100).tolist()], r.integers(0, 500, 77).tolist() + [-1], [-1, *r.integers(0, 500, 24).tolist(), -1]]
    given, target, weight = lm.as_windows(pa.array(rows, pa.list_(pa.int32())), packs, np.arange(1.0, 6.0))
    for k, row in enumerate(rows):
        mine = weight == k + 1
        at_start = row[0] == -1
        want = [int(packs[i]) & 255 for i in row[1:]]  # what stands first has nothing before it
        seen = target[mine][target[mine] != lm.NONE].tolist()
        assert seen == [x for x in want if x != lm.NONE]
        assert given.shape[1] == lm.WINDOW and (given[mine][0, 0] == 0) == at_start


def test_gradients():
    r = np.random.default_rng(3)
    net = lm.Net(*[a.astype(float) for a in random_net(4)])
    c, t = r.integers(0, 40, (3, lm.WINDOW)), r.integers(0, lm.CLASSES, (3, lm.WINDOW))
    t[r.random(t.shape) < 0.3] = lm.NONE
    weight = np.array([1.0, 2.0, 0.5])
    _, g = lm.gradients(net, c, t, weight)
    for name in net._fields:
        a, found = getattr(net, name), getattr(g, name)
        if isinstance(found, tuple):
            rows, sums = found
            found = np.zeros_like(a)
            found[rows] = sums
        i = (int(c[0, 3]), 2) if name in ("embed", "last") else tuple(int(r.integers(0, n)) for n in a.shape)
        e = np.zeros_like(a)
        e[i] = 1e-5
        up, down = (lm.gradients(net._replace(**{name: a + s * e}), c, t, weight)[0] for s in (1, -1))
        assert found[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_training_lowers_the_loss():
    r = np.random.default_rng(5)
    c = np.cumsum(np.ones((400, lm.WINDOW + 1), int), axis=1) + r.integers(0, 9, (400, 1))
    given, target, one = c[:, :-1] % 20, c[:, 1:] % 20, np.ones(400)
    net = lm.start_net()
    before, _ = lm.gradients(net, given, target, one)
    for k in range(12):
        net = lm.fit(net, given, target, one, 0.03, seed=k)
    after, _ = lm.gradients(net, given, target, one)
    assert after < 0.3 * before


def test_all_words_train(spark):
    """A change far from the stretch that ``places`` draws changes the counts of neighbours and the network."""
    r = np.random.default_rng(4)
    texts = []
    while len(texts) < 2:
        said = [f"w{i}" for i in r.integers(0, 9, 100)] if not texts else texts[0].split()
        if texts:
            i, j = r.integers(40, 100, 2)
            said[i], said[j] = said[j], said[i]
        t = " ".join(said)
        if t not in texts and lm.places(t.encode(), 100) == [0]:
            texts.append(t)
    a, b = (lm.train(spark.createDataFrame([(t,)], "text string"), RANKS)[0] for t in texts)
    assert a.head == b.head and not np.array_equal(a.net.last, b.net.last)


def test_runs_hold_all_ids(spark, tricky, monkeypatch):
    """Each word is a target once, behind the word before it, over the edges of runs too."""
    monkeypatch.setattr(lm, "RUN_WORDS", 7)
    sub = lm.Subwords(open(RANKS, "rb").read())
    texts = [r.text or "" for r in tricky.collect()] + ["", "a", " ".join(f"x{i}" for i in range(8)), " ".join("yz"[i % 2] for i in range(50))]
    rows, of = lm.Coder(sub).runs(texts)
    begins, got = np.append(sub.begins, True), Counter()
    for k, row in zip(of.tolist(), rows.to_pylist()):
        got.update((k, row[i - 1], row[i]) for i in range(1, len(row)) if begins[row[i]])
    want = Counter()
    for k, t in enumerate(texts):
        ids = [-1, *(i for w in words(t) for i in sub.ids(w.encode("utf-8", "replace"))), -1]
        want.update((k, a, b) for a, b in zip(ids, ids[1:]) if begins[b])
    assert got == want
    given = lm.as_windows(rows, np.append(np.where(sub.begins, 1, lm.NONE), lm.END), np.ones(len(rows)))[1]
    assert (given != lm.NONE).sum() == sum(want.values())


def test_neighbours_of_all_texts(spark):
    texts = [" ".join(f"w{i % 7}" for i in range(n)) for n in (0, 1, 50, 900)]
    sub = lm.Subwords(open(RANKS, "rb").read())
    sent = spark.sparkContext.broadcast(open(RANKS, "rb").read())
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    want, first = Counter(), lambda w: sub.ids(w.encode())[0]
    for t in texts:
        ws = t.split()
        want.update((first(a), int(lm._slot(np.array([first(b)]))[0])) for a, b in zip(ws, ws[1:]))
        want.update([(first(ws[-1]), 0)] if ws else [])
    rows = lm.gather(d, sent, "text").where("a is not null").groupBy("a", "b").agg(F.sum("c").alias("c")).collect()
    assert {(r.a, r.b): r.c for r in rows} == want


def test_texts_are_kept_as_ids(spark, tricky, monkeypatch):
    """What training reads: all ids of each text, in slices of bounded size; pairs of neighbours come from them."""
    data = open(RANKS, "rb").read()
    sub = lm.Subwords(data)
    coded = lm.gather(tricky, spark.sparkContext.broadcast(data), "text", stretches=False).where("whole is not null").select("whole")
    want = [[i for w in words(r.text) for i in sub.ids(w.encode("utf-8", "replace"))] for r in tricky.collect()]
    column = coded.toArrow()["whole"].combine_chunks()
    monkeypatch.setattr(lm, "SLICE_IDS", 50)
    got = []
    for ids, n in lm.coded_texts(column.slice(1), sub.size):
        assert len(n) == 1 or len(ids) <= 50
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert sorted([*got, np.frombuffer(column[0].as_py(), "<u2").tolist()]) == sorted(want)
    none, kind = np.arange(sub.size + 1), np.append(np.arange(sub.size) % 50, 50)
    pairs = Counter()
    for ids in want:
        marked = [sub.size, *ids, sub.size]
        pairs.update((x, int(kind[y])) for x, y in zip(marked, marked[1:]) if y == sub.size or sub.begins[y])
    assert {(r.a, r.b): r.c for r in lm.followers(coded, sub.begins, none, kind).collect()} == pairs


def test_batches_of_texts_are_small(spark, documents, monkeypatch):
    """Wherever texts, or their ids, go to workers, by rows and by bytes; afterwards the session is as it was."""
    names, seen, kept = list(lm.BATCHES), {}, lm.settle
    before = [spark.conf.get(k) for k in names]
    monkeypatch.setattr(lm, "settle", lambda df, name: (seen.update({name: spark.conf.get(names[0])}), kept(df, name))[1])
    model, counts = lm.train(documents, RANKS)
    lm.score(documents, model, counts, RANKS)
    assert {"gathered", "fitted", "scored"} <= set(seen) and set(seen.values()) == {"1000"}
    assert [spark.conf.get(k) for k in names] == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.column(0).nbytes]})

    with lm.small_batches(spark):
        for length, n in ((10, 1000), (50_000, 400)):
            got = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), length).alias("t")).mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 3000 and max(r.n for r in got) <= n and max(r.bytes for r in got) < 20e6


def test_sums_of_stretches():
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 500):
        x = r.standard_normal((n, 5)).astype(np.float32)
        first = np.flatnonzero(np.diff(np.sort(np.minimum(r.zipf(1.3, n), 60)), prepend=-1)) if n else np.zeros(0, int)
        want = [x[a:b].sum(0) for a, b in zip(first, [*first[1:], n])]
        assert np.allclose(lm._sums(x, first), np.reshape(want, (-1, 5)), atol=1e-4)


def test_rows_by_input():
    r = np.random.default_rng(8)
    for n in (0, 1, 40, 3000):
        inputs = np.minimum(r.zipf(1.4, n), 90).astype(np.int16)
        x = r.standard_normal((n, 3))
        g = lm.Groups(inputs)
        assert sorted(g.order.tolist()) == list(range(n)) and sorted(g.inputs.tolist()) == sorted(set(inputs.tolist()))
        want = np.reshape([x[inputs == i].sum(0) for i in g.inputs], (-1, 3))
        assert np.allclose(g.sums(x[g.order]), want)
        table, rows = r.standard_normal((len(g.inputs), 3)), np.zeros((n, 3))
        g.add(rows, table)
        assert (g.inputs[[int(np.flatnonzero((table == row).all(1))[0]) for row in rows]] == inputs[g.order]).all() if n else True


def test_gradients_of_unlike_windows():
    """Windows with all, some and no targets, in more than one block, against the sum of each window's own; nothing has no gradient."""
    r = np.random.default_rng(11)
    net = lm.Net(*[a.astype(float) for a in random_net(5)])
    b = lm.BLOCK + 9
    c, t = r.integers(0, 40, (b, lm.WINDOW)), r.integers(0, lm.CLASSES, (b, lm.WINDOW))
    t[r.random(t.shape) < r.random((b, 1))] = lm.NONE
    t[3], t[4] = lm.NONE, np.arange(lm.WINDOW)
    weight = r.random(b) + 0.5

    def full(c, t, w):
        loss, g = lm.gradients(net, c, t, w)
        out = []
        for a, x in zip(net, g):
            dense = np.zeros_like(a)
            dense[x[0] if isinstance(x, tuple) else slice(None)] = x[1] if isinstance(x, tuple) else x
            out.append(dense)
        return [loss, *out]

    got = full(c, t, weight)
    mass = (t != lm.NONE).sum(1) * weight
    own = [full(c[i : i + 1], t[i : i + 1], weight[i : i + 1]) for i in range(b)]
    for k, x in enumerate(got):
        assert np.allclose(x, sum(own[i][k] * mass[i] for i in range(b)) / mass.sum(), atol=1e-12)
    assert all(not np.any(x) for x in own[3])


def test_only_places_with_a_target_look_back(monkeypatch):
    """Scoring makes as many rows of attention and of classes as there are words and ends, not one for each id."""
    made, kept = [], lm.Tables.scores
    monkeypatch.setattr(lm.Tables, "scores", lambda self, *a: (made.append(kept(self, *a)), made[-1])[1])
    r, s = np.random.default_rng(12), lm.Scorer.__new__(lm.Scorer)
    s.tables = lm.Tables(random_net(1))
    target = np.where(r.random(5000) < 0.6, lm.NONE, r.integers(0, lm.CLASSES, 5000))
    packed, sizes = r.integers(0, lm.INPUTS, 5000) * 256 + target, np.array([0, 4000, 1, 999])
    alone = [s.classes(x, np.array([len(x)]))[0] for x in np.split(packed, np.cumsum(sizes)[:-1])]
    made.clear()
    assert s.classes(packed, sizes).tolist() == alone
    assert sum(x.size for x in made) == (target != lm.NONE).sum()


def test_averages_by_a_tree(spark):
    r = np.random.default_rng(9)
    rows = [(k, float(r.integers(1, 50)), r.standard_normal(7).astype(np.float32).tolist()) for k in range(600) if k % 7]
    sets = spark.createDataFrame(rows, "part long, n double, p array<float>").repartition(5)
    want = np.average([p for *_, p in rows], axis=0, weights=[n for _, n, _ in rows])
    assert np.allclose(lm.averaged(sets, 600), want, atol=1e-5)


def test_training_stretches_spread(spark):
    texts = [" ".join(f"t{d}w{i}" for i in range(n)) for d, n in enumerate([300] * 60 + [6000])]
    sub = lm.Subwords(open(RANKS, "rb").read())
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = lm.gather(d, spark.sparkContext.broadcast(open(RANKS, "rb").read()), "text").where("ids is not null").collect()
    assert len(rows) == 60 + 10
    said = [sub.encoding.decode([i for i in r.ids if i >= 0]).split() for r in rows]
    assert all(len(s) == lm.STRETCH for s in said)  # nothing is clipped
    begins = [int(re.match(r"t\d+w(\d+)$", s[0])[1]) for s in said if not s[0].startswith("t60")]
    assert min(begins) == 0 and max(begins) == 300 - lm.STRETCH and any(100 < b < 200 for b in begins)
    assert any(r.ids[0] == -1 for r in rows) and any(r.ids[-1] == -1 for r in rows)
    for n in (0, 1, 31, 32, 33, 600, 601, 1700):
        at = lm.places(b"some text", n)
        assert len(at) == max(1, -(-n // 600)) and all(0 <= a <= max(0, n - lm.STRETCH) for a in at)


def test_subwords_in_bulk():
    sub = lm.Subwords(open(RANKS, "rb").read())
    some = [b"the", b"x" * 1000, b"a", "éà漢".encode(), b"th" * 30, b"y" * 401, b"end."]
    ids, first = sub.bulk(some)
    for w, a, b in zip(some, first, first[1:]):
        assert ids[a:b].tolist() == sub.ids(w)
        assert ids[a:b].tolist() == tiktoken.Encoding("e", pat_str=P.PATTERN, mergeable_ranks=sub.encoding._mergeable_ranks, special_tokens={})._encode_single_piece(b" " + w)


def test_lm_on_odd_texts(tricky, none):
    model, counts = lm.train(tricky, RANKS)
    got = lm.score(tricky, model, counts, RANKS).collect()
    assert len(got) == tricky.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    assert lm.score(none, model, counts, RANKS).count() == 0
    model, counts = lm.train(none, RANKS)
    got = lm.score(tricky, model, counts, RANKS).collect()
    assert len(got) == tricky.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in got)


# ---- 2


def test_surrogates(spark, none):
    texts = [
        "Mail Ann.Lee9@Mail.example.org or ANN.LEE9@MAIL.EXAMPLE.ORG, call +1 (967) 555-8180 or 967-555-8180.", None, "", "nothing here, version 2.0 of 2024",
        "Herr Müller met Frau Anna-Lena Schmidt; Herr MÜLLER left. IP 10.20.30.40, not 1.2.3.4.5 and 300.1.1.1", "card 4111 1111 1111 1111 and 4692889019130021; ssn 123-45-6789",
        "Г-жа Иванова и κ. Παπαδόπουλος; ann.lee9@mail.example.org; other@mail.example.org", "IBAN DE89370400440532013000.",
    ]
    rows = [(i, t, "keep") for i, t in enumerate(texts)] + [(5, texts[5], "keep")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.replace(d, "k1").collect()}
    assert pii.replace(d, "k1").count() == len(rows) and got[1].text is None and got[2].text == "" and got[3].text == texts[3] and got[0].kind == "keep"
    a = re.match(r"Mail (\S+@\S+) or (\S+@\S+), call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.$", got[0].text)
    assert a and a[1].lower() == a[2].lower() and a[2].isupper() and re.sub(r"\D", "", a[3]) == re.sub(r"\D", "", a[4])
    assert "967" not in got[0].text[20:] and "ann.lee9" not in got[0].text.lower() and a[1].endswith(".org")
    assert a[1].lower() in got[6].text and got[6].text.split("; ")[2].split("@")[1] == a[1].lower().split("@")[1]  # one domain, one surrogate
    m = re.match(r"Herr (\w+) met Frau (\w+)-(\w+) (\w+); Herr (\w+) left\. IP ([\d.]+), not 1\.2\.3\.4\.5 and 300\.1\.1\.1$", got[4].text)
    assert m and m[1].upper() == m[5] and m[2] in pii.GIVEN["latin", "f"] and m[1] != "Müller" and all(0 < int(x) < 256 for x in m[6].split("."))
    c = re.match(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}); ssn (\d{3}-\d\d-\d{4})$", got[5].text)
    luhn = lambda s: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(re.sub(r"\D", "", s)))) % 10
    assert c and luhn(c[1]) == 0 and c[1] != "4111 1111 1111 1111" and c[1][0] == "4"
    assert re.match(r"Г-жа [А-я]+ и κ\. [Α-ωά-ώ]+;", got[6].text) and "Иванова" not in got[6].text
    assert re.match(r"IBAN DE[0-9]{20}\.$", got[7].text) and got[7].text != texts[7]
    assert dict(got[4].pii) == {"name": 3, "ip": 1} and dict(got[3].pii) == {}
    assert {r.doc_id: r.text for r in pii.replace(d, "k1").collect()} == {i: r.text for i, r in got.items()}
    assert {r.doc_id: r.text for r in pii.replace(d, "k2").collect()} != {i: r.text for i, r in got.items()}
    assert pii.replace(none, "k").count() == 0


def test_one_person_one_name(spark):
    texts = [
        "Frau Anna Schmidt came. Dr Anna Schmidt left. Anna Schmidt wrote. Frau Schmidt paid. SCHMIDT signed, and Schmidt's car.",
        "Prof. Dr. Anna Schmidt and Herr Max Müller-Lüdenscheidt; Müller-Lüdenscheidt spoke.", "Schmidt and Anna are words here.", "Г-жа Иванова и г-н; Иванова; господин Петров",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(d, "k").collect()}
    m = re.fullmatch(r"Frau (\w+) (\w+) came\. Dr (\w+) (\w+) left\. (\w+) (\w+) wrote\. Frau (\w+) paid\. (\w+) signed, and (\w+)'s car\.", got[0].text)
    assert m and m[1] == m[3] == m[5] != "Anna" and m[2] == m[4] == m[6] == m[7] == m[9] != "Schmidt" and m[8] == m[2].upper()
    assert m[1] in pii.GIVEN["latin", "f"]  # the gender of any of the titles
    n = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+) and Herr (\w+) (\w+-\w+); (\w+-\w+) spoke\.", got[1].text)
    assert n and (n[1], n[2]) == (m[1], m[2]) and n[3] in pii.GIVEN["latin", "m"] and n[4] == n[5]
    assert got[2].text == texts[2] and dict(got[0].pii) == {"name": 6} and dict(got[1].pii) == {"name": 3}
    x = re.fullmatch(r"Г-жа (\w+) и г-н; (\w+); господин (\w+)", got[3].text)
    assert x and x[1] == x[2] and x[1].endswith("ова") and x[3].endswith("ов")


def iban(country, body):
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - n % 97:02d}{body}"


def test_numbers_keep_their_checks(spark):
    good = iban("DE", "370400440532013000")
    spaced = " ".join(good[i : i + 4] for i in range(0, len(good), 4))
    texts = [f"to {good} or {spaced}.", f"not {good[:-1]}1 at all", "card 2669109448945250, no card 2669109448945251", "at fe80::1ff:2 and 2001:DB8:0:0:0:0:0:1, 10:20:30, std::abs", "5 4111111111111111 5"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(d, "k").collect()}
    a = re.fullmatch(r"to (DE\d{20}) or (DE\d\d(?: \d{4}){4} \d\d)\.", got[0].text)
    assert a and a[1] == a[2].replace(" ", "") != good and int("".join(str(int(c, 36)) for c in a[1][4:] + a[1][:4])) % 97 == 1
    assert got[1].text == texts[1] and dict(got[1].pii) == {} and dict(got[0].pii) == {"iban": 2}
    luhn = lambda s: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(s))) % 10
    c = re.fullmatch(r"card (2\d{15}), no card 2669109448945251", got[2].text)
    assert c and luhn(c[1]) == 0 and c[1] != "2669109448945250"
    x = re.fullmatch(r"at ([0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]) and ([0-9A-F]{4}:[0-9A-F]{3}(?::[0-9A-F]){6}), 10:20:30, std::abs", got[3].text)
    assert x and x[1] != "fe80::1ff:2" and dict(got[3].pii) == {"ip": 2}
    assert dict(got[4].pii) == {"card": 1}


def plain_mentions(text):
    """What is to be replaced in a text without names: (start, end, type)."""
    import regex

    luhn = lambda s: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(s))) % 10
    at = 0
    while at < len(text):
        best = None
        for kind, p in (("email", pii.EMAIL), ("ip", pii.IP), ("ssn", pii.SSN), ("iban", pii.IBAN), ("card", pii.CARD), ("phone", pii.PHONE)):
            m = regex.search(p, text, pos=at)
            if m and (best is None or m.start() < best[0].start()):
                best = m, kind
        if not best:
            return
        m, kind = best
        if kind != "card" or luhn(re.sub(r"\D", "", m[0])) == 0:
            yield m.start(), m.end(), kind
        at = m.end()


def test_all_mentions_give_way(spark):
    """Against a plain search: the same places, the rest untouched, one surrogate each, none shared."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.replace(docs, "k").collect()}
    new, n = {}, 0
    for r in docs.collect():
        if r.text is None:
            assert got[r.doc_id].text is None
            continue
        out, at, shift = got[r.doc_id].text, 0, 0
        for a, b, kind in plain_mentions(r.text):
            assert out[at + shift : a + shift] == r.text[at:a]
            stop = len(out) - len(r.text) + b if False else b + shift
            if kind == "email":  # may be longer
                stop = a + shift + re.match(r"[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", out[a + shift :]).end()
            elif kind == "ip":
                stop = a + shift + re.match(r"[0-9.]*[0-9]", out[a + shift :]).end()
            key = (kind, re.sub(r"\D", "", r.text[a:b])[-10:] if kind == "phone" else r.text[a:b].lower())
            value = re.sub(r"\D", "", out[a + shift : stop])[-10:] if kind == "phone" else out[a + shift : stop].lower()
            assert new.setdefault(key, value) == value != key[1]
            at, shift, n = b, stop - b, n + 1
        assert out[at + shift :] == r.text[at:]
    assert n > 20 and len(set(new.values())) == len(new) and not {(k, v) for (k, _), v in new.items()} & set(new)


def test_surrogates_stay_different(spark):
    """More entities than one round of draws can tell apart."""
    n = 3000
    d = spark.range(n).select(F.lit("family").alias("kind"), F.concat(F.lit("Person"), F.expr("translate(cast(id as string), '0123456789', 'abcdefghij')")).alias("entity"), F.lit("m").alias("gender"))
    d = d.unionByName(d.where("entity like '%a'").withColumn("kind", F.lit("given")))
    d = d.unionByName(spark.range(400).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 3, "0").alias("entity"), F.lit(None).cast("string").alias("gender")))
    s = pii.surrogates(d, "key").collect()
    assert len(s) == d.count() and len({(r.kind, r.surrogate) for r in s}) == len(s)
    assert not {(r.kind, r.surrogate) for r in s} & {(r.kind, r.entity) for r in s}


def test_surrogates_where_a_shape_is_full(spark):
    # all one-letter addresses of all one-letter domains occur, so none of this shape is free
    letters = "abcdefghijklmnopqrstuvwxyz"
    all_ = [f"{x}@{y}.com" for x in letters for y in letters]
    rows = [(i, f"write to {e} now") for i, e in enumerate(all_)] + [(-1, "a@b.com, c@d.com and 123-45-6789")]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "key").collect()}
    assert len(got) == len(rows)
    new = [re.fullmatch(r"write to ([a-z]+@[a-z]+\.com) now", got[i].text)[1] for i in range(len(all_))]
    assert len(set(new)) == len(all_) and not set(new) & set(all_)
    of = dict(zip(all_, new))
    assert got[-1].text.startswith(f"{of['a@b.com']}, {of['c@d.com']} and ") and dict(got[-1].pii) == {"email": 2, "ssn": 1}


def test_no_surrogate_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 1)
    d = spark.createDataFrame([("ssn", f"{x}", None) for x in range(10)], "kind string, entity string, gender string")
    with pytest.raises(RuntimeError, match="ssn"):
        pii.surrogates(d, "key")


def test_surrogates_run_in_the_jvm(documents):
    plan = pii.replace(documents, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- all queries and the pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, sf, documents, name):
    got = QUERIES[name](spark, sf)
    n = got.count()
    assert n == documents.count() if "doc_id" in got.columns and name != "op5_repeats" else n > 0


def test_pipeline_against_plain_stages(spark, sf, documents):
    import base64

    import corpus_pipeline
    from aeolith.llm import secrets
    from aeolith.llm.common import crc_mod

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    model = toxicity.train(documents, spark.read.parquet(f"{sf}/labels.parquet"), lambda k: crc_mod(k, 5) != 0)
    m = toxicity.Matcher(model)
    rows = [(i, t) for i, t in rows if m.score([m.features(t or "", m.clauses(t or ""))])[0] < 0.5]
    near = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    keep = {i for i, _, c in near if i == c}
    rows = [(i, t) for i, t in rows if i in keep]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {k for k, *_, b in plain_contamination(rows, bench) if b}
    rows = [(i, secrets._masked(t, "[{kind}]")) for i, t in rows if i not in bad]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < documents.count()
    docs = documents.limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == documents.columns


def test_clashing_columns(spark, sf, documents):
    """Stages keep columns that have the names they use inside, and read the labels' own."""
    import corpus_pipeline

    odd = documents.limit(30)
    for name in ("toxic", "contamination", "bpe", "secrets", "pii", "id", "fp", "root", "component", "word", "n", "h", "t", "w"):
        odd = odd.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns and got.where("toxic = 1 and contamination = 1 and secrets = 1").count() == got.count() > 0
    assert pii.replace(odd.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), "k").count() == 30
    assert repeats.remove_repeats(odd).columns == odd.columns
    assert corpus_pipeline.encode(spark, odd, sf).count() == 30


def test_commonest(spark):
    r = np.random.default_rng(11)
    counts = [int(x) for x in r.zipf(1.4, 3000).clip(1, 10**6)]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i long, c long")
    for n in (0, 1, 50, 500, 2999, 3000, 10000):
        got = lm.commonest(d, "c", n).collect()
        assert len(got) <= n
        if got:
            least = min(x.c for x in got)
            assert len(got) == sum(c >= least for c in counts)
        if n >= 3000:
            assert len(got) == 3000
    assert lm.commonest(d.where("c < 0"), "c", 5).count() == 0


def test_sample_stays_under_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 40)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 200)
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, lambda k: F.lit(True))
    assert model.bias > -50 and len(model.whole) < 60


def test_scratch_can_be_removed(spark, tmp_path):
    import os

    from aeolith.llm import common

    d = common.settle(spark.range(5), "five")
    path = d.inputFiles()[0].removeprefix("file://")
    assert d.count() == 5 and os.path.exists(path)
    common.sweep(spark)
    assert not os.path.exists(path)
