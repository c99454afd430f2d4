"""Toxicity by a weighted finite-state pattern grammar.

The lexical transducer reads words and writes symbols: INSULT and THREAT (with weights),
TARGET, NEGATION, REPORT, WORD.  Insults are learned from labels: whole words and word
beginnings that are far commoner in toxic documents, weighted by their log odds.  Three
clause transducers pass symbols on and multiply weights: negation fades what follows
within a few words, reported speech halves what follows in the clause, a target raises an
insult and is what makes a threat count.  They are composed into one table.  What is
scored is a matched clause: the sum of its weighted matches, in which a word that the text
has matched before counts little.  A logistic model over a document's clause scores
(total, greatest, strongest match, share of words) gives the score from 0 to 1.

Learning reads labelled training rows only, at most ``TOXIC_ROWS`` toxic and
``CLEAN_ROWS`` other texts (those of small id hashes), which bounds what is
broadcast and sent to the driver; scoring reads every whole text.  Copies in the sample,
and most near-copies, count once (by the least hash of their shingles).  All of the sample
gives the lexicon, all terms with enough evidence.  The logistic model is fitted on
cross-fitted clause scores: each half of the sample is scored by a lexicon from the other
half, so it learns how a lexicon does on texts that it hasn't seen, at every size of sample.

Null and empty texts match nothing and get the model's base score; long texts are scored
whole, in one pass.  Repeated rows get the same score each; entries of equal weight are
taken by their letters.  Without toxic labels the lexicon is empty and every score is 0.  A
document with several labels counts as toxic if one of them says so; labels without an id or
without a value are left out.  An empty table gives no rows.  Other columns stay, but for
one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import settle, text_udf

#: Bounds of the sample that the classifier is fitted on.
TOXIC_ROWS, CLEAN_ROWS = 8_000, 16_000
#: A lexicon entry is in so many toxic texts at least and has this log odds at least; the
#: evidence (log likelihood ratio, in nats, of its texts being toxic more often than others)
#: is over the logarithm of the number of terms tried, so that few entries are there by chance.
LEAST_TEXTS, LEAST_ODDS, LEAST_EVIDENCE = 3, 1.5, 12.0
#: Word beginnings of so many letters at least.
LEAST_STEM = 3
TOP_WEIGHT = 7.0
#: What is left of a match's weight if the text has matched its word before.
REPEATED = 0.1
FEATURES = 5

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD = range(6)

# Function words of four languages.
_TARGETS = "you your you're u he him his she her they them their du dich dir dein ihr euch sie er tu te toi ton vous votre il elle tú te ti usted ustedes él ella".split()
_NEGATIONS = "not no never n't isn't don't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco ningún".split()
_REPORTS = "said says say told called calls wrote reported quoted sagte sagt nannte schrieb dit disait appelait écrit dijo dice llamó escribió".split()
_THREATS = "kill hurt destroy murder beat strangle töten umbringen schlagen tuer frapper matar golpear".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """States from 0 (the start); step(state, symbol) -> (next state, factor on the symbol's weight)."""

    states: int
    table: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.table.get((state, symbol), (state, 1.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; weights multiply."""
    table = {}
    for s in range(a.states):
        for t in range(b.states):
            for x in range(6):
                (s2, f), (t2, g) = a.step(s, x), b.step(t, x)
                table[s * b.states + t, x] = (s2 * b.states + t2, f * g)
    return Transducer(a.states * b.states, table)


NEGATION_REACH = 3
FADED, REPORTED, TARGETED, IDLE_THREAT = 0.3, 0.5, 1.5, 0.2


@cache
def grammar() -> Transducer:
    negation = {(s, x): (max(0, s - 1), FADED if s and x in (INSULT, THREAT) else 1.0) for s in range(NEGATION_REACH + 1) for x in range(6)}
    negation |= {(s, NEGATION): (NEGATION_REACH, 1.0) for s in range(NEGATION_REACH + 1)}
    report = {(0, REPORT): (1, 1.0), (1, INSULT): (1, REPORTED), (1, THREAT): (1, REPORTED)}
    target = {(0, TARGET): (1, 1.0), (0, THREAT): (0, IDLE_THREAT), (1, INSULT): (1, TARGETED)}
    return compose(compose(Transducer(NEGATION_REACH + 1, negation), Transducer(2, report)), Transducer(2, target))


def lowered(text: str) -> str:
    """In lower case, with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([x if len(x := c.lower()) == 1 else c for c in text])


_FIXED_SYMBOLS = {w: TARGET for w in _TARGETS} | {w: NEGATION for w in _NEGATIONS} | {w: REPORT for w in _REPORTS}


@dataclass
class Model:
    """Whole words and word beginnings with weights, and the logistic model's coefficients."""

    whole: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    mean: tuple[float, ...] = (0.0,) * FEATURES
    scale: tuple[float, ...] = (1.0,) * FEATURES
    weights: tuple[float, ...] = (0.0,) * FEATURES
    bias: float = -50.0


class Matcher:
    """The lexical transducer: one automaton over all entries, then the grammar over the clauses with a match."""

    def __init__(self, model: Model):
        self.model = model
        self.entries = ahocorasick.Automaton()
        known: dict[str, list[tuple[bool, int, float]]] = {}
        for w in _THREATS:
            known.setdefault(w, []).append((True, THREAT, model.whole.get(w, 1.0)))
        for w, x in model.whole.items():
            if w not in _THREATS:
                known.setdefault(w, []).append((True, INSULT, x))
        for w, x in model.stems.items():
            known.setdefault(w, []).append((False, INSULT, x))
        for w, what in known.items():
            self.entries.add_word(w, (len(w), what))
        self.entries.make_automaton()
        self.table = grammar().table

    def matches(self, low: str) -> dict[int, tuple[int, float]]:
        """Where words begin that match -> (symbol, weight); of several entries the heaviest."""
        found: dict[int, tuple[int, float]] = {}
        n = len(low)
        for last, (size, what) in self.entries.iter(low):
            start = last - size + 1
            if start and low[start - 1].isalpha():
                continue
            inside = last + 1 < n and low[last + 1].isalpha()
            for whole, symbol, weight in what:
                if whole != inside and (start not in found or found[start][1] < weight):
                    found[start] = (symbol, weight)
        return found

    def clauses(self, text: str) -> list[tuple[int, int, float, float]]:
        """(start, end, score, strongest match) of each clause with a match, in code points of the text."""
        low = lowered(text)
        found = self.matches(low)
        if not found:
            return []
        ends = [m.start() for m in _CLAUSE_END.finditer(low)]
        out, step, seen = [], self.table, set()
        places, at = sorted(found), 0
        while at < len(places):
            k = bisect.bisect_left(ends, places[at])
            begin, end = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low)
            state, score, top = 0, 0.0, 0.0
            for m in _TOKEN.finditer(low, begin, end):
                symbol, weight = found.get(m.start(), (None, 0.0))
                if symbol is None:
                    symbol = _FIXED_SYMBOLS.get(m[0], WORD)
                state, factor = step[state, symbol]
                if weight:
                    weight *= factor * (REPEATED if m[0] in seen else 1.0)
                    seen.add(m[0])
                    score, top = score + weight, max(top, weight)
            out.append((begin, end, score, top))
            at = bisect.bisect_left(places, end, at)
        return out

    def features(self, text: str, clauses: list[tuple[int, int, float, float]]) -> tuple[float, ...]:
        scores = [c[2] for c in clauses]
        total, n = sum(scores), text.count(" ") + 1
        return math.log1p(total), math.log1p(max(scores, default=0.0)), max((c[3] for c in clauses), default=0.0), math.log1p(100 * total / (n + 20)), math.log(n)

    def score(self, features) -> np.ndarray:
        m = self.model
        x = (np.array(features, float).reshape(-1, FEATURES) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights) + m.bias, -50, 50)))


#: Numbers of texts by half of the sample and by label.
_COUNTS = ("neg0", "neg1", "pos0", "pos1")


def _count_terms(batches):
    """(term, in how many texts of each kind): "w" stands for whole words, "s" for beginnings."""
    counts = tuple(Counter() for _ in _COUNTS)

    def flush():
        terms = list(set().union(*counts))
        out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), **{n: pa.array([c[t] for t in terms], pa.int64()) for n, c in zip(_COUNTS, counts)}})
        for c in counts:
            c.clear()
        return out

    for b in batches:
        for text, toxic, half in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), b["half"].to_pylist()):
            terms = set()
            for w in set(_LETTERS.findall(lowered(text))):
                terms.add("w" + w)
                terms.update("s" + w[:k] for k in range(LEAST_STEM, min(len(w), 13)))
            counts[2 * bool(toxic) + half].update(terms)
            if sum(map(len, counts)) > 400_000:
                yield flush()
    yield flush()


def _least_shingle():
    """The least hash of a text's shingles of three words, which near-copies mostly share."""

    def one(text: str) -> int:
        w = text.lower().split()
        return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1

    return lambda texts: {"h": [one(t) for t in texts]}


def _evidence(p, n, n_pos: int, n_neg: int):
    """(log odds, log likelihood ratio in nats) of terms in ``p`` of ``n_pos`` toxic texts and ``n`` of ``n_neg`` others."""
    p, n = np.asarray(p, float), np.asarray(n, float)
    odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((n + 0.5) / (n_neg + 1))
    share = n_pos / max(1, n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(p > 0, p * np.log(p / (p + n) / share), 0.0) + np.where(n > 0, n * np.log(n / (p + n) / (1 - share)), 0.0)
    return odds, ratio


def _lexicon(terms: list[str], p: np.ndarray, n: np.ndarray, n_pos: int, n_neg: int) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and beginnings that have the evidence and that no other entry makes superfluous."""
    if not n_pos or not n_neg:
        return {}, {}
    x, ratio = _evidence(p, n, n_pos, n_neg)
    good = np.flatnonzero((p >= LEAST_TEXTS) & (x >= LEAST_ODDS) & (ratio >= LEAST_EVIDENCE))
    odds = {terms[i]: (float(x[i]), int(p[i])) for i in good.tolist()}
    # A beginning gives way to a longer one, or to a whole word, that keeps nearly all its texts.
    longer = set()
    for t, (x, p) in odds.items():
        for k in range(LEAST_STEM, len(t)):
            s = "s" + t[1 : k + 1]
            if s != t and s in odds and p >= 0.95 * odds[s][1] and x >= odds[s][0] - 0.1:
                longer.add(s)
    kept: dict[str, float] = {}
    for t in sorted(odds.keys() - longer, key=lambda t: (len(t), t)):
        x = odds[t][0]
        above = max((kept.get("s" + t[1 : k + 1], 0.0) for k in range(LEAST_STEM, len(t))), default=0.0)
        if above < x - 0.5:
            kept[t] = x
    return {t[1:]: min(TOP_WEIGHT, x) for t, x in kept.items() if t[0] == "w"}, {t[1:]: min(TOP_WEIGHT, x) for t, x in kept.items() if t[0] == "s"}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the coefficients."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-6]) / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on those of ``labels`` for whose id ``training(id column)`` holds."""
    l = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic is not null")
    l = settle(l.where(training(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    totals = {r.toxic: r["count"] for r in l.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Model()
    # by a limit on the ids' hashes, somewhat under the bound, so nothing is sorted
    part = {k: min(1.0, 0.95 * most / totals[k]) for k, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))}
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    picked = l.where(place < F.when(F.col("toxic") > 0, part[1] * 1_000_000).otherwise(part[0] * 1_000_000))
    picked = picked.select(F.col("id").alias("__id"), (F.col("toxic") > 0).alias("toxic"))
    # at most TOXIC_ROWS + CLEAN_ROWS ids are broadcast
    own = docs.select(docs[id_col].alias("__own"), docs[text_col].alias("text"))
    sample = own.join(F.broadcast(picked), F.col("__own") == F.col("__id")).select("text", "toxic")
    least = text_udf(_least_shingle, {"h": pa.int64()}, "struct<h:bigint>")
    sample = settle(sample.where("text is not null").withColumn("h", least("text")["h"]).dropDuplicates(["h", "toxic"]), "sample")
    sample = sample.withColumn("half", F.pmod(F.col("h"), F.lit(2)).cast("int"))
    size = {(bool(r.toxic), r.half): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    terms = sample.select("text", "toxic", "half").mapInArrow(_count_terms, "term string, " + ", ".join(f"{n} bigint" for n in _COUNTS))
    terms = terms.groupBy("term").agg(*[F.sum(n).alias(n) for n in _COUNTS])
    texts = lambda toxic, halves: sum(size.get((toxic, h), 0) for h in halves)

    def likely(halves):
        """Whether a term is in enough toxic texts of these halves, and odds are high enough."""
        p, n = (sum((F.col(f"{side}{h}") for h in halves[1:]), F.col(f"{side}{halves[0]}")) for side in ("pos", "neg"))
        odds = F.log((p + 0.5) / F.lit(texts(True, halves) + 1)) - F.log((n + 0.5) / F.lit(texts(False, halves) + 1))
        return (p >= LEAST_TEXTS) & (odds >= LEAST_ODDS - 1e-9)

    # the sample's bounds are those of what comes to the driver, too
    at_all = terms.where(likely((0,)) | likely((1,)) | likely((0, 1))).toArrow()
    names = at_all["term"].to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    names, count = [names[i] for i in order], {n: at_all[n].to_numpy()[order] for n in _COUNTS}
    of = lambda halves: _lexicon(names, sum(count[f"pos{h}"] for h in halves), sum(count[f"neg{h}"] for h in halves), texts(True, halves), texts(False, halves))
    model = Model(*of((0, 1)))
    # a half's texts are scored by the other half's lexicon
    folds = docs.sparkSession.sparkContext.broadcast((Model(*of((1,))), Model(*of((0,)))))

    def kernel(half: int):
        def make():
            matcher = _matcher(folds.value[half])
            return lambda texts: {"x": [list(matcher.features(t, matcher.clauses(t))) for t in texts]}

        return make

    scored = None
    for h in (0, 1):
        udf = text_udf(kernel(h), {"x": pa.list_(pa.float64())}, "struct<x:array<double>>")
        part = sample.where(F.col("half") == h).select("toxic", "h", udf("text")["x"].alias("x"))
        scored = part if scored is None else scored.unionByName(part)
    seen = sorted(scored.collect(), key=lambda r: (r.toxic, r.h))  # a few numbers for each row of the bounded sample
    x, y = np.array([r.x for r in seen]).reshape(-1, FEATURES), np.array([r.toxic for r in seen], float)
    if not len(y) or y.min() == y.max():
        return Model()
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w, bias = _logistic((x - mean) / scale, y)
    # the sample's share of toxic rows may differ from that of all labels
    bias += math.log(totals[1] / totals[0]) - math.log(y.sum() / (len(y) - y.sum()))
    model.mean, model.scale, model.weights, model.bias = tuple(mean), tuple(scale), tuple(w), bias
    return model


_MATCHERS: list[tuple[Model, Matcher]] = []


def _matcher(model: Model) -> Matcher:
    for known, matcher in _MATCHERS:
        if known is model:
            return matcher
    del _MATCHERS[2:]
    _MATCHERS.insert(0, (model, Matcher(model)))
    return _MATCHERS[0][1]


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``to`` (replaced if there is one): score (double) and clauses (array of start,
    end, score; in code points)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        matcher = _matcher(sent.value)

        def work(texts: list[str]) -> dict[str, list]:
            found = [matcher.clauses(t) if t else [] for t in texts]
            features = [matcher.features(t, f) for t, f in zip(texts, found)]
            clauses = [[{"start": a, "end": b, "score": s} for a, b, s, _ in f] for f in found]
            return {"score": matcher.score(features), "clauses": clauses}

        return work

    clause = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    udf = text_udf(kernel, {"score": pa.float64(), "clauses": pa.list_(clause)}, "struct<score:double,clauses:array<struct<start:bigint,end:bigint,score:double>>>")
    return docs.withColumn(to, udf(F.col(text_col)))
