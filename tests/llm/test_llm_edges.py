"""Very long texts, clashing columns, empty tables and missing ids, for each operator and the pipeline."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from aeolith.llm import byte_bpe, chats, decontaminate, lm, pii, quality, repeats, secrets, simhash, toxicity

from .test_llm_corpus import plain_contamination, plain_fingerprint

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PASSAGE = "seven green boats went over the quiet lake while nobody on either shore was looking at them"
TAIL = f" {PASSAGE}. You idiot. Mail ann.lee@mail.example.org now, token = abcdefgh12345"


def long_text(seed, n=1_200_000):
    r = np.random.default_rng(seed)
    letters = r.integers(97, 123, n)
    letters[r.random(n) < 0.17] = 32
    letters[r.random(n) < 0.004] = 10
    return letters.astype(np.uint8).tobytes().decode() + TAIL


@pytest.fixture(scope="module")
def long(spark):
    """Texts of over a million characters, one of them one word, and columns that have the names of results."""
    a = long_text(1)
    rows = [(1, a), (2, long_text(2)), (3, "x" * 1_100_000 + TAIL), (4, a), (5, "short"), (None, "no id"), (6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("bpe", "toxicity", "secrets", "pii", "contamination", "failed", "score"):
        d = d.withColumn(name, F.lit("own"))
    return d


def rows_of(df, column):
    return {r.doc_id: r[column] for r in df.select("doc_id", column).collect()}


def test_encoding(long):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(byte_bpe.encode(long, RANKS, fields=("n_tokens", "ids_sha256", "decoded_sha256")), "bpe")
    text = rows_of(long, "text")
    for i in (1, 2, 5, 6, 7):
        ids = plain.encode_ordinary(text[i] or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert all(got[i].decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest() for i in text)


def test_surrogates(long):
    got, text = rows_of(pii.replace(long, "k"), "text"), rows_of(long, "text")
    for i in (1, 2, 3, 4):
        before, after = text[i].split("ann.lee@mail.example.org")
        assert got[i].startswith(before) and got[i].endswith(after) and len(got[i]) == len(text[i]) and got[i] != text[i]
    assert {i: got[i] for i in (5, 6, 7, None)} == {i: text[i] for i in (5, 6, 7, None)}


def test_toxicity(long):
    model = toxicity.Model(whole={"idiot": 4.0}, weights=(1.0,) * toxicity.FEATURES, bias=0.0)
    got, text = rows_of(toxicity.score(long, model), "toxicity"), rows_of(long, "text")
    for i in (1, 2, 3, 4):
        (c,) = got[i].clauses
        assert text[i][c.start : c.end] == " You idiot" and c.score == 6
    assert [got[i].clauses for i in (5, 6, 7)] == [[]] * 3


def test_rules(long):
    got, text = {r.doc_id: r for r in quality.ledger(long).collect()}, rows_of(long, "text")
    for i, t in text.items():
        assert got[i].n_words == len((t or "").split()) and got[i].word_chars == sum(map(len, (t or "").split()))
    assert got[1].failed == got[4].failed


def test_repeats_and_copies(long, spark):
    d = long.where("doc_id is not null")
    assert [(r.id, r.first_ids) for r in repeats.repeats(d).collect()] == [(4, [1])]
    got = {r.id: r for r in simhash.near_duplicates(d).collect()}
    assert got[1].component == got[4].component == 1 and all(got[i].fp & (1 << 64) - 1 == plain_fingerprint(t) for i, t in rows_of(d, "text").items())
    kept = simhash.one_of_each(long)
    assert kept.columns == long.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 5, 6]


def test_scores(long):
    model, counts = lm.train(long, RANKS)
    got = {r.id: r for r in lm.score(long, model, counts, RANKS).collect()}
    assert len(got) == long.count() and got[1].score == got[4].score and all(np.isfinite(r.score) and r.score < 0 for r in got.values())
    assert {i: r.n_tokens for i, r in got.items()} == {i: len((t or "").split()) + 1 for i, t in rows_of(long, "text").items()}


def test_secrets(long):
    got, text = rows_of(secrets.scan(long), "secrets"), rows_of(long, "text")
    for i in (1, 2, 3, 4):
        assert [text[i][s.start : s.end] for s in got[i] if s.kind == "assign"] == ["token = abcdefgh12345"]
    assert got[6] == got[7] == []


def test_contamination(long, spark):
    bench = spark.createDataFrame([("a", PASSAGE), ("b", None)], "item_id string, text string")
    got = rows_of(decontaminate.decontaminate(long, bench), "contamination")
    for key, n, hit, found, bad in plain_contamination(list(rows_of(long, "text").items()), [("a", PASSAGE)]):
        assert (got[key].n_words, got[key].n_hit, got[key]["items"], got[key].contaminated) == (n, hit, found, bad)
    assert got[1].n_hit == len(PASSAGE.split())


def test_chats_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id long, turn long, role string, text string, key string").withColumn("turns", F.lit(1))
    assert [tuple(r) for r in chats.collapse(d).collect()] == [(1, 1, 1, "<|user|>\na\n")]


@pytest.fixture(scope="module")
def odd_dir(spark, sf, tmp_path_factory):
    """The smallest tables with documents that have null ids and texts, and repeated rows."""
    path = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long"))
    more = more.unionByName(docs.limit(3)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(docs.limit(2).withColumn("text", F.lit("")).withColumn("doc_id", F.col("doc_id") + 2 * 10**6))
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id < -1").write.parquet(f"{path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        t.write.parquet(f"{path}/{name}.parquet")
        t.limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, odd_dir, sf):
    got = corpus_pipeline.run(spark, odd_dir).collect()
    plain = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    ids = [r.doc_id for r in got]
    # copies without an id and repeated rows go; of the texts that are null or empty one stays
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None and i < 10**6} == plain
    assert sum(r.n_tokens == 0 for r in got) == 1


def test_pipeline_on_empty_tables(spark, odd_dir):
    got = corpus_pipeline.run(spark, f"{odd_dir}/none")
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_scratch_must_be_shared(spark, monkeypatch):
    from aeolith import scratch

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Far)
