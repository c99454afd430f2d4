import zlib

import pytest

TRICKY = [
    None, "", " ", "\n\n \t", "a", "A b", "A b c", "It's 'still' they'll  we've 'RE  x y　z\n\n q", "x" * 3000, "ab " * 700, "éÉ \U0001f600 中文 12²٣", "one two three four five six seven eight",
    "line one is here\nline one is here\n\n  \nline one is here", "* # $ % & | < > **", "\x00\x01 nul", "tail space ", "  odd\x85separators\x1c here", "AbC DeF " * 40,
]


@pytest.fixture(scope="session")
def tricky(spark):
    """(doc_id, text, spare columns with names that operators use inside): nulls, ties, repeated rows."""
    rows = [(i, t, "s", 1.0) for i, t in enumerate(TRICKY)]
    rows += [rows[6], (100, TRICKY[11], None, None), (101, TRICKY[11], "s", 2.0), (None, "no id here at all", "s", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(tricky):
    return tricky.where("doc_id < -1")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())
