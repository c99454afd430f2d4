"""Helpers shared by the text operators: table access, shared scratch space, batched Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.scratch import new_path, sweep  # noqa: F401
from aeolith.ship import ship

#: Texts are handed to a kernel in slices of about so many characters, so memory doesn't follow a batch's size.
SLICE_CHARS = 1_000_000

#: ASCII white space: the characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends here,
    and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, null as "", in lists of about ``limit`` characters."""
    out: list[str] = []
    size = 0
    for start in range(0, len(texts), 256):
        for t in texts.slice(start, 256).to_pylist():
            t = t or ""
            out.append(t)
            size += len(t)
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


def text_udf(kernel: Callable[[], Callable[[list[str]], dict[str, list]]], fields: dict[str, pa.DataType], ddl: str):
    """An Arrow UDF over a text column.

    ``kernel()`` is called once in each task and gives a function from a list of
    texts to one list for each of ``fields``.
    """
    names, types = list(fields), list(fields.values())
    ship(SparkSession.active())

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = kernel()
        for batch in batches:
            parts = []
            for texts in slices(batch):
                got = work(texts)
                parts.append(pa.StructArray.from_arrays([pa.array(got[n], t) for n, t in zip(names, types)], names))
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], t) for t in types], names)

    return run


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of a key's text, modulo ``mod`` (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def commonest(df: DataFrame, c: str, n: int) -> DataFrame:
    """The rows with the largest counts, ``n`` at most: those over a limit that a histogram of
    the counts' logarithms gives (some thousand bins at most), so nothing is sorted or gathered."""
    step = F.floor(16 * F.log2(F.col(c).cast("double"))).cast("int")
    held, limit = 0, None
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        held += r["count"]
        if held > n:
            break
        limit = r.step
    return df.where(step >= limit if limit is not None else F.lit(False))


#: Rows of the commonest keys that are broadcast, and how often a key occurs at least to be one.
HOT_KEYS, HOT_ROWS = 50_000, 1_000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row for each ``key`` and, in ``n``, how many rows
    have it; ``n`` goes.

    The commonest keys, ``HOT_KEYS`` at most, are broadcast, the others shuffled, so that no
    key's rows gather in one task.  Both are read twice: settle them before.
    """
    hot = commonest(by_key.where(F.col(n) >= HOT_ROWS), n, HOT_KEYS)
    if hot.isEmpty():
        return rows.join(by_key.drop(n), key)
    few, rest = F.broadcast(hot.drop(n)), by_key.join(F.broadcast(hot.select(key)), key, "left_anti").drop(n)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


_CODE = np.random.default_rng(20240612).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64)
    return _POWERS


def words_in(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end, given which bytes are blank; the first and the last are."""
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1


def word_hashes(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``begin`` to ``end`` of a row of bytes, the same wherever they stand."""
    up, down = _powers(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[buffer] * up[: len(buffer)], dtype=np.uint64)))
    h = (sums[end] - sums[begin]) * down[begin]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))
