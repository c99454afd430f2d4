"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each text and stores measurements and one bit for
each failed rule.  Policies are versioned sets of rules; applying one, or asking what it
would keep without a rule, only reads the bits: ``apply_policy`` compares masks,
``ablations`` counts rows by their bits (at most 2 ** rules groups, partially aggregated)
and combines these counts.

Repeated windows are found inside a row: words are hashed, windows of 2, 4 and 8 words
get their hashes from their halves (64 bits: two different windows of one text agree with
a chance of 2 ** -64), and only texts whose windows aren't all distinct are sorted.

Null and empty texts have no words and fail ``few_words``; long texts are measured whole.
Equal rows get equal ledgers, each its own; an empty table gives no rows.  Only the text and the
columns ``keep`` are read, so others can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import SPACE

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules in the order of their bits: name and the condition under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
}
BASE_RULES = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE_RULES, "v1": tuple(RULES)}
CURRENT = "v1"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _pairs(h: str, shift: int) -> Column:
    """Hashes of windows of twice ``shift`` words from those of ``shift`` words."""
    n = f"greatest(size({h}) - {shift}, 0)"
    return F.expr(f"zip_with(slice({h}, 1, {n}), slice({h}, {shift + 1}, {n}), (a, b) -> xxhash64(a, b))")


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` and MEASURES (all long)."""
    names = [f"__k{i}" for i in range(len(keep))]
    d = docs.select(*[docs[k].alias(n) for k, n in zip(keep, names)], F.coalesce(docs[text_col], F.lit("")).alias("t"))
    d = d.select(
        *names,
        F.array_remove(F.split("t", SPACE), "").alias("w"),
        F.expr(r"cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    d = d.select(
        *names, "n_symbols", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    rest = [*names, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    for shift in (1, 2, 4):
        d = d.select(*rest, _pairs("h", shift).alias("h"))
    # (hash, place) in order, only where some window occurs twice
    d = d.select(*rest, F.expr("case when size(h) > size(array_distinct(h)) then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end").alias("s"))
    d = d.select(*rest, F.expr("sort_array(filter(transform(s, (x, k) -> case when get(s, k - 1).h = x.h or get(s, k + 1).h = x.h then x.i end), x -> x is not null))").alias("p"))
    covered = f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1), x + {WINDOW}) - x)), 0L, (a, x) -> a + x)"
    d = d.select(*rest, F.expr(f"coalesce({covered}, 0L)").alias("n_repeat_words"))
    return d.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *MEASURES)


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, MEASURES and ``failed`` (long, a bit for each failed rule)."""
    failed = " | ".join(f"case when {cond} then {bit(name)}L else 0L end" for name, cond in RULES.items())
    return measure(docs, text_col, keep).withColumn("failed", F.expr(failed))


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> Column:
    """Whether a row of a ledger passes."""
    return entries["failed"].bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without): from the counts of equal bit sets."""
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    when = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0))
    return (
        counts.select("bits", "n", rules).select("bits", "n", "r.*").groupBy("rule")
        .agg(when("bits & bit <> 0").alias("n_failed"), when("bits = bit").alias("n_only"), when("bits = 0").alias("n_kept"), when("bits & ~bit = 0").alias("n_kept_without"))
    )


def seen_bits(entries: DataFrame, by: str) -> DataFrame:
    """For each value of ``by`` the rules that some row, and that every row, fails."""
    return entries.groupBy(by).agg(F.bit_or("failed").alias("failed_by_some"), F.bit_and("failed").alias("failed_by_all"))
