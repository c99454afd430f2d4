"""Bias correction: quantile mapping (QM) and quantile delta mapping (QDM), with moving windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.config import DEFAULT, EngineConfig
from aeolith.functions.numeric import by_variable, change, clamp
from aeolith.operators.cdf import cross_cdf, moving_cdf, self_cdf
from aeolith.operators.stats import area_statistics, linear_quantiles, weighted_mean, weighted_share


def node_table(fit: DataFrame, obs: DataFrame, by: Sequence[str], x: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """(by, mq, oq, complete): quantiles of the model's and the reference's samples at the
    nodes, and whether all samples of the group are there on both sides."""
    points = config.node_points
    m = fit.groupBy(*by).agg(linear_quantiles(x, points).alias("mq"), (F.count(x) == F.count("*")).alias("__m"))
    o = obs.groupBy(*by).agg(linear_quantiles(x, points).alias("oq"), (F.count(x) == F.count("*")).alias("__o"))
    return m.join(o, list(by)).select(*by, "mq", "oq", (F.col("__m") & F.col("__o")).alias("complete"))


def at_quantile(nodes: Column, p: Column, config: EngineConfig = DEFAULT) -> Column:
    """Value at p of an array of quantiles at equal steps, linear between them; p is clipped to the nodes."""
    pos = (F.least(F.greatest(p, F.lit(config.low)), F.lit(config.high)) - config.low) / (config.high - config.low) * (config.nodes - 1)
    j = F.least(F.floor(pos), F.lit(config.nodes - 1)).cast("int")
    low, high = F.element_at(nodes, j + 1), F.element_at(nodes, F.least(j + 2, F.lit(config.nodes)))
    return low + (pos - j) * (high - low)


def corrected(x: Column, mq: Column, oq: Column, additive: Column, floor: Column) -> tuple[Column, Column]:
    """(value, whether the ratio fell back to the difference)."""
    shifted = x + oq - mq
    use = F.abs(mq) > floor
    return F.when(additive | ~use, shifted).otherwise(x * oq / F.when(use, mq)), ~additive & ~use


def tail(p: Column, config: EngineConfig = DEFAULT) -> Column:
    return (p < config.low) | (p > config.high)


def correct(target: DataFrame, p: str, nodes: DataFrame, by: Sequence[str], x: str, name: str, additive: Sequence[str], variable: str = "variable", config: EngineConfig = DEFAULT) -> DataFrame:
    """``target`` (with a column ``p``) with columns name, name_tail and name_fallback; NULL in groups
    that aren't complete.  All variables go through one plan: the rows of ``variable`` say which are
    corrected by a difference, what their floors are, and which can't be negative."""
    d = target.join(nodes.select(*by, "mq", "oq", "complete"), list(by))
    q, v = F.col(p), F.col(variable)
    y, fell = corrected(F.col(x), at_quantile(F.col("mq"), q, config), at_quantile(F.col("oq"), q, config), v.isin(*additive), by_variable(v, config.floors))
    valid = F.col("complete") & q.isNotNull() & F.col(x).isNotNull()
    y = F.when(v.isin(*config.non_negative), clamp(y)).otherwise(y)
    return d.withColumn(name, F.when(valid, y)).withColumn(f"{name}_tail", F.when(valid, tail(q, config))).withColumn(f"{name}_fallback", F.when(valid, fell)).drop("mq", "oq", "complete")


def _whole_nodes(fit: DataFrame, obs: DataFrame, target: DataFrame, by: Sequence[str], x: str, config: EngineConfig) -> DataFrame:
    whole = target.groupBy(*by).agg((F.count(x) == F.count("*")).alias("__whole"))
    return node_table(fit, obs, by, x, config).join(whole, list(by)).withColumn("complete", F.col("complete") & F.col("__whole")).drop("__whole")


def quantile_mapping(fit: DataFrame, obs: DataFrame, target: DataFrame, by: Sequence[str], keep: Sequence[str], x: str, additive: Sequence[str] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """QM: a target's place among the model's samples, moved to the reference's value there.
    The group needs all of its target samples too.  ``by`` has the column ``variable``."""
    p = cross_cdf(fit, target, by, x, keep)
    return correct(p, "p", _whole_nodes(fit, obs, target, by, x, config), by, x, "qm", additive, config=config)


def delta_mapping(fit: DataFrame, obs: DataFrame, target: DataFrame, by: Sequence[str], keep: Sequence[str], x: str, additive: Sequence[str] = DEFAULT.additive, config: EngineConfig = DEFAULT) -> DataFrame:
    """QDM over the whole target period: a target's place among the targets."""
    p = target.select(*by, *keep, x).withColumn("p", self_cdf(by, x))
    return correct(p, "p", _whole_nodes(fit, obs, target, by, x, config), by, x, "qdm", additive, config=config)


def moving_delta_mapping(fit: DataFrame, obs: DataFrame, target: DataFrame, by: Sequence[str], order: str, x: str, additive: Sequence[str] = DEFAULT.additive, config: EngineConfig = DEFAULT) -> DataFrame:
    """QDM in clamped moving windows: only the window of a target has to be complete."""
    p = moving_cdf(target, by, order, x, config.window)
    return correct(p, "p", node_table(fit, obs, by, x, config), by, x, "qdm", additive, config=config)


FIT, OBS, TARGET = "fit", "obs", "target"


def _between_ranks(sample: Column, q: Column) -> Column:
    """Quantile of a sorted sample, linear between the two values whose ranks enclose it."""
    h = (F.size(sample) - 1) * q
    low = F.floor(h)
    a, b = F.get(sample, low.cast("int")), F.get(sample, F.ceil(h).cast("int"))
    return a + (h - low) * (b - a)


def _value_at(sample: Column, node: Column, part: Column, config: EngineConfig) -> Column:
    """Between a node's quantile and the next one's."""
    step = (config.high - config.low) / (config.nodes - 1)
    at = lambda j: _between_ranks(sample, F.lit(config.low) + F.least(j, F.lit(config.nodes - 1)) * step)
    return at(node) + part * (at(node + 1) - at(node))


def correct_samples(samples: DataFrame, by: Sequence[str], x: str = "value", role: str = "role", expected: dict[str, int] | None = None, additive: Sequence[str] | None = None, config: EngineConfig = DEFAULT, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """QM and QDM of all targets in one pass: ``samples`` are rows of the model's and the reference's
    history and of the targets, told apart by ``role``; ``by`` has the column ``variable``.

    The targets come back with, for both methods m: m, m_p, m_tail, m_fallback; complete; and the
    histories' means fit_mean and obs_mean.  A group is complete if it has values on all rows of
    all three roles, and as many as ``expected`` if that is given; else m, its tail and its fallback
    are NULL.  QM goes by ratio, QDM by ratio or by difference (``additive``).  With ``bounds`` (label: lowest and highest
    quantile) each target comes once for each pair, with the label in the column ``bounds``.

    A group is one row with its samples in order, made by one shuffle.  A target's place gives the ranks of the
    values that it needs, four of each history, which are picked there; no table of quantiles is made, and no row of a sample
    carries one.
    """
    additive = config.additive if additive is None else additive
    v, r = F.col(x), F.col(role)
    kept = [c for c in samples.columns if c not in (*by, role)]
    own = lambda k: F.when(r == k, v)
    sides = [F.array_sort(F.collect_list(own(k))).alias(f"__{k}") for k in (FIT, OBS)]
    rows = [F.count_if(r == k).alias(f"__rows_{k}") for k in (FIT, OBS, TARGET)]
    d = samples.groupBy(*by).agg(
        *sides, F.array_sort(F.collect_list(own(TARGET))).alias(f"__{TARGET}"), *rows, F.avg(own(FIT)).alias("fit_mean"), F.avg(own(OBS)).alias("obs_mean"),
        F.collect_list(F.when(r == TARGET, F.struct(*kept))).alias("__rows"),
    )
    whole = F.lit(True)
    for k in (FIT, OBS, TARGET):
        n = F.size(f"__{k}")
        whole = whole & (n > 0) & (n == F.col(f"__rows_{k}")) & ((n == expected[k]) if expected else F.lit(True))
    methods_of = (("qm", FIT), ("qdm", TARGET))

    def place(e: Column, k: str) -> Column:
        """(number of sample values below + half of the equal ones) / number."""
        below = F.aggregate(f"__{k}", F.lit(0.0), lambda a, s: a + F.when(s < e[x], 1.0).when(s == e[x], 0.5).otherwise(0.0))
        return F.when(e[x].isNotNull() & (F.size(f"__{k}") > 0), below / F.size(f"__{k}"))

    def ranked(label: str | None, c: EngineConfig) -> Column:
        """The targets with their places among the nodes, and what the histories have there."""
        pos = lambda p: (F.least(F.greatest(p, F.lit(c.low)), F.lit(c.high)) - c.low) / (c.high - c.low) * (c.nodes - 1)
        node = lambda p: F.least(F.floor(pos(p)), F.lit(c.nodes - 1))
        step = F.transform("__placed", lambda e: F.struct(e["row"].alias("row"), *[y.alias(n) for m, _ in methods_of for n, y in ((f"{m}_p", e[f"{m}_p"]), (f"{m}_j", node(e[f"{m}_p"])), (f"{m}_f", pos(e[f"{m}_p"]) - node(e[f"{m}_p"])))]))
        pick = lambda e, m, k: F.when(e[f"{m}_p"].isNotNull(), _value_at(F.col(f"__{k}"), e[f"{m}_j"], e[f"{m}_f"], c))
        tails = lambda e, m: tail(e[f"{m}_p"], c).alias(f"{m}_out")
        return F.transform(step, lambda e: F.struct(F.lit(label).alias("bounds"), e["row"].alias("row"), *[y for m, _ in methods_of for y in (e[f"{m}_p"].alias(f"{m}_p"), tails(e, m), pick(e, m, FIT).alias(f"{m}_m"), pick(e, m, OBS).alias(f"{m}_o"))]))

    placed = F.transform("__rows", lambda e: F.struct(e.alias("row"), *[place(e, k).alias(f"{m}_p") for m, k in methods_of]))
    d = d.where(F.size("__rows") > 0).withColumn("complete", whole).withColumn("__placed", placed)
    each = [ranked(label, replace(config, low=low, high=high)) for label, (low, high) in bounds.items()] if bounds else [ranked(None, config)]
    d = d.select(*by, "complete", "fit_mean", "obs_mean", F.explode(F.flatten(F.array(*each)) if bounds else each[0]).alias("__e"))
    got = ["__e.bounds"] if bounds else []
    d = d.select(*by, *[F.col(f"__e.row.{c}").alias(c) for c in kept], *got, "complete", "fit_mean", "obs_mean", *[F.col(f"__e.{m}_{c}").alias(f"__{m}_{c}" if c != "p" else f"{m}_p") for m, _ in methods_of for c in ("p", "out", "m", "o")])

    variable = F.col("variable")
    floor = by_variable(variable, config.floors)
    valid = F.col("complete") & v.isNotNull()
    for m, by_difference in (("qm", F.lit(False)), ("qdm", variable.isin(*additive))):
        y, fell = corrected(v, F.col(f"__{m}_m"), F.col(f"__{m}_o"), by_difference, floor)
        y = F.when(variable.isin(*config.non_negative), clamp(y)).otherwise(y)
        d = d.withColumn(m, F.when(valid, y)).withColumn(f"{m}_tail", F.when(valid, F.col(f"__{m}_out"))).withColumn(f"{m}_fallback", F.when(valid, fell))
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def methods(corrected_rows: DataFrame, x: str = "value") -> DataFrame:
    """Targets of ``correct_samples`` as one row for each of raw, qm and qdm: method, y, tail, fallback."""
    keep = [c for c in corrected_rows.columns if not c.startswith(("qm", "qdm"))]
    one = lambda m, y, t, f: F.struct(F.lit(m).alias("method"), y.alias("y"), t.alias("tail"), f.alias("fallback"))
    rows = F.array(one("raw", F.col(x), F.lit(False), F.lit(False)), *[one(m, F.col(m), F.col(f"{m}_tail"), F.col(f"{m}_fallback")) for m in ("qm", "qdm")])
    return corrected_rows.select(*keep, F.explode(rows).alias("__m")).select("__m.method", *keep, "__m.y", "__m.tail", "__m.fallback")


@dataclass
class VariableRun:
    """What one correction gives: the corrected rows, and three tables made from them."""

    corrected: DataFrame
    qc: DataFrame
    signal: DataFrame
    period_signal: DataFrame


def variable_run(samples: DataFrame, by: Sequence[str], period: Column, weight: str = "weight", reuse: Callable[[DataFrame], DataFrame] = lambda d: d, **how) -> VariableRun:
    """One correction with its checks: rows of quality statistics by (method, variable, month), signals by
    the same, and signals by ``period`` as well.  ``reuse`` keeps the corrected rows, if it is to."""
    rows = reuse(correct_samples(samples, by, **how))
    three = methods(rows)
    config = how.get("config", DEFAULT)
    return VariableRun(rows, qc_table(three, weight), signals(three, by, weight, config=config), signals(three.withColumn("part", period), by, weight, ["part"], config))


def qc_table(three: DataFrame, weight: str = "weight") -> DataFrame:
    """(method, variable, month, samples, n, the area statistics, tail and fallback per cent)."""
    g = ["method", "variable", "month"]
    y, w = F.col("y"), F.col(weight)
    share = three.groupBy(*g).agg(F.countDistinct("year").alias("samples"), weighted_share(F.col("tail"), y, w).alias("tail_percent"), weighted_share(F.col("fallback"), y, w).alias("fallback_percent"))
    return area_statistics(three, g, "y", weight).join(share, g)


def signals(three: DataFrame, by: Sequence[str], weight: str = "weight", extra: Sequence[str] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """(method, variable, month, extra, signal, difference_from_raw): area means of the change from the
    model's (raw) or the reference's history, and how far they are from the raw one."""
    base = F.when(F.col("method") == "raw", F.col("fit_mean")).otherwise(F.col("obs_mean"))
    cells = three.groupBy("method", *by, *extra, weight).agg(F.avg("y").alias("future"), F.first(base).alias("base"))
    cells = cells.withColumn("signal", change(F.col("variable"), F.col("future"), F.col("base"), config.floors, config.additive))
    s = cells.where(F.col(weight) > 0).groupBy("variable", "month", *extra).pivot("method", ["raw", "qm", "qdm"]).agg(weighted_mean(F.col("signal"), F.col(weight)))
    s = s.withColumn("__raw", F.col("raw")).unpivot(["variable", "month", *extra, "__raw"], ["raw", "qm", "qdm"], "method", "signal").where("signal is not null")
    return s.select("method", "variable", "month", *extra, "signal", F.abs(F.col("signal") - F.col("__raw")).alias("difference_from_raw"))
