"""Batches: energy, corrections and diagnostics of all combinations, in stored runs."""

from pyspark.sql import functions as F

from aeolith.operators import bias
from aeolith.operators import diagnostics as diag
from aeolith.operators.batch import Batch, input_digests
from aeolith.operators.energy import energy_chain
from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, monthly, out, r, reused
from aeolith.plans.correction import _FIT, _KEYS, _OBS, BY, SQL, YEARS, samples
from aeolith.plans.diagnosis import _BY, _DIAG, _MEASURES, both_distributions
from aeolith.plans.energy import SQL_CHAIN
from aeolith.plans.registry import query
from aeolith.scratch import new_path

_RUNS = ["model", "source"]


def _of(cube, keys):
    for k, v in keys.items():
        cube = cube.where(F.col(k) == v)
    return cube


def _energy(spark, sf_dir, **settings):
    """A batch of energy, of which one combination can't be computed: (batch, combinations, work)."""
    cube = reused(monthly(spark, sf_dir))

    def work(keys, settings):
        d = _of(cube, keys)
        if keys == {"model": "R", "source": "ref"}:
            d = d.withColumn("rsds", F.raise_error(F.lit("no radiation")).cast("double"))
        return energy_chain(d).drop(*_RUNS)

    return Batch(spark, new_path(spark, "energy"), _RUNS, **settings), cube.select(*_RUNS).distinct(), work


@query(f"""{A}, c AS (SELECT model, source, count(*) AS rows FROM a GROUP BY ALL), k AS (SELECT 'model=' || model || '/source=' || source AS key, model = 'R' AND source = 'ref' AS bad, rows FROM c)
SELECT 'dry' AS run, key, 'DRY_RUN' AS status, 0 AS rows FROM k UNION ALL SELECT 'first', key, CASE WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END, CASE WHEN bad THEN 0 ELSE rows END FROM k
UNION ALL SELECT 'again', key, CASE WHEN bad THEN 'FAILED' ELSE 'SKIPPED_COMPLETE' END, CASE WHEN bad THEN 0 ELSE rows END FROM k""")
def batch_status(spark, sf_dir):
    """A batch that is planned, run, and resumed after a failure."""
    batch, combos, work = _energy(spark, sf_dir)
    planned = batch.run(combos, work, dry=True, run="dry")
    for name in ("first", "again"):
        batch.run(combos, work, run=name)
    return planned.unionByName(batch.history()).select("run", "key", "status", "rows")


@query(f"{A}, {SQL_CHAIN} SELECT model, source, year, {r('sum(pvpot * weight) / sum(CASE WHEN pvpot IS NOT NULL THEN weight END)')} AS pvpot FROM e WHERE NOT (model = 'R' AND source = 'ref') GROUP BY ALL HAVING sum(weight) > 0")
def summary_of_stored(spark, sf_dir):
    """Yearly area means of what a batch has stored, without computing it again."""
    batch, combos, work = _energy(spark, sf_dir)
    batch.run(combos, work)
    d = batch.outputs()
    return out(d.groupBy("model", "source", "year").agg(weighted_mean(F.col("pvpot"), F.col("weight")).alias("pvpot")).where("pvpot is not null"), ["model", "source", "year"], ["pvpot"])


class CutOff(BaseException):
    """Stands for a driver that is lost."""


@query(f"""{A}, n AS (SELECT model, source, count(*) AS rows FROM a GROUP BY ALL), c AS (SELECT 'model=' || model || '/source=' || source AS key, *, row_number() OVER (ORDER BY model, source) AS k FROM n)
SELECT 'cut off' AS run, key, 'COMPLETED' AS status, rows, 100.0 AS hub FROM c WHERE k <= 3
UNION ALL SELECT 'resumed', key, CASE WHEN k <= 3 AND model <> 'A' THEN 'SKIPPED_COMPLETE' ELSE 'COMPLETED' END, rows, CASE WHEN model = 'A' THEN 120.0 ELSE 100.0 END FROM c
UNION ALL SELECT 'changed inputs', key, CASE WHEN source = 'ref' THEN 'COMPLETED' ELSE 'SKIPPED_COMPLETE' END, rows, CASE WHEN model = 'A' THEN 120.0 ELSE 100.0 END FROM c""")
def batch_resumed(spark, sf_dir):
    """A batch that is cut off in its fourth combination, resumed with another hub height for one model, and run
    again when all references have changed: the stored run table, which has the settings."""
    cube, target = reused(monthly(spark, sf_dir)), new_path(spark, "resumed")
    combos = cube.select(*_RUNS).distinct()

    def run(name, cube, hub, cut=None, parallel=3):
        def work(keys, settings):
            if cut and name == "cut off" and len(began) == cut:
                raise CutOff
            began.append(keys)
            return energy_chain(_of(cube, keys), height=settings["hub"]).drop(*_RUNS)

        began = []
        inputs = input_digests(cube.select(*_RUNS, "cell", "ym", "tas", "rsds", "wind"), _RUNS)
        batch = Batch(spark, target, _RUNS, lambda keys: {"hub": hub.get(keys["model"], 100.0)}, inputs)
        try:
            batch.run(combos, work, parallel=parallel, run=name)
        except CutOff:
            pass
        return batch

    run("cut off", cube, {}, cut=3, parallel=1)
    run("resumed", cube, {"A": 120.0})
    changed = cube.withColumn("tas", F.when(F.col("source") == "ref", F.col("tas") + 0.25).otherwise(F.col("tas")))
    batch = run("changed inputs", changed, {"A": 120.0})
    return batch.history().select("run", "key", "status", "rows", F.get_json_object("settings", "$.hub").cast("double").alias("hub"))


@query(f"""{SQL}, m AS (SELECT model, variable, month, avg(qm) AS qm, avg(qdm) AS qdm, count(*) AS n FROM cq GROUP BY ALL) SELECT model, variable, month, n, {r('qm')} AS qm, {r('qdm')} AS qdm FROM m""")
def batch_of_corrections(spark, sf_dir):
    """Each model and variable corrected and stored by itself; monthly means of what is stored."""
    rows = reused(samples(monthly(spark, sf_dir)))
    batch = Batch(spark, new_path(spark, "corrected"), ["model", "variable"], {"fit": [1995, 1997], "target": [1998, 2000]})
    batch.run(rows.select("model", "variable").distinct(), lambda keys, settings: bias.correct_samples(_of(rows, keys), BY, expected=YEARS).drop("model", "variable"))
    g = batch.outputs().groupBy("model", "variable", "month").agg(F.avg("qm").alias("qm"), F.avg("qdm").alias("qdm"), F.count("*").alias("n"))
    return out(g, ["model", "variable", "month"], ["qm", "qdm"], ["n"])


@query(f"""{A}, {_DIAG} SELECT model, variable, month, measure, count(value) AS n, {r('quantile_cont(value, 0.5)')} AS median FROM dl GROUP BY ALL""")
def batch_of_diagnostics(spark, sf_dir):
    """Distribution diagnostics of each model, stored by themselves and read together."""
    cube = reused(monthly(spark, sf_dir))
    batch = Batch(spark, new_path(spark, "diagnostics"), ["model"], {"last_year": 1999})

    def work(keys, settings):
        _, cells = both_distributions(_of(cube, keys))
        cells = cells.withColumns({f"{s}_skew": F.when(F.col(f"{s}_std") > 1e-9, F.col(f"{s}_skew")) for s in ("model", "reference")})
        return diag.spatial_summary(cells.select(*_BY, *_MEASURES), _BY, _MEASURES).drop("model")

    batch.run(cube.select("model").distinct(), work)
    return out(batch.outputs().where("n > 0"), ["model", "variable", "month", "measure"], ["median"], ["n"])
