"""Batches: what is stored, and what is done again."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from aeolith.operators.batch import Batch, Job, canonical, input_digests

KEYS = ["model", "scenario"]
NAMES = ["model=a/scenario=1", "model=a/scenario=2", "model=b/scenario=1"]


@pytest.fixture(scope="module")
def combos(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "model string, scenario int")


class Lost(BaseException):
    pass


def events(df):
    return sorted((r.key, r.status, r.rows) for r in df.collect())


def numbers(spark, bad=()):
    def work(keys, settings):
        d = spark.range(settings.get("n", 5) * keys["scenario"]).withColumnRenamed("id", "x")
        return d.withColumn("x", F.raise_error(F.lit("broken")).cast("long")) if keys["model"] in bad else d

    return work


@pytest.mark.parametrize("parallel", [1, 3])
def test_failures_are_stored_and_done_again(spark, combos, tmp_path, parallel):
    batch = Batch(spark, str(tmp_path / "out"), KEYS)
    assert events(batch.run(combos, numbers(spark), dry=True)) == [(k, "DRY_RUN", 0) for k in NAMES] and not (tmp_path / "out").exists()
    first = batch.run(combos, numbers(spark, "b"), parallel=parallel)
    assert events(first) == [(NAMES[0], "COMPLETED", 5), (NAMES[1], "COMPLETED", 10), (NAMES[2], "FAILED", 0)]
    assert "broken" in first.where("status = 'FAILED'").collect()[0].message
    assert batch.outputs().count() == 15 and not os.listdir(tmp_path / "out/_staging")
    # another driver has nothing but the folder
    again = Batch(spark, str(tmp_path / "out"), KEYS)
    assert events(again.run(combos, numbers(spark), parallel=parallel)) == [(NAMES[0], "SKIPPED_COMPLETE", 5), (NAMES[1], "SKIPPED_COMPLETE", 10), (NAMES[2], "COMPLETED", 5)]
    assert {s for _, s, _ in events(again.run(combos, numbers(spark), force=True))} == {"COMPLETED"}
    assert {tuple(r) for r in again.outputs().groupBy(*KEYS).count().collect()} == {("a", 1, 5), ("a", 2, 10), ("b", 1, 5)}
    assert again.history().count() == 9 and again.latest().count() == 3


def test_only_what_settings_change(spark, combos, tmp_path):
    settings = {"a": {"n": 5}, "b": {"n": 5}}
    make = lambda: Batch(spark, str(tmp_path), KEYS, lambda keys: settings[keys["model"]])
    make().run(combos, numbers(spark))
    settings["b"] = {"n": 7}
    batch = make()
    assert events(batch.run(combos, numbers(spark))) == [(NAMES[0], "SKIPPED_COMPLETE", 5), (NAMES[1], "SKIPPED_COMPLETE", 10), (NAMES[2], "COMPLETED", 7)]
    assert batch.outputs().count() == 22
    # going back finds what is still there; cleaning leaves what the last rows name
    settings["b"] = {"n": 5}
    assert [s for _, s, _ in events(make().run(combos, numbers(spark)))] == ["SKIPPED_COMPLETE"] * 3
    assert make().outputs().count() == 20
    make().clean()
    assert len(list((tmp_path / "data/model=b/scenario=1").iterdir())) == 1 and make().outputs().count() == 20
    assert canonical({"b": 1, "a": [2.5]}) == canonical(dict([("a", [2.5]), ("b", 1)]))


def test_only_what_inputs_change(spark, combos, tmp_path):
    rows = combos.crossJoin(spark.range(4)).withColumn("v", F.col("id") / 3)
    changed = rows.withColumn("v", F.when((F.col("model") == "a") & (F.col("scenario") == 2) & (F.col("id") == 3), None).otherwise(F.col("v")))
    runs = []
    for d in (rows, rows.repartition(7).orderBy(F.desc("id")), changed):
        batch = Batch(spark, str(tmp_path), KEYS, inputs=input_digests(d, KEYS))
        runs.append([s for _, s, _ in events(batch.run(combos, numbers(spark)))])
    assert runs == [["COMPLETED"] * 3, ["SKIPPED_COMPLETE"] * 3, ["SKIPPED_COMPLETE", "COMPLETED", "SKIPPED_COMPLETE"]]


@pytest.mark.parametrize("parallel", [1, 2])
def test_cut_off_anywhere(spark, combos, tmp_path, parallel):
    """Progress of whole combinations stays; what was being written isn't taken for whole."""
    target, begun = str(tmp_path), []

    def work(keys, settings):
        begun.append(keys)
        if len(begun) == 3:
            raise Lost
        return numbers(spark)(keys, settings)

    with pytest.raises(Lost):
        Batch(spark, target, KEYS).run(combos, work, parallel=parallel)
    batch = Batch(spark, target, KEYS)
    # a run that was lost while it wrote, and one that was lost after its move and before its row
    spark.range(3).write.parquet(f"{target}/_staging/left")
    before = batch.history().where("status = 'COMPLETED'").count()
    assert 1 <= before <= 2
    got = [s for _, s, _ in events(batch.run(combos, numbers(spark)))]
    assert sorted(got) == sorted(["SKIPPED_COMPLETE"] * before + ["COMPLETED"] * (3 - before))
    for name in os.listdir(f"{target}/_status"):
        os.rename(f"{target}/_status/{name}", tmp_path.parent / f"gone-{parallel}-{name}")
    assert [s for _, s, _ in events(batch.run(combos, numbers(spark)))] == ["SKIPPED_COMPLETE"] * 3
    batch.clean()
    assert not os.path.exists(f"{target}/_staging") and batch.outputs().count() == 20


def test_side_by_side_in_pools_and_groups(spark, combos, tmp_path):
    seen, most, now, lock = [], [0], [0], threading.Lock()

    def work(keys, settings):
        sc = spark.sparkContext
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            seen.append((sc.getLocalProperty("spark.scheduler.pool"), sc.getLocalProperty("spark.jobGroup.id")))
        time.sleep(0.5)
        with lock:
            now[0] -= 1
        return spark.range(0)

    batch = Batch(spark, str(tmp_path), KEYS)
    assert [(s, n) for _, s, n in events(batch.run(combos, work, parallel=3, run="r1"))] == [("COMPLETED", 0)] * 3
    assert most[0] == 3 and {p for p, _ in seen} == {"batch-0", "batch-1", "batch-2"} and {g for _, g in seen} == {f"batch:r1:{n}" for n in NAMES}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_stop_on_error(spark, combos, tmp_path):
    batch = Batch(spark, str(tmp_path), KEYS)
    assert [s for _, s, _ in events(batch.run(combos, numbers(spark, "a"), parallel=1, stop_on_error=True))] == ["FAILED"]

    def work(keys, settings):
        if keys["model"] == "b":
            time.sleep(2)
            raise ValueError("no such model")
        return spark.range(10**12, numPartitions=2).agg(F.sum(F.sqrt("id"))) if keys["scenario"] == 2 else spark.range(1)

    got = dict((k, s) for k, s, _ in events(batch.run(combos, work, parallel=3, stop_on_error=True)))
    assert (got[NAMES[1]], got[NAMES[2]]) == ("CANCELLED", "FAILED")


def test_nothing_there(spark, combos, tmp_path):
    batch = Batch(spark, str(tmp_path / "none"), KEYS)
    assert batch.history().count() == 0 and batch.jobs(combos.limit(0)) == [] and not batch.is_whole(Job({}, {}, "x", "y"))
    with pytest.raises(ValueError, match="no whole output"):
        batch.outputs()
