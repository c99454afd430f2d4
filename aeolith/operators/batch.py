"""Batches as transactions: one Spark job for each combination of a registry, in a stored run table.

What a combination is to give is named by a digest of its keys, its settings and its inputs.  It is written
to a staging folder and moved to its place when it is whole, and then, before the next is taken up, a
row of the run table is stored.  So a batch that was cut off, wherever that was, goes on from what
is there; and one that is run again with other settings or other inputs does again what these change, and nothing else.

Under a batch's folder:

* ``data/<key>=<value>/.../digest=<digest>``: whole outputs, each in one move;
* ``_staging/<id>``: outputs being written, or left by a run that was cut off (``clean`` removes these);
* ``_status/<run>/<id>``: the run table, one small file for each row, so runs side by side don't disturb each other.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.scratch import exists, move, remove

#: The run table.
EVENTS = "run string, key string, digest string, status string, rows bigint, seconds double, message string, settings string, output string, at timestamp"
COMPLETED, SKIPPED, FAILED, CANCELLED, DRY_RUN = "COMPLETED", "SKIPPED_COMPLETE", "FAILED", "CANCELLED", "DRY_RUN"


def canonical(x) -> str:
    """Settings (dataclasses, dictionaries, lists, numbers, texts) as one text that doesn't depend on their order."""
    return json.dumps(x, sort_keys=True, default=lambda v: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else str(v))


def digest_of(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:20]


def input_digests(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, digest) of the rows of each combination, whatever their order: one aggregation over the inputs of a whole batch."""
    values = [c for c in df.columns if c not in keys]
    both = [F.xxhash64(*[F.lit(s) for s in seed], *values).cast("decimal(20,0)") for seed in ((), ("second",))]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(h).cast("string").alias(f"h{i}") for i, h in enumerate(both)])
    return g.select(*keys, F.concat_ws("/", F.col("n").cast("string"), "h0", "h1").alias("digest"))


@dataclasses.dataclass(frozen=True)
class Job:
    """One combination of a batch."""

    keys: dict
    settings: dict
    name: str
    digest: str

    @property
    def output(self) -> str:
        return f"data/{self.name}/digest={self.digest}"


class Batch:
    """A folder of outputs with its run table.

    ``settings``: a dictionary for all combinations, or a function from a combination to one.  ``inputs``: (keys, digest)
    of what combinations read, as ``input_digests`` gives it.
    """

    def __init__(self, spark: SparkSession, target: str, keys: Sequence[str], settings: dict | Callable[[dict], dict] | None = None, inputs: DataFrame | None = None):
        self.spark, self.target, self.keys = spark, target.rstrip("/"), list(keys)
        self._settings = settings if callable(settings) else (lambda _: dict(settings or {}))
        self._inputs = inputs

    def jobs(self, combos: DataFrame) -> list[Job]:
        """Combinations in order; a registry has some dozens, so these are the driver's."""
        rows = combos.select(*self.keys).distinct()
        if self._inputs is not None:
            rows = rows.join(self._inputs, self.keys, "left")
        out = []
        for r in rows.orderBy(*self.keys).collect():
            keys = {k: r[k] for k in self.keys}
            settings = self._settings(keys)
            name = "/".join(f"{k}={v}" for k, v in keys.items())
            out.append(Job(keys, settings, name, digest_of(name, canonical(settings), str(r["digest"]) if self._inputs is not None else "")))
        return out

    # ---- the run table

    def record(self, run: str, job: Job, status: str, rows: int = 0, seconds: float = 0.0, message: str = "") -> None:
        row = (run, job.name, job.digest, status, int(rows), float(seconds), message, canonical(job.settings), job.output, datetime.now(UTC))
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.parquet(f"{self.target}/_status/{run}/{uuid.uuid4().hex}")

    def history(self) -> DataFrame:
        """All rows of the run table."""
        if not exists(self.spark, f"{self.target}/_status"):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.target}/_status/*/*")

    def latest(self) -> DataFrame:
        """The last row of each combination."""
        w = Window.partitionBy("key").orderBy(F.col("at").desc())
        return self.history().withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")

    def outputs(self, jobs: Sequence[Job] | None = None) -> DataFrame:
        """What combinations have stored, with their keys as columns: of ``jobs`` those that are whole, or of each
        combination what it last gave.  Nothing is computed again."""
        if jobs is None:
            done = [r.output for r in self.latest().where(F.col("status").isin(COMPLETED, SKIPPED)).collect()]
        else:
            done = [j.output for j in jobs if self.is_whole(j)]
        if not done:
            raise ValueError(f"{self.target} has no whole output of these combinations")
        return self.spark.read.option("basePath", f"{self.target}/data").parquet(*[f"{self.target}/{d}" for d in done]).drop("digest")

    def is_whole(self, job: Job) -> bool:
        return exists(self.spark, f"{self.target}/{job.output}/_SUCCESS")

    def clean(self) -> None:
        """Remove what runs that were cut off have left, and outputs that nothing in the run table names as its last."""
        remove(self.spark, f"{self.target}/_staging")
        latest = {r.output for r in self.latest().collect()}
        for r in self.history().where(F.col("status") == COMPLETED).select("output").distinct().collect():
            if r.output not in latest:
                remove(self.spark, f"{self.target}/{r.output}")

    # ---- running

    def run(self, combos: DataFrame, work: Callable[[dict, dict], DataFrame], parallel: int = 4, dry: bool = False, force: bool = False, stop_on_error: bool = False, run: str | None = None) -> DataFrame:
        """Do what is not there yet; the rows of the run table that this adds.

        ``work(keys, settings)`` gives a combination's output.  ``parallel`` combinations run side by side, each in a scheduler
        pool and a job group of its own (``batch:<run>:<combination>``).  One that fails is FAILED with its message and
        the others go on, unless ``stop_on_error``: then what runs is cancelled.  ``force`` does all again;
        ``dry`` plans the work without running or storing anything (DRY_RUN, or FAILED if it can't be planned).
        """
        run = run or uuid.uuid4().hex[:12]
        jobs = self.jobs(combos)
        if dry:
            return self.spark.createDataFrame([self._planned(run, j, work) for j in jobs], EVENTS)
        stop, running = threading.Event(), set()

        def one(job: Job, pool: str) -> bool:
            if stop.is_set():
                return False
            if not force and self.is_whole(job):
                self.record(run, job, SKIPPED, self._rows(job))
                return True
            began, group = time.time(), f"batch:{run}:{job.name}"
            sc = self.spark.sparkContext
            sc.setJobGroup(group, f"{job.name} ({job.digest})", interruptOnCancel=True)
            sc.setLocalProperty("spark.scheduler.pool", pool)
            running.add(group)
            try:
                rows = self._write(job, work)
            except Exception as e:  # noqa: BLE001 - whatever stops a combination is its status
                cancelled = stop.is_set()
                self.record(run, job, CANCELLED if cancelled else FAILED, 0, time.time() - began, str(e).split("\n")[0][:300])
                return cancelled
            finally:
                running.discard(group)
                sc.setLocalProperty("spark.jobGroup.id", None)
                sc.setLocalProperty("spark.scheduler.pool", None)
            self.record(run, job, COMPLETED, rows, time.time() - began)
            return True

        def halt():
            stop.set()
            for group in list(running):
                self.spark.sparkContext.cancelJobGroup(group)

        if parallel <= 1:
            for j in jobs:
                if not one(j, "batch-0") and stop_on_error:
                    break
        else:
            free = [f"batch-{k}" for k in range(parallel)]
            with ThreadPoolExecutor(parallel) as threads:
                waiting, going = list(reversed(jobs)), {}
                try:
                    while waiting or going:
                        while waiting and free and not stop.is_set():
                            pool = free.pop()
                            going[threads.submit(one, waiting.pop(), pool)] = pool
                        if not going:
                            break
                        for done in wait(going, return_when=FIRST_COMPLETED).done:
                            free.append(going.pop(done))
                            if not done.result() and stop_on_error:
                                halt()
                except BaseException:
                    halt()
                    raise
        return self.history().where(F.col("run") == run)

    def _planned(self, run: str, job: Job, work) -> tuple:
        began, status, message = time.time(), DRY_RUN, ""
        try:
            work(dict(job.keys), dict(job.settings)).schema  # noqa: B018
        except Exception as e:  # noqa: BLE001
            status, message = FAILED, str(e).split("\n")[0][:300]
        return (run, job.name, job.digest, status, 0, time.time() - began, message, canonical(job.settings), job.output, datetime.now(UTC))

    def _rows(self, job: Job) -> int:
        return self.spark.read.parquet(f"{self.target}/{job.output}").count()

    def _write(self, job: Job, work) -> int:
        """Write to a folder of its own, then move it; rows are counted while they are written."""
        staging, place = f"{self.target}/_staging/{uuid.uuid4().hex}", f"{self.target}/{job.output}"
        seen = Observation()
        d = work(dict(job.keys), dict(job.settings))
        try:
            d.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(staging)
        except BaseException:
            remove(self.spark, staging)
            raise
        remove(self.spark, place)  # only with force, or if a move was cut off
        move(self.spark, staging, place)
        return seen.get["rows"]
