"""The folder that driver and executors share: where intermediate and run outputs are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Only where that is unset and all runs on one machine
    (tests) a temporary folder is made and set; on a cluster it is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="aeolith-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def own_dir(spark: SparkSession) -> str:
    """This application's part of it."""
    return f"{shared_dir(spark)}/aeolith-{spark.sparkContext.applicationId}"


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path under it that nothing else has."""
    folder = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    _MADE.append(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many paths there have been: a mark for ``drop_since``."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Remove what was written since a mark, but for the last ``keep``."""
    for folder in _MADE[mark : len(_MADE) - keep]:
        remove(spark, folder)
    del _MADE[mark : len(_MADE) - keep]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename within one file system; the folder above ``to`` is made."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} can't be moved to {to}")


def sweep(spark: SparkSession) -> None:
    """Remove all that this application has written there; call it once results are written."""
    remove(spark, own_dir(spark))
