"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.package import ship

#: Tables that this driver has written and not yet deleted.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but
    only on a local master; on a cluster it is an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that delete_written(), or else the end of the driver, deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: this cuts lineage, and a lost executor costs only
    the tasks that were running on it. The table stays until delete_written() or the end of the driver. by: columns, not all of df's, of
    which each value gets a folder, so that a filter on them reads no more."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(table: DataFrame) -> None:
    """Deletes a table that written() has returned, when nothing will read it any more."""
    path = table._written
    if path in _PATHS:
        _PATHS.remove(path)
    _deleted(table.sparkSession, [path])


def _deleted(spark: SparkSession, paths: list[str]) -> int:
    n = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def delete_written(spark: SparkSession) -> int:
    """Deletes all intermediate tables of this driver, once results that read them have been used. Returns how many."""
    paths, _PATHS[:] = list(_PATHS), []
    return _deleted(spark, paths)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written inside, but for those that the body names with the function it gets: ``keep(df)`` writes df for
    good and returns it."""
    first, kept = len(_PATHS), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.append(_PATHS[-1])
        return out

    yield keep
    paths = [p for p in _PATHS[first:] if p not in kept]
    _PATHS[first:] = kept
    _deleted(spark, paths)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
