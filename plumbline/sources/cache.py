"""A growing cache of rewritten texts: a folder of commits, each of which Spark writes to a folder of its own.

A commit's files appear when its job is over, so an entry is whole or absent, and commits can be written at the same time. Entries are named by their
content (``cache_id``), so an entry that is there twice does no harm: the least (text, model) counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import jsonl

ENTRY = "cache_id string, text string, model string, error string"


class Cache:
    """JSON Lines below ``path``. Files that lie there without a commit's folder are read too."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame:
        if not jsonl.exists(self.spark, self.path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(self.path)  # files of open commits are hidden

    def read(self) -> DataFrame:
        """(cache_id, text, model), a row for each id; entries that hold an error are as good as absent."""
        least = F.min(F.struct("text", "model")).alias("e")
        return self._rows().where("error is null and cache_id is not null").groupBy("cache_id").agg(least).select("cache_id", "e.text", "e.model")

    def errors(self, ids: DataFrame) -> str | None:
        """One error of those that are stored for these ids."""
        row = self._rows().where("error is not null").join(ids.select("cache_id"), "cache_id").agg(F.min("error").alias("e")).first()
        return row["e"]

    def append(self, rows: DataFrame) -> None:
        """One commit of (cache_id, text, model) and perhaps error."""
        rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
        rows.select("cache_id", "text", "model", "error").write.json(f"{self.path}/commit-{uuid.uuid4().hex}")

    def commits(self) -> list[str]:
        """The folders of finished commits."""
        if not jsonl.exists(self.spark, self.path):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().toString() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("commit-")]
        return sorted(x for x in names if jsonl.exists(self.spark, f"{x}/_SUCCESS"))

    def compact(self) -> int:
        """Makes one commit of all finished ones, and deletes those. Returns how many they were. Not while others write."""
        old = self.commits()
        if len(old) > 1:
            self.append(self.read())
            for x in old:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(x)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)
