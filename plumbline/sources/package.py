"""Giving executors this package, for sessions that were started without it on the workers' path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Spark's own value of a setting, and the one that takes its place. Rows are whole texts: 10,000 rows, or 64 MB, a batch take hundreds of MB
#: in each worker and as much outside the executor's heap.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application. Workers that find it on their own path use that."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        sc.addPyFile(str(path))
    for name, (default, ours) in _BATCH.items():  # another setting is kept
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    _SHIPPED.add(sc.applicationId)
