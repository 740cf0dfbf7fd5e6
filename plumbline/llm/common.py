"""What the corpus operators share: the shared folder, written tables, reading and Arrow helpers.

Every Python stage on rows runs through ``mapped``, which is ``DataFrame.mapInArrow``: it streams record batches, so a task's memory is bounded by
a batch (and by one row, if that is larger), never by a partition or a group.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.package import ship
from plumbline.sources.stored import delete, delete_written, new_path, scratch, shared_dir, tidy, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only (the path can be in any store that Spark reads). Executors get the package
    first, so any query can be the first of its session."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes (null stays null), and the named columns; other columns are left behind,
    whatever their names. Rows without a doc_id have no identity and are left out."""
    ship(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    return docs.select(*cols, *[F.col(c) for c in more]).where(F.col("doc_id").isNotNull())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose column holds about most_bytes at most (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, n + 1, batch.column(column).offset * 4).astype(np.int64)) if pa.types.is_binary(batch.schema.field(column).type) or pa.types.is_string(batch.schema.field(column).type) else np.array([len(x.as_py() or b"") for x in batch.column(column)])
    at, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += s
    yield batch.slice(at)


def give_back() -> None:
    """Returns freed memory to the system, since the Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema) whose workers return the memory of a task when it ends."""

    def g(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(g, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
