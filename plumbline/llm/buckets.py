"""Comparing the members of buckets pair by pair, in bounded tasks.

A bucket of over BLOCK members is dealt into blocks, and each pair of blocks is a task of its own: whatever share of the
rows one bucket holds, a task sees 2 * BLOCK of them at most (about), and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def _partitions(df: DataFrame) -> int:
    """As many as the session says: a pair of blocks is few bytes but much work, so adaptive execution must not join partitions by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """rows of buckets with two members or more, with the columns lo, hi (the pair of blocks) and own (the row's block),
    dealt by (keys, lo, hi) and sorted by them. more: a table to join by ``member`` before they are dealt."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    rows = rows.join(sizes, keys).withColumn("_b", n).drop("_n")
    if more is not None:
        rows = rows.join(more, member)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(3), F.col(member)), F.col("_b")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    rows = rows.withColumn("_j", each).withColumn("lo", F.least("own", "_j")).withColumn("hi", F.greatest("own", "_j")).drop("_b", "_j")
    return rows.repartition(_partitions(rows), *keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", member)


def open_blocks(rows: DataFrame, keys: list[str], member: str, more: list[DataFrame], comp: str = "comp", block: int = BLOCK) -> DataFrame:
    """As block_pairs, for the buckets that hold members of different components. Members of a bucket's largest component needn't meet
    each other: each is in one block, and only the others are copied to all blocks, theirs and the largest one's. So a stray member costs a row
    a block, not a copy of the bucket. more: tables to join by ``member`` before the rows are dealt."""
    one = F.count(F.lit(1))
    kinds = rows.groupBy(*keys, comp).agg(one.alias("_c"))
    sizes = kinds.groupBy(*keys).agg(F.max_by(comp, F.struct("_c", comp)).alias("_top"), F.max("_c").alias("_m"), F.sum("_c").alias("_n"), one.alias("_k")).where("_k > 1")
    rows = rows.join(sizes, keys)
    for t in more:
        rows = rows.join(t, member)
    few, main = (F.ceil(x / F.lit(block)).cast("int") for x in (F.col("_n") - F.col("_m"), F.col("_m")))
    h = F.xxhash64(F.lit(3), F.col(member))
    own = F.when(F.col(comp) == F.col("_top"), few + F.pmod(h, main)).otherwise(F.pmod(h, few)).cast("int")
    last = F.when(F.col(comp) == F.col("_top"), few).otherwise(few + main) - 1
    rows = rows.withColumn("own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), last))).withColumn("lo", F.least("own", "_j")).withColumn("hi", F.greatest("own", "_j"))
    rows = rows.drop("_top", "_m", "_n", "_k", "_j")
    return rows.repartition(_partitions(rows), *keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", member)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys (numbers, not null), each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = k[:, lo].tobytes()
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
