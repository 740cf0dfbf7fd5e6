"""Deterministic sampling and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.stored import written


def shuffled_limit(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of the md5 of ``seed|key``: a top-n, not a full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def numbered(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in a total order: ranks within ranges of the order, and each range's count added to those after it.
    One row a range meets in one task, never the rows."""
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(df.repartitionByRange(blocks, *order).withColumn("_p", F.spark_partition_id()), "ranges")  # once, so both uses see the same ranges
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return part.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b") - 1).drop("_p", "_r", "_b")


def fixed_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """batch: the number of the run of ``size`` rows that a row is in, by a unique key's order."""
    return numbered(df, order, name="_pos").withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int | None, flag: str | None = None, order: Column | None = None) -> DataFrame:
    """n // strata rows of each stratum by a hash order (or ``order``); if none of them is flagged, up to 5 flagged rows more; cut to n.

    Without rows the result is empty.
    """
    first = order if order is not None else F.xxhash64(F.lit(seed), F.col(key))
    strata = df.select(stratum).distinct().count()
    if not strata:
        return df.limit(0)
    per = max(1, n // strata)
    w = Window.partitionBy(stratum).orderBy(first, key)
    out = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")
    if flag is not None and out.where(F.col(flag)).isEmpty():
        out = out.unionByName(df.where(F.col(flag)).orderBy(first, key).limit(5))
    return out.orderBy(first, key).limit(n) if per * strata > n or flag is not None else out
