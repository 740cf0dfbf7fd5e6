"""Dense names: a number from 0 for each different value, so that long values are compared once and numbers after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written


def dense(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows, whatever their order, numbered from 0 without gaps, as a written table. A row's number is its place in its partition after the rows of the
    partitions before it; only one row a partition meets in one task."""
    part = written(rows.withColumn("_at", F.monotonically_increasing_id()), "names")
    p, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = part.groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return part.withColumn("_p", p).join(F.broadcast(before), "_p").withColumn(name, place + F.col("_b")).drop("_at", "_p", "_b")


def named(rows: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    """rows with the dense name of their columns' values, which must not be null, in place of the columns."""
    return rows.join(dense(rows.select(*columns).distinct(), name), columns).drop(*columns)
