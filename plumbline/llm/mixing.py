"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / size times on average. The whole part is taken surely; the
fractional parts are rounded together: two documents meet, one passes expected words to the other at random so that each
keeps its expectation and one becomes 0 or 1, and the other one goes on. The longest meet first, so the words taken
end within about one short document of the target. They form a reduction tree: leaves of about LEAF documents of one
source, then groups of FAN residuals, up to one residual per source, which is rounded to the nearest, for the source's words to end nearest to their target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, record, slices, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
LEAF = 4_000
FAN = 64
SEED = 20_240_601
_EDGE = 1e-9


def _sizes(batches):
    for batch in batches:
        for b in slices(batch, "text"):
            size = [len(x.split()) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(size, pa.int64())], ["doc_id", "source", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of runs of other than ASCII white space (bytes.split splits at exactly
    ``[\\x20\\x09-\\x0D]``). A null or empty text has size 0."""
    return documents_of(docs, "source").withColumn("source", F.col("source").cast("string")).transform(mapped, _sizes, "doc_id long, source string, size long")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, rank, source_size, n, target. Sources in code-point order, null last, take the weights in turn.

    The targets are min(most * size, level * weight) with the one level at which they sum to all sizes: the fixed
    point of cutting at the limit and sharing the excess by weight. One row per source is windowed, never documents.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("rank", F.row_number().over(order)).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows)
    by = by.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    by = by.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap") * F.lit(1 + 1e-12), F.col("level"))).over(all_rows))
    return by.select("source", "rank", "source_size", "n", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _coin(seed: int, *ids: int) -> float:
    return (xxhash.xxh64_intdigest(np.array(ids, np.int64).tobytes(), seed) >> 11) * 2.0**-53


def pivotal(ids: list[int], p: list[float], size: list[int], seed: int = SEED) -> tuple[list[int], float]:
    """Rounds the probabilities p in turn. Returns the 0/1 decisions, -1 for the one left open, and its mass (-1.0 if none
    is left open).

    What two documents exchange is words: one gains x / its size, the other loses x / its size, with x the most that
    either direction allows and the direction drawn so that both keep their expectation. The expected words stay the
    same at each step. A document of no words is decided by itself.
    """
    out = [0] * len(ids)
    held, mass = -1, 0.0
    for i, b in enumerate(p):
        if b <= _EDGE or b >= 1 - _EDGE:
            out[i] = int(b > 0.5)
            continue
        if size[i] == 0:
            out[i] = int(_coin(seed, ids[i]) < b)
            continue
        if held < 0:
            held, mass = i, b
            continue
        s, t = size[held], size[i]
        up, down = min((1 - mass) * s, b * t), min(mass * s, (1 - b) * t)
        x = up if _coin(seed, ids[held], ids[i]) * (up + down) < down else -down
        mass, b = mass + x / s, b - x / t
        if b <= _EDGE or b >= 1 - _EDGE:
            out[i] = int(b > 0.5)
            if mass <= _EDGE or mass >= 1 - _EDGE:
                out[held], held = int(mass > 0.5), -1
        else:
            out[held] = int(mass > 0.5)
            held, mass = i, b
    if held >= 0:
        out[held] = -1
    return out, (mass if held >= 0 else -1.0)


def _level(seed: int):
    def f(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable")
        taken, mass = pivotal(group["doc_id"].tolist(), group["p"].tolist(), group["size"].tolist(), seed)
        group["taken"] = np.array(taken, np.int32)
        group["p"] = np.where(group["taken"] < 0, mass, group["p"])
        return group[["doc_id", "rank", "leaf", "size", "h", "p", "taken"]]

    return f


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, source, size. Returns the targets and (doc_id, rank, n_copies).

    Rows that repeat a doc_id within a source are one document with one decision. Depends on doc_id, source and size
    only, not on partitions or row order, so reruns agree.
    """
    goal = written(targets(rows, weights, most), "targets")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        units.join(goal, units["source"].eqNullSafe(goal["source"]))
        .select("doc_id", "rank", "size", "n", ratio.alias("r"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))
        .withColumn("whole", F.floor(F.col("r") + _EDGE).cast("int"))
        .withColumn("p", F.greatest(F.col("r") - F.col("whole"), F.lit(0.0)))
        .withColumn("leaf", F.pmod(F.col("h"), F.ceil(F.col("n") / LEAF).cast("long")).cast("int"))
    )
    units = written(units.select("doc_id", "rank", "leaf", "size", "h", "p", "whole"), "mixing")
    leaves = (units.agg(F.max("leaf")).first()[0] or 0) + 1
    shape = "doc_id long, rank int, leaf int, size long, h long, p double, taken int"
    level = written(units.drop("whole").groupBy("rank", "leaf").applyInPandas(_level(seed), shape), "mixing")
    decided = level.where("taken >= 0").select("doc_id", "rank", "taken")
    while leaves > 1:
        leaves = -(-leaves // FAN)
        rest = level.where("taken < 0").withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int")).drop("taken")
        level = written(rest.groupBy("rank", "leaf").applyInPandas(_level(seed), shape), "mixing")
        decided = decided.union(level.where("taken >= 0").select("doc_id", "rank", "taken"))
    last = level.where("taken < 0").select("doc_id", "rank", (F.col("p") >= 0.5).cast("int").alias("taken"))
    out = units.join(decided.union(last), ["doc_id", "rank"]).select("doc_id", "rank", (F.col("whole") + F.col("taken")).alias("n_copies"))
    return goal, out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, n_copies, taken = n_copies * size.

    Null sources are one source, the last. Rows without a doc_id are left out. Empty documents have size 0, count as
    documents and can be taken. An empty table gives an empty result.
    """
    rows = written(sizes(docs), "sizes")
    goal, chosen = copies(rows, weights, most, seed)
    ranked = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select(rows["doc_id"], rows["source"], "rank", "size", "source_size", "target")
    return ranked.join(chosen, ["doc_id", "rank"]).select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept."""
    chosen = mix(docs.select("doc_id", "text", "source"), **how).where("n_copies > 0").select("doc_id", "source", "n_copies").distinct()
    both = docs.join(chosen, (docs["doc_id"].cast("long") == chosen["doc_id"]) & docs["source"].cast("string").eqNullSafe(chosen["source"]))
    times = F.explode(F.sequence(F.lit(1), chosen["n_copies"])).alias("_plumbline_copy")
    return both.select(*[docs[c] for c in docs.columns], times).drop("_plumbline_copy")
