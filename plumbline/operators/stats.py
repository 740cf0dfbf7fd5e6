"""Statistics of the gate: rank correlation, bootstrap, signed ranks, paired deltas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.package import ship


def bounds(df: DataFrame, *columns: str) -> dict[str, list[float]]:
    """Values that cut each column into ranges of about as many rows, of all groups together: one pass over sketches that merge, and a few numbers a range to the
    driver."""
    pieces = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / pieces for i in range(1, pieces)]
    row = df.agg(*[F.percentile_approx(c, shares, 20 * pieces) for c in columns]).first()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}


def _range(v: Column, cuts: list[float], first: int = 0) -> Column:
    """How many cuts are at most v, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(v < F.lit(cuts[mid]), _range(v, cuts[:mid], first)).otherwise(_range(v, cuts[mid + 1 :], first + mid + 1))


def ranks(df: DataFrame, value: str, *by: str, name: str = "rank", cuts: list[float] | None = None) -> DataFrame:
    """(by..., value, rank, rank_ties, rank_of): the rank of each different value within ``by``, the mean of the ranks of equal ones, how
    many they are and how many rows the group has.

    Equal values are counted first, then summed up within ranges of the values (``cuts``, or bounds() of df), and each range's total is added to those after
    it: no group's rows meet in one task. Cuts are numbers, so both uses of the counts see the same ranges and nothing is written. A null value has no rank.
    """
    cuts = bounds(df, value)[value] if cuts is None else cuts
    part = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", _range(F.col(value), cuts))
    total = part.groupBy("_p", *by).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*by or [F.lit(0)])
    before = total.select("_p", *by, (F.sum("_s").over(group.orderBy("_p")) - F.col("_s")).alias("_b"), F.sum("_s").over(group).alias(f"{name}_of"))
    upto = F.sum("_n").over(Window.partitionBy("_p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = part.withColumn("_c", upto).join(before, ["_p", *by])
    return placed.select(*by, value, (F.col("_b") + F.col("_c") - (F.col("_n") - 1) / F.lit(2.0)).alias(name), F.col("_n").alias(f"{name}_ties"), f"{name}_of")


def _both_ranked(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rows with both values and their ranks _x and _y; the bounds of both come from one pass."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
    cuts = bounds(rows, "_vx", "_vy")
    for v, name in (("_vx", "_x"), ("_vy", "_y")):
        rows = rows.join(ranks(rows.select(*by, v), v, *by, name=name, cuts=cuts[v]), [*by, v])
    return rows


def spearman(df: DataFrame, x: str, y: str, *by: str, least: int = 10) -> DataFrame:
    """(by..., rho, n) for groups of at least ``least`` rows in which neither value is constant."""
    ranked = _both_ranked(df, x, y, *by)
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("_c"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    return g.where((F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0)).select(*by, F.try_divide("_c", F.col("_sx") * F.col("_sy")).alias("rho"), "n")


def _resampled_rho(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> float | None:
    """The rank correlation of rows (numbers of their values in order) taken so many times; None if a side is constant."""
    middle = (count.sum() + 1) / 2

    def ranks(code: np.ndarray) -> np.ndarray:
        n = np.bincount(code, count)
        return (np.cumsum(n) - (n - 1) / 2)[code] - middle

    x, y = ranks(a), ranks(b)
    xx, yy = float(count @ (x * x)), float(count @ (y * y))
    return float(count @ (x * y)) / (xx * yy) ** 0.5 if xx > 0 and yy > 0 else None


def mixed32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads their bits."""
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(times)  # products wrap
    return x ^ (x >> np.uint32(16))


def poisson_limits(mean: int) -> tuple[int, np.ndarray]:
    """(first, limits) for draws of a Poisson number from 32 random bits u: it is first plus how many limits are at most u."""
    spread = 12 * math.sqrt(mean) + 20
    first = max(0, int(mean - spread))
    p = np.array([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(first, int(mean + spread))])
    limits = np.floor(np.cumsum(p) * 2.0**32)
    return first, limits[limits < 2**32].astype(np.uint32)


def poisson(u: np.ndarray, first: int, limits: np.ndarray) -> np.ndarray:
    if len(limits) > 40:
        return first + np.searchsorted(limits, u, "right")
    out = np.full(len(u), float(first), np.float32)
    for x in limits:
        out += u >= x
    return out


def bootstrap_spearman(df: DataFrame, x: str, y: str, by: str, n_boot: int = 2000, seed: int = 42, blocks: int = 20, bins: int = 1024) -> DataFrame:
    """(by, ci_low, ci_high): the 2.5 and 97.5 percentiles of the correlation over resamples; constant resamples are skipped.

    Rows are counted in cells of (range of x, range of y), ``bins`` ranges of equal rank shares a side, so a group is at most bins^2 counts however many rows it has.
    Values of one range count as tied: groups of up to ``bins`` rows are exact, larger ones differ by about 1 / bins^2 of the correlation (less than 0.000005). A resample takes
    each row a Poisson(1) number of times, so a cell of c rows a Poisson(c) number, drawn from a hash of (seed, replicate, cell): draws need no
    generator and don't depend on partitions. Resamples are dealt to blocks; a task holds one block of one group's counts.
    """
    ship(df.sparkSession)
    ranked = _both_ranked(df.select(F.col(by).alias("_g"), F.col(x).cast("double").alias("_a"), F.col(y).cast("double").alias("_z")), "_a", "_z", "_g")
    cut = lambda c: F.floor((F.col(c) - (F.col(f"{c}_ties") + 1) / 2) * bins / F.col(f"{c}_of")).cast("int")
    cells = ranked.select(F.col("_g").alias("g"), cut("_x").alias("a"), cut("_y").alias("b")).groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    spread = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        a, b, n, k = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy(), int(pdf["block"].iloc[0])
        of_cell = mixed32((a.astype(np.int64) * bins + b).astype(np.uint32) ^ mixed32(np.array([seed], np.uint32)))
        a, b = (np.unique(v, return_inverse=True)[1] for v in (a, b))
        sizes, starts = np.unique(n, return_index=True)
        draws = [(lo, hi, *poisson_limits(int(c))) for c, lo, hi in zip(sizes, starts, [*starts[1:], len(n)], strict=True)]
        count, out = np.zeros(len(n)), []
        for r in range(k, n_boot, blocks):
            u = mixed32(of_cell ^ mixed32(np.array([r + 1], np.uint32)))
            for lo, hi, first, limits in draws:
                count[lo:hi] = poisson(u[lo:hi], first, limits)
            rho = _resampled_rho(a, b, count)
            if rho is not None:
                out.append(rho)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(out), "rho": out})

    rho = spread.groupBy("g", "block").applyInPandas(resampled, f"g {spread.schema['g'].dataType.simpleString()}, rho double")
    return rho.groupBy("g").agg(F.percentile("rho", F.lit(0.025)).alias("ci_low"), F.percentile("rho", F.lit(0.975)).alias("ci_high")).withColumnRenamed("g", by)


def signed_ranks(df: DataFrame, delta: str, *by: str) -> DataFrame:
    """(by..., n, w_plus, w_minus, ties): sums of the ranks of positive and negative deltas; zeros are left out. ties is the
    sum of t^3 - t over groups of equal size."""
    rows = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0)).select(*by, F.col(delta).alias("_d"), F.abs(delta).alias("_a"))
    rows = rows.join(ranks(rows, "_a", *by, name="_r"), [*by, "_a"]).withColumn("_t", F.col("_r_ties"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"),
        F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"),
    )


def wilcoxon_p_value(n: int, w_plus: float, w_minus: float, ties: float) -> float:
    """Two-sided. Exact up to 50 differences without ties, else normal with the correction for ties; NaN without differences."""
    if n == 0:
        return math.nan
    w = min(w_plus, w_minus)
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return math.nan
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def wilcoxon(df: DataFrame, delta: str, *by: str) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def p(n: pd.Series, a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p_value(*x) for x in zip(n, a, b, t, strict=True)])

    return signed_ranks(df, delta, *by).withColumn("p_value", p("n", "w_plus", "w_minus", "ties"))


def paired_deltas(df: DataFrame, key: str, condition: str, value: str, base: str = "baseline", other: str = "instruction") -> DataFrame:
    """(key, delta): each ``other`` row's value less its base row's. Of several base rows of a key the largest value counts
    (a fixed rule, where row order would decide otherwise); rows without a base row are dropped."""
    left = df.where(F.col(condition) == base).groupBy(key).agg(F.max(value).alias("_b"))
    return df.where(F.col(condition) == other).select(key, F.col(value).alias("_o")).join(left, key).select(key, (F.col("_o") - F.col("_b")).alias("delta"))


def order_statistics(df: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., q0, q1, ...): percentiles by linear interpolation, as ``percentile`` gives them, but read off ranks, so that no task
    holds a group's values."""
    r = ranks(df.where(F.col(value).isNotNull()), value, *by, name="_r")
    first, last = F.col("_r") - (F.col("_r_ties") + 1) / 2, F.col("_r") + (F.col("_r_ties") - 1) / 2 - 1  # places of a value, from 0
    placed = r.select(*by, value, first.alias("_a"), last.alias("_z"), F.col("_r_of").alias("_n"))
    out = []
    for k, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = (F.max(F.when((F.col("_a") <= e) & (e <= F.col("_z")), F.col(value))) for e in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"q{k}"))
    return placed.groupBy(*by).agg(*out)


def delta_summary(deltas: DataFrame, least: int = 10) -> DataFrame:
    """n_pairs, mean_delta and the 2.5 and 97.5 percentiles of the deltas themselves; no row below ``least``."""
    g = deltas.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("delta").alias("mean_delta")).where(F.col("n_pairs") >= least)
    q = order_statistics(deltas, "delta", (0.025, 0.975))
    return g.crossJoin(q).select("n_pairs", "mean_delta", F.col("q0").alias("ci_low"), F.col("q1").alias("ci_high"))  # two rows of one
