"""Synthetic profiles. Draws are hashes of (seed, index, field): the same at any parallelism, equally distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.rubric import score, tier
from plumbline.functions.text import drawn, pick
from plumbline.operators.sampling import numbered
from plumbline.sources.config import TIERS, Rubric
from plumbline.sources.stored import written

#: Filler that must not sway a score.
NET_WORTH = ("under_100k", "100k_to_500k", "500k_to_2m", "over_2m")
OCCUPATIONS = ("high school teacher", "registered nurse", "software engineer", "small business owner", "graphic designer", "electrician", "accountant", "marketing manager", "warehouse supervisor", "freelance writer")
HOBBIES = ("hiking", "cooking", "woodworking", "gardening", "playing guitar", "running", "painting", "board games", "photography", "fishing")
CITIES = ("Columbus", "Denver", "Austin", "Pittsburgh", "Sacramento", "Tampa", "Minneapolis", "Charlotte", "Albuquerque", "Portland")
NAMES = (("Maria Lopez", "female"), ("James Carter", "male"), ("Wei Zhang", "neutral"), ("Aisha Khan", "female"), ("David Kim", "male"), ("Sofia Rossi", "female"), ("Marcus Johnson", "male"), ("Priya Patel", "female"), ("Liam O'Brien", "male"), ("Emma Nguyen", "female"), ("Noah Thompson", "male"), ("Olivia Brooks", "female"))
#: The ends of the rubric.
ALL_LOW = {"past_drawdown_reaction": "sold_everything", "horizon_years": 1, "investing_experience": "none", "income_stability": "precarious", "stated_goal": "capital_preservation", "emergency_fund_months": 0, "dependents": 4, "age": 75}
ALL_HIGH = {"past_drawdown_reaction": "bought_more", "horizon_years": 35, "investing_experience": "extensive", "income_stability": "stable", "stated_goal": "maximum_growth", "emergency_fund_months": 24, "dependents": 0, "age": 23}
CONFLICTS = ({"stated_goal": "maximum_growth", "past_drawdown_reaction": "sold_everything"}, {"stated_goal": "capital_preservation", "past_drawdown_reaction": "bought_more"})


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def rubric_draw(rubric: Rubric, seed: int, *key: Column) -> list[Column]:
    """A uniform draw of each rubric field."""
    out = []
    for f in rubric.fields:
        h = (F.lit(seed), F.lit(f.name), *key)
        if f.levels is not None:
            out.append(pick(strings(f.levels), *h).alias(f.name))
        else:
            lo, hi = map(int, f.range)
            out.append((drawn(hi - lo + 1, *h) + lo).alias(f.name))
    return out


def filler_draw(seed: int, *key: Column) -> list[Column]:
    """A uniform draw of each filler field; a name comes with its gender hint."""
    who = pick(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("gender_hint")) for n, g in NAMES]), F.lit(seed), F.lit("name"), *key)
    pools = {"net_worth_band": NET_WORTH, "occupation": OCCUPATIONS, "hobbies": HOBBIES, "city": CITIES}
    return [*[pick(strings(v), F.lit(seed), F.lit(k), *key).alias(k) for k, v in pools.items()], who["name"].alias("name"), who["gender_hint"].alias("gender_hint")]


def scored(df: DataFrame, rubric: Rubric) -> DataFrame:
    """risk_score, rounded to 2 places, and the tier of the score before rounding."""
    df = df.withColumn("_s", score(rubric))
    return df.withColumn("risk_score", F.round("_s", 2)).withColumn("tier", tier(F.col("_s"), rubric)).drop("_s")


def spread(ids: DataFrame) -> DataFrame:
    """ids over as many tasks as the session's shuffles have: a number is few bytes but much work, and Spark cuts tables into tasks by bytes."""
    return ids.select("id").repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drawn_profiles(ids: DataFrame, rubric: Rubric, seed: int) -> DataFrame:
    """A profile for each row of ids (a number ``id``), with it as ``draw``."""
    i = F.col("id")
    rows = spread(ids).select("id", F.format_string("p%05d", i).alias("profile_id"), *rubric_draw(rubric, seed, i), *filler_draw(seed, i))
    return scored(rows, rubric).withColumnRenamed("id", "draw")


def profiles(spark: SparkSession, rubric: Rubric, n: int, seed: int, first: int = 0) -> DataFrame:
    """n draws from index ``first`` on."""
    return drawn_profiles(spark.range(first, first + n), rubric, seed)


def first_n_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def balanced_profiles(spark: SparkSession, rubric: Rubric, n_per_tier: int, seed: int) -> tuple[DataFrame, int]:
    """The first n_per_tier draws of each tier, and how many draws that took. The range of draws doubles until no tier is short."""
    n = max(64, 12 * n_per_tier)
    while True:
        kept = first_n_per_group(profiles(spark, rubric, n, seed), "tier", "draw", n_per_tier)
        found = {r["tier"]: r for r in kept.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("draw").alias("last")).collect()}
        if n_per_tier == 0 or all(t in found and found[t]["n"] >= n_per_tier for t in TIERS):
            return kept, 1 + max((r["last"] for r in found.values()), default=-1)
        n *= 2


def in_windows(s: Column, windows) -> Column:
    """Whether a score is in one of the windows, ends included."""
    out = F.lit(False)
    for lo, hi in windows:
        out = out | s.between(lo, hi)
    return out


def borderline(spark: SparkSession, rubric: Rubric, windows, n: int, seed: int, pool: int = 4000) -> DataFrame:
    """The first n draws whose score is within a window."""
    while True:
        draw = spark.range(pool).select("id", *rubric_draw(rubric, seed, F.col("id"))).where(in_windows(score(rubric), windows))
        got = draw.orderBy("id").limit(n)
        if got.count() >= n:
            return got.drop("id")
        pool *= 2


def edge_fields(spark: SparkSession, rubric: Rubric, seed: int) -> DataFrame:
    """Rubric fields of the 60 hard cases with their bucket and number."""
    names = [f.name for f in rubric.fields]

    def some(n: int, salt: int, fixed: dict) -> DataFrame:
        d = spark.range(n).select(*rubric_draw(rubric, seed + salt, F.col("id")))
        return d.select(*[F.lit(fixed[k]).cast(d.schema[k].dataType).alias(k) if k in fixed else F.col(k) for k in names])

    parts = [borderline(spark, rubric, [(38, 42)], 10, seed + 1).withColumn("edge_bucket", F.lit("borderline")), borderline(spark, rubric, [(68, 72)], 10, seed + 2).withColumn("edge_bucket", F.lit("borderline"))]
    parts += [some(6, 3 + i, c).withColumn("edge_bucket", F.lit("contradiction")) for i, c in enumerate(CONFLICTS)]
    parts += [some(2, 10 + 2 * i + j, {"age": a, "horizon_years": h}).withColumn("edge_bucket", F.lit("extreme_demo")) for i, a in enumerate((23, 75)) for j, h in enumerate((1, 35))]
    parts += [some(10, 20, ALL_LOW).withColumn("edge_bucket", F.lit("anchor_conservative")), some(10, 21, ALL_HIGH).withColumn("edge_bucket", F.lit("anchor_aggressive"))]
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("item", F.lit(100 * k) + F.row_number().over(Window.partitionBy("edge_bucket").orderBy(F.xxhash64(*names), *names)))
        out = p if out is None else out.unionByName(p)
    return out


def round_robin(df: DataFrame, order: list, pools: dict[str, tuple], pos: str = "pos") -> DataFrame:
    """Numbers the rows in an order from 0 on and deals each pool's values out in turn."""
    df = numbered(df, *order, name=pos).withColumn(pos, F.col(pos).cast("int"))
    for name, values in pools.items():
        df = df.withColumn(name, F.get(strings(values), F.pmod(F.col(pos), F.lit(len(values))).cast("int")))
    return df


def edge_profiles(spark: SparkSession, rubric: Rubric, seed: int) -> DataFrame:
    """The hard cases as profiles; every occupation, city and hobby is there."""
    pools = {"net_worth_band": NET_WORTH, "occupation": OCCUPATIONS, "hobbies": HOBBIES, "city": CITIES, "name": tuple(n for n, _ in NAMES), "gender_hint": tuple(g for _, g in NAMES)}
    dealt = round_robin(edge_fields(spark, rubric, seed), [F.xxhash64(F.lit(seed), "item", "edge_bucket"), F.col("item")], pools)
    return scored(dealt.withColumn("profile_id", F.format_string("e%05d", "pos")), rubric).drop("pos", "item")


def tier_draws(rubric: Rubric, keys: DataFrame, tier_col: str, seed: int, tries: int = 2000) -> DataFrame:
    """For each row of keys (key, and a wanted tier) the first of ``tries`` draws of that tier; an error if there is none. Draws are made in
    rounds, each for the keys that found none before and twice as many as the last, so a common tier costs a few draws."""
    names, out, left, at, size = [f.name for f in rubric.fields], None, keys, 0, 8
    while at < tries:
        size = min(size, tries - at)
        d = left.withColumn("_t", F.explode(F.sequence(F.lit(at), F.lit(at + size - 1))))
        d = d.select("*", *rubric_draw(rubric, seed, F.col("key"), F.col("_t"))).withColumn("_s", score(rubric))
        hit = F.when(tier(F.col("_s"), rubric) == F.col(tier_col), F.struct("_t", "_s", *names))
        best = written(d.groupBy(*keys.columns).agg(F.min(hit).alias("_b")), "draws")
        found = best.where("_b is not null").select(*keys.columns, *[F.col(f"_b.{n}").alias(n) for n in names], F.col("_b._s").alias("_s"))
        out = found if out is None else out.unionByName(found)
        left, at, size = best.where("_b is null").select(*keys.columns), at + size, 2 * size
        if left.isEmpty():
            return out
    missing = left.first()
    raise ValueError(f"no draw of tier {missing[tier_col]} for {missing['key']}")
