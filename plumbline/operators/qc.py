"""Quality checks of vignettes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.plugins import token_counts
from plumbline.operators.similarity import duplicated
from plumbline.sources.config import Config
from plumbline.sources.stored import written


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def mean_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share)."""
    g = group_counts(df, group)
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def balance(df: DataFrame, group: str, k: int, tol: float) -> DataFrame:
    """One row: whether each share is within tol of 1 / k; true without rows."""
    return shares(df, group).agg(F.coalesce(F.bool_and(F.abs(F.col("share") - 1.0 / k) <= tol), F.lit(True)).alias("balanced"))


def length_match(df: DataFrame, group: str, length: Column, tol: float) -> DataFrame:
    """One row: the least and largest group mean of a length, and whether they differ by at most tol of the largest."""
    means = df.groupBy(group).agg(F.avg(length.cast("double")).alias("m")).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    spread = (F.col("hi") - F.col("lo")) / F.when(F.col("hi") == 0, 1.0).otherwise(F.col("hi"))
    return means.select("lo", "hi", F.coalesce(spread <= tol, F.lit(True)).alias("matched"))


def tenure(rows: DataFrame, profiles: DataFrame, young: int = T.YOUNG, pattern: str = T.TENURE) -> DataFrame:
    """(vignette_id, age, snippet): young clients who tell of a long past of investing, or of what ``pattern`` finds. Rows without a profile are dropped;
    a profile without an age isn't young; of several profiles of an id the least age counts."""
    p = profiles.groupBy("profile_id").agg(F.coalesce(F.min("age"), F.lit(99)).alias("age"))
    hits = rows.where(F.col("text").rlike(pattern)).join(p, "profile_id").where(F.col("age") <= young)
    return hits.select("vignette_id", "age", T.snippet(F.col("text"), pattern).alias("snippet"))


def measured(vignettes: DataFrame, config: Config, tokens: Column | None = None) -> DataFrame:
    """(check, part, n, value), all that one scan of the texts tells: ``count`` by bucket; of twins ``share`` and ``balanced`` by tier, ``mean_tokens`` by type
    and ``matched``; ``leaks`` of implicit texts. n is the rows that a value is of. Texts are looked at once; what leaves the scan is a row for each (bucket, type,
    tier) of a task. A null tier or type is a part of its own, as null.

    tokens: the length of ``text``, white space tokens unless given.
    """
    twin, leak = F.col("pair_id").isNull(), (F.col("vignette_type") == "implicit") & (F.size(T.lexicon_hits(F.col("text"), config.banned)) > 0)
    rows = vignettes.select(F.when(twin, F.col("vignette_type")).otherwise("pairs").alias("bucket"), "vignette_type", "tier", twin.alias("twin"), (T.token_count(F.col("text")) if tokens is None else tokens).cast("double").alias("tokens"), leak.alias("leak"))
    cube = rows.groupBy("bucket", "vignette_type", "tier", "twin").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("counted"), F.count_if("leak").alias("leaks"))
    # what follows is of the few rows of the cube; each of its rows goes to the checks that it has a part in
    parts = F.array(
        F.struct(F.lit("count").alias("check"), F.col("bucket").alias("part"), F.lit(None).cast("double").alias("value")),
        F.struct(F.lit("leaks").alias("check"), F.lit("implicit").alias("part"), F.col("leaks").cast("double").alias("value")),
        F.when(F.col("twin"), F.struct(F.lit("share").alias("check"), F.col("tier").alias("part"), F.lit(None).cast("double").alias("value"))),
        F.when(F.col("twin"), F.struct(F.lit("mean_tokens").alias("check"), F.col("vignette_type").alias("part"), F.col("tokens").alias("value"))),
    )
    each = cube.select("n", "counted", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).groupBy("x.check", "x.part").agg(F.sum("n").alias("n"), F.sum("x.value").alias("value"), F.sum("counted").alias("_c"))
    value = F.when(F.col("check") == "count", F.col("n").cast("double")).when(F.col("check") == "share", F.col("n") / F.sum("n").over(Window.partitionBy("check"))).when(F.col("check") == "mean_tokens", F.try_divide("value", "_c")).otherwise(F.col("value"))
    each = each.select("check", "part", "n", value.alias("value"))
    of = lambda name, x: F.when(F.col("check") == name, x)
    low, high = F.min(of("mean_tokens", F.col("value"))), F.max(of("mean_tokens", F.col("value")))
    far = F.max(of("share", F.abs(F.col("value") - 1 / 3)))
    ok = each.agg(
        F.coalesce(F.sum(of("share", F.col("n"))), F.lit(0)).alias("n"), F.coalesce(far <= config.tier_balance_tol, F.lit(True)).alias("balanced"),
        F.coalesce((high - low) / F.when(high == 0, 1.0).otherwise(high) <= config.token_len_tol, F.lit(True)).alias("matched"),
    )
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in ("balanced", "matched")]))
    return each.unionByName(ok.select("n", both.alias("x")).select("x.check", F.lit(None).cast("string").alias("part"), "n", "x.value"))


def flagged(vignettes: DataFrame, profiles: DataFrame | None, config: Config, young: int = T.YOUNG) -> DataFrame:
    """(kind, vignette_id, hits, age, snippet) of the rows that a report shows examples of, from one scan: ``leak`` and, with profiles, ``tenure``, as tenure() finds them."""
    hits = F.when(F.col("vignette_type") == "implicit", T.lexicon_hits(F.col("text"), config.banned))
    rows = vignettes.select("vignette_id", "profile_id", hits.alias("hits"), F.when(F.col("text").rlike(T.TENURE), T.snippet(F.col("text"), T.TENURE)).alias("snippet"))
    none = F.array().cast("array<string>")
    leak = F.when(F.size("hits") > 0, F.struct(F.lit("leak").alias("kind"), F.col("hits"), F.lit(None).cast("string").alias("snippet")))
    long_ = F.when(F.col("snippet").isNotNull(), F.struct(F.lit("tenure").alias("kind"), none.alias("hits"), F.col("snippet")))
    rows = rows.select("vignette_id", "profile_id", F.explode(F.filter(F.array(leak, long_) if profiles is not None else F.array(leak), lambda x: x.isNotNull())).alias("x"))
    rows = rows.select("x.kind", "vignette_id", F.when(F.col("x.kind") == "tenure", F.col("profile_id")).otherwise("vignette_id").alias("profile_id"), "x.hits", "x.snippet")  # leaks spread by their own id
    if profiles is None:
        return rows.select("kind", "vignette_id", "hits", F.lit(None).cast("int").alias("age"), "snippet")
    p = profiles.groupBy("profile_id").agg(F.coalesce(F.min("age"), F.lit(99)).alias("age"))
    rows = rows.join(p, "profile_id", "left").where((F.col("kind") == "leak") | (F.col("age") <= young))
    return rows.select("kind", "vignette_id", "hits", "age", "snippet")


def examples(rows: DataFrame, most: int = 10) -> DataFrame:
    """flagged() rows numbered by kind: the first ones of each, with the kind's number of rows (n). Only the first of each task are shuffled."""
    n = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("vignette_id"))).where(F.col("i") <= most)
    return first.join(F.broadcast(n), "kind")  # a row a kind


def report(vignettes: DataFrame, profiles: DataFrame | None, config: Config, tokenizer: Callable[[str], int] | None = None) -> dict:
    """All checks: counts, leaks (the only hard one), balance, token length, near-duplicates, coherence, with up to 10 examples. Two scans of the texts, and
    what near-duplicates take."""
    tokens = None if tokenizer is None else token_counts(F.col("text"), tokenizer)
    got: dict[str, dict] = {}
    for r in measured(vignettes, config, tokens).collect():  # a row for each bucket, tier and type
        got.setdefault(r["check"], {})[r["part"]] = r
    found: dict[str, list] = {"leak": [], "tenure": []}
    for r in examples(written(flagged(vignettes, profiles, config), "flagged")).orderBy("kind", "i").collect():
        found[r["kind"]].append(r)
    value = lambda check, part=None: r["value"] if (r := got.get(check, {}).get(part)) else None
    means = [r["value"] for r in got.get("mean_tokens", {}).values() if r["value"] is not None]
    n = {k: rows[0]["n"] if rows else 0 for k, rows in found.items()}
    dup = duplicated(vignettes.where(F.col("pair_id").isNull()), "vignette_id", "text").agg(mean_or_zero(F.col("is_dup").cast("double")).alias("f")).first()["f"]
    out = {
        "counts": {k: int(value("count", k) or 0) for k in ("explicit", "implicit", "pairs")},
        "banned_leaks": {"count": n["leak"], "examples": [{"vignette_id": r["vignette_id"], "hits": r["hits"]} for r in found["leak"]]},
        "tier_balance": {"shares": {k: r["value"] for k, r in got.get("share", {}).items()}, "expected": 1 / 3, "tol": config.tier_balance_tol, "pass": bool(value("balanced"))},
        "token_length": {"tokenizer": "whitespace" if tokenizer is None else getattr(tokenizer, "__name__", type(tokenizer).__name__), "lo": min(means, default=None), "hi": max(means, default=None), "tol": config.token_len_tol, "pass": bool(value("matched"))},
        "duplicates": {"method": "exact", "fraction": dup, "max": config.dup_fraction_max, "pass": dup < config.dup_fraction_max},
        "age_experience_coherence": {"skipped": "no profiles"},
        "hard_fail": n["leak"] > 0,
    }
    if profiles is not None:
        shown = [{k: r[k] for k in ("vignette_id", "age", "snippet")} for r in found["tenure"]]
        out["age_experience_coherence"] = {"count": n["tenure"], "examples": shown, "young_age_max": T.YOUNG, "pass": n["tenure"] == 0}
    return out
