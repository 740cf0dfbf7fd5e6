"""Rewriting requests against a content-addressed cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.sources.config import Config


def with_ids(jobs: DataFrame, config: Config, text: str = "text", mode: str = "mode") -> DataFrame:
    return jobs.withColumn("cache_id", T.content_id(config.backend, config.model, F.col(mode), F.col(text)))


def hits(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs with the cached text and model, null where there is none."""
    return jobs.join(cache.select("cache_id", F.col("text").alias("cached_text"), F.col("model").alias("cached_model")), "cache_id", "left")


def misses(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    return jobs.join(cache, "cache_id", "left_anti")


def build_batch(jobs: DataFrame, cache: DataFrame, config: Config, system: str) -> tuple[DataFrame, DataFrame]:
    """Request lines, one for each different job without a cache entry, and the sidecar (custom_id, mode, source)."""
    if config.backend != "openai":
        raise ValueError("batches need the backend 'openai'")
    fresh = misses(with_ids(jobs, config), cache).dropDuplicates(["cache_id"])
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(config.model).alias("model"), F.lit(config.temperature).alias("temperature"), F.array(said("system", F.lit(system)), said("user", T.rewrite_prompt(F.col("mode"), F.col("text"), config.banned))).alias("messages"))
    lines = fresh.select(F.col("cache_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return lines, fresh.select(F.col("cache_id").alias("custom_id"), "mode", F.col("text").alias("source"))


def content(response: Column) -> Column:
    """The answer of a response; null unless its status is 200."""
    return F.when(response["status_code"] == 200, F.trim(F.get(response["body"]["choices"], F.lit(0))["message"]["content"]))


def collected(responses: DataFrame, sidecar: DataFrame, config: Config) -> DataFrame:
    """Cache rows of the responses that the sidecar knows: (cache_id, text, model, fallback, error). An answer that is missing,
    empty or leaks falls back to its source."""
    both = responses.join(sidecar, "custom_id").withColumn("_c", content(F.col("response")))
    leak = (F.col("mode") == "implicit") & (F.size(T.lexicon_hits(F.coalesce("_c", F.lit("")), config.banned)) > 0)
    good = F.coalesce((F.col("_c") != "") & ~leak, F.lit(False))
    return both.select(
        F.col("custom_id").alias("cache_id"),
        F.when(good, F.col("_c")).otherwise(F.col("source")).alias("text"),
        F.when(good, F.lit(config.model)).otherwise(F.lit("template-only")).alias("model"),
        (~good).alias("fallback"),
        F.col("_c").isNull().alias("error"),
    )


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("cached"), F.count_if("fallback").alias("fallbacks"), F.count_if("error").alias("errors"))
