"""JSON Lines and JSON reports: explicit schemas on read, nulls written out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names and types of the data sets.
PROFILE = (
    "profile_id string, past_drawdown_reaction string, horizon_years int, investing_experience string, income_stability string, stated_goal string, "
    "emergency_fund_months int, dependents int, age int, net_worth_band string, occupation string, hobbies string, city string, name string, "
    "gender_hint string, risk_score double, tier string"
)
EDGE_PROFILE = PROFILE + ", edge_bucket string"
VIGNETTE = (
    "vignette_id string, profile_id string, pair_id string, tier string, risk_score double, vignette_type string, template_id string, "
    "contradictory boolean, paraphrase_model string, banned_terms_found array<string>, text string"
)
RESULT = (
    "vignette_id string, profile_id string, pair_id string, vignette_type string, tier string, risk_score double, contradictory boolean, "
    "condition string, p_alloc array<double>, aggressiveness double, p_letters double, hedged boolean"
)
RESPONSE = "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string>>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A JSON Lines file or folder. A missing path is an error, or an empty table if missing_ok."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_union(spark: SparkSession, folder: str, names: tuple[str, ...] = ("explicit", "implicit", "pairs"), schema: str = VIGNETTE) -> DataFrame:
    """The union of a folder's files; missing ones are skipped. ``source`` and ``source_order`` tell where a row is from."""
    out = spark.createDataFrame([], schema).withColumn("source", F.lit("")).withColumn("source_order", F.lit(0))
    for i, name in enumerate(names):
        path = f"{folder}/{name}.jsonl"
        if exists(spark, path):
            out = out.unionByName(read(spark, path, schema).withColumn("source", F.lit(name)).withColumn("source_order", F.lit(i)))
    return out


def write(df: DataFrame, path: str) -> None:
    """Overwrites; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def bucket():
    """Where a vignette is written: pairs if it is of a pair, else by its type."""
    return F.when(F.col("pair_id").isNotNull(), F.lit("pairs")).otherwise(F.col("vignette_type"))


def write_buckets(df: DataFrame, folder: str, names: tuple[str, ...] = ("explicit", "implicit", "pairs")) -> None:
    """One folder ``<bucket>.jsonl`` for each bucket; buckets without rows are made empty, rows of none of them are left out. df is computed once: a single
    partitioned write, whose folders take the place of the old ones by renaming when the job is over, so a job that fails leaves the old ones."""
    spark = df.sparkSession
    at = f"{folder.rstrip('/')}/_buckets-{uuid.uuid4().hex}"  # hidden from readers of the folder
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows = df.withColumn("_bucket", bucket()).where(F.col("_bucket").isin(*names))
        rows.write.option("ignoreNullFields", "false").partitionBy("_bucket").json(at)
        for name in names:
            new, old = jvm.Path(f"{at}/_bucket={name}"), jvm.Path(f"{folder.rstrip('/')}/{name}.jsonl")
            if not fs.exists(new):
                fs.mkdirs(new)
            fs.create(jvm.Path(f"{at}/_bucket={name}/_SUCCESS"), True).close()
            fs.delete(old, True)
            if not fs.rename(new, old):
                raise OSError(f"{old} couldn't be replaced")
    finally:
        fs.delete(jvm.Path(at), True)


def report_name(folder: str) -> str:
    """The report's file name for a vignettes folder: what follows ``vignettes_`` is its tag."""
    import re

    tag = re.sub(r"^vignettes_?", "", folder.rstrip("/").rsplit("/", 1)[-1])
    return f"qc_report_{tag}.json" if tag else "qc_report.json"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file to whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    import json

    put_text(spark, path, json.dumps(report, indent=2, default=str))
