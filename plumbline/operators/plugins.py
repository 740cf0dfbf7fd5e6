"""Models behind the pipeline as pluggable functions, with offline stand-ins that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import token_count
from plumbline.sources.config import TIERS, Config
from plumbline.sources.package import ship


class Rewriter(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Classifier(Protocol):
    def __call__(self, text: str) -> str: ...


class Scorer(Protocol):
    def __call__(self, prompts: list[str]) -> list[list[float]]: ...


class BatchService(Protocol):
    """An asynchronous batch of requests at a model's provider. ``output(batch_id)``, if there is one, gives the path of the answers that are finished, or None."""

    def submit(self, input_path: str) -> str: ...

    def status(self, batch_id: str) -> str: ...


#: States that a batch doesn't leave.
TERMINAL = ("completed", "failed", "expired", "cancelled")


def awaited(service: BatchService, batch_id: str, interval: float = 60.0) -> str:
    """Asks for a batch's state until it is terminal."""
    while (state := service.status(batch_id)) not in TERMINAL:
        time.sleep(interval)
    return state


def token_counts(text: Column, tokenizer: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text by a tokenizer, or by white space."""
    if tokenizer is None:
        return token_count(text)

    @F.pandas_udf("int")
    def counted(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else tokenizer(x)).astype("Int32")

    return counted(text)


def round_trip(rows: DataFrame, config: Config, classifier: Classifier, key: str = "vignette_id") -> DataFrame:
    """n and accuracy of a classifier on a bounded sample: an answer counts if it holds the tier; a failed call counts as wrong."""
    ship(rows.sparkSession)
    sample = rows.orderBy(F.xxhash64(F.lit(config.seed), F.col(key)), key).limit(config.roundtrip_sample).select("text", "tier")

    def guess(text: str) -> str:
        try:
            return classifier(text).strip().lower()
        except Exception:
            return ""

    @F.pandas_udf("string")
    def asked(text: pd.Series) -> pd.Series:
        return text.map(guess)

    ok = F.contains(asked("text"), F.col("tier"))
    return sample.select(ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("accuracy"))


def stub_classifier(text: str) -> str:
    """A stand-in: the tier that a hash of the text picks."""
    return TIERS[sum(text.encode()) % len(TIERS)]


def stub_scorer(prompts: list[str], vocabulary: int = 7) -> list[list[float]]:
    """A stand-in: logits from character sums."""
    return [[float((sum(p.encode()) * (k + 3)) % 17) for k in range(vocabulary)] for p in prompts]


def prompt_scores(units: DataFrame, scorer: Scorer, batch_size: int = 32) -> DataFrame:
    """units (with user_msg) with their logits, scored in batches of prompts of like length."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k in range(0, len(pdf), batch_size):
                out += scorer(pdf["user_msg"].iloc[k : k + batch_size].tolist())
            yield pdf.assign(logits=out)

    ship(units.sparkSession)
    fields = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)
    return units.sortWithinPartitions(F.length("user_msg")).mapInPandas(f, f"{fields}, logits array<double>")
