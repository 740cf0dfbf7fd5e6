"""Rewriting texts by a model: several calls at a time in each worker, and a cache that is written while the work goes on."""

from __future__ import annotations

import os
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import requests
from plumbline.sources.cache import Cache
from plumbline.sources.config import Config
from plumbline.sources.package import ship
from plumbline.sources.stored import written

#: The task of a rewriting model.
SYSTEM = "Rewrite the client's words naturally; keep every fact and add none."
#: Where each backend's key is looked for.
KEYS = {"openai": ("OPENAI_API_KEY",), "gemini": ("GEMINI_API_KEY", "GOOGLE_API_KEY")}


class HostedRewriter:
    """A rewriter at a provider, by its public Python client. The client is made with the first call of each process."""

    def __init__(self, backend: str, model: str, temperature: float = 0.7, system: str = SYSTEM) -> None:
        if backend not in KEYS:
            raise ValueError(f"unknown backend {backend!r}: {' or '.join(KEYS)}")
        self.backend, self.model, self.temperature, self.system = backend, model, temperature, system
        self._client = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def client(self):
        if self._client is None:
            key = next((os.environ[k] for k in KEYS[self.backend] if os.environ.get(k)), None)
            if key is None:
                raise RuntimeError(f"{KEYS[self.backend][0]} isn't set")
            if self.backend == "openai":
                import openai

                self._client = openai.OpenAI(api_key=key)
            else:
                import google.generativeai as genai

                genai.configure(api_key=key)
                self._client = genai.GenerativeModel(self.model, system_instruction=self.system)
        return self._client

    def __call__(self, prompt: str) -> str:
        client = self.client()
        if self.backend == "openai":
            said = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
            return client.chat.completions.create(model=self.model, temperature=self.temperature, messages=said).choices[0].message.content.strip()
        return client.generate_content(prompt, generation_config={"temperature": self.temperature}).text.strip()


class Pace:
    """Lets calls begin no closer than 1 / rate seconds; without a rate at once."""

    def __init__(self, rate: float | None) -> None:
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                at = self.next = max(now, self.next)
                self.next += self.gap
            time.sleep(max(0.0, at - now))


def in_order(f: Callable, items: Iterator, workers: int) -> Iterator:
    """f of each item in their order, by so many threads; at most twice as many items are under way or wait to be taken."""
    with ThreadPoolExecutor(workers) as pool:
        open_: deque[Future] = deque()
        try:
            for x in items:
                open_.append(pool.submit(f, x))
                if len(open_) >= 2 * workers:
                    yield open_.popleft().result()
            while open_:
                yield open_.popleft().result()
        finally:
            for x in open_:
                x.cancel()


def called(f: Callable[[str], str], prompt: str, attempts: int = 4, wait: float = 1.0, pace: Pace | None = None) -> str:
    """Up to ``attempts`` calls, waiting twice as long after each failure."""
    for k in range(attempts):
        try:
            if pace:
                pace.wait()
            return f(prompt)
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("no attempts")


def rewritten(jobs: DataFrame, config: Config, rewriter: Callable[[str], str] | None = None, wait: float = 1.0, rate: float | None = None, keep_errors: bool = False) -> DataFrame:
    """jobs (with mode and text) with final_text and model. Without a rewriter texts stay as they are; an implicit rewrite that leaks is asked for
    again up to max_retries times, and then the text stays.

    Each partition has config.max_workers calls open and gives its rows in order. rate: calls a second of all partitions together, shared out among as many as can run at once.
    keep_errors: a call that fails for good gives a row with a null text and its ``error`` instead of an exception, so that the other rows are not lost with it. The rewriter
    must bear calls from several threads.
    """
    if rewriter is None:
        plain = jobs.withColumn("final_text", F.col("text")).withColumn("model", F.lit("template-only"))
        return plain.withColumn("error", F.lit(None).cast("string")) if keep_errors else plain
    ship(jobs.sparkSession)
    leak = re.compile(r"\b(?:" + "|".join(re.escape(w) for w in sorted(config.banned, key=len, reverse=True)) + r")\w*", re.I)
    rule = "\n\nLeave out all of these words and their forms: " + ", ".join(config.banned) + "."
    at_once = jobs.sparkSession.sparkContext.defaultParallelism

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rate / at_once if rate else None)

        def one(job: tuple[str, str]) -> tuple[str | None, str | None, str | None]:
            text, mode = job
            try:
                for k in range(config.max_retries):
                    prompt = text if mode != "implicit" else text + rule + " Your last answer held one of them; try once more." * (k > 0)
                    out = called(rewriter, prompt, wait=wait, pace=pace)
                    if mode != "implicit" or not leak.search(out):
                        return out, config.model, None
                return text, "template-only", None
            except Exception as e:
                if not keep_errors:
                    raise
                return None, None, f"{type(e).__name__}: {e}"

        for pdf in frames:
            got = list(in_order(one, zip(pdf["text"], pdf["mode"], strict=True), config.max_workers))
            new = {c: pd.Series([g[i] for g in got], index=pdf.index, dtype=object) for i, c in enumerate(("final_text", "model", "error")[: 2 + keep_errors])}
            yield pdf.assign(**new)

    fields = ", ".join(f"`{n}` {t}" for n, t in jobs.dtypes)
    return jobs.mapInPandas(f, f"{fields}, final_text string, model string" + ", error string" * keep_errors)


def rewrite_through(jobs: DataFrame, cache: Cache, config: Config, rewriter: Callable[[str], str] | None, commit_size: int = 2000, open_commits: int = 4, wait: float = 1.0, rate: float | None = None) -> DataFrame:
    """jobs with final_text and model, from the cache; what it lacks is rewritten first and stored, texts that stay as they are included.

    Different missing jobs are dealt to buckets of about commit_size by a hash of their id, written once, and each bucket is a commit of its own; open_commits
    run at a time. So a driver or cluster that dies pays again only for its open buckets, and the next call goes on with the rest. A call that
    fails for good is stored as an error: it costs no other job, and after all buckets it is raised; the next call asks again. A null mode is not implicit; a null text has
    no id and stays null.
    """
    spark = jobs.sparkSession
    jobs = requests.with_ids(jobs.withColumn("_mode", F.coalesce("mode", F.lit(""))), config, mode="_mode")
    if rewriter is not None:
        fresh = requests.misses(jobs.where("text is not null").select("cache_id", F.col("_mode").alias("mode"), "text").dropDuplicates(["cache_id"]), cache.read())
        fresh = written(fresh, "missing")
        n = fresh.count()
        buckets = -(-n // commit_size)
        if n:
            dealt = written(fresh.withColumn("bucket", F.pmod(F.xxhash64("cache_id"), F.lit(buckets)).cast("int")).repartition("bucket"), "buckets", "bucket")
            parts = max(1, spark.sparkContext.defaultParallelism // open_commits)

            def commit(bucket: int) -> None:
                rows = dealt.where(F.col("bucket") == bucket).drop("bucket").repartition(parts)
                rows = rewritten(rows, config, rewriter, wait, rate, keep_errors=True)  # all open commits together have as many partitions as can run at once
                cache.append(rows.select("cache_id", F.col("final_text").alias("text"), "model", "error"))

            with ThreadPoolExecutor(open_commits) as pool:
                done = [pool.submit(commit, b) for b in range(buckets)]
                failed = [e for x in done if (e := x.exception())]
            if failed:
                raise failed[0]
    got = requests.hits(jobs, cache.read()).drop("_mode")
    if rewriter is not None and (left := fresh.join(cache.read(), "cache_id", "left_anti").count()):
        error = cache.errors(fresh)
        raise RuntimeError(f"{left} of {n} texts could not be rewritten, the others are stored; one error: {error}")
    return got.withColumn("final_text", F.coalesce("cached_text", "text")).withColumn("model", F.coalesce("cached_model", F.lit("template-only"))).drop("cached_text", "cached_model", "cache_id")
