"""``python -m plumbline.plans.cli STEP``: the pipeline's steps over JSON Lines folders.

Steps: profiles, edges, render, submit, wait, collect, qc, advise, gate. ``qc`` exits 1 on a hard failure; ``collect`` exits 1 without
responses; ``wait`` exits 1 if the batch ends in another state than completed and without answers; ``gate`` prints PASS or FAIL and exits 0.

Models are named as ``module:function`` (or a class, which is called once): --rewriter for render (``hosted``: the configuration's backend), --classifier and
--tokenizer (a text's number of tokens) for qc, --scorer for advise, --service for submit and wait. Without them texts stay as they are, there is no round trip, and a stand-in scores.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import generate, narrative, plugins, qc, requests, rewriting, sampling, scoring
from plumbline.plans import gate
from plumbline.sources import jsonl
from plumbline.sources.cache import Cache
from plumbline.sources.config import TIERS, Config

SIDECAR = "custom_id string, mode string, source string"


def loaded(name: str):
    """What ``module:name`` names; a class is made into an object."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name}: write module:function")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def rewriter_of(config: Config, a):
    """The rewriter that is named; ``hosted`` is the configuration's backend."""
    if not a.rewriter:
        return None
    return rewriting.HostedRewriter(config.backend, config.model, config.temperature) if a.rewriter == "hosted" else loaded(a.rewriter)


def rendered(spark: SparkSession, jobs: DataFrame, config: Config, a) -> DataFrame:
    """Jobs with their texts: from the cache, else rewritten and stored while the work goes on if there is a rewriter, else as they are."""
    jobs = jobs.withColumn("text", F.col("template_text")).withColumn("mode", F.col("vignette_type"))
    done = rewriting.rewrite_through(jobs, Cache(spark, a.cache), config, rewriter_of(config, a), a.commit_size, rate=a.rate)
    return narrative.finalized(done.drop("text", "mode").withColumnRenamed("model", "_model"), config, F.col("final_text"), F.col("_model"))


def scored_units(units: DataFrame, config: Config, a) -> DataFrame:
    """Units with their readout. A class with ``chat``, ``ids`` and ``logits`` is loaded by the workers and its letters' ids are found; a function gives logits whose
    first entries are the letters; without either a stand-in."""
    if not a.scorer:
        return plugins.prompt_scores(units, plugins.stub_scorer, config.batch_size)
    module, _, name = a.scorer.partition(":")
    found = getattr(importlib.import_module(module), name)
    if not hasattr(found, "logits"):
        return plugins.prompt_scores(units, loaded(a.scorer), config.batch_size)
    model, n = scoring.Model(a.scorer, (("device", a.device),) if a.device else ()), len(config.options)
    letters = scoring.sample_letters(units, model, n, "vignette_id")
    print(f"letters' token ids: {letters}")
    return scoring.letter_scores(units, model, n, letters or None, config.batch_size)


def jobs_of(spark: SparkSession, config: Config, a) -> DataFrame:
    profiles = jsonl.read(spark, a.profiles, jsonl.PROFILE)
    if a.limit is not None:
        profiles = sampling.shuffled_limit(profiles, "profile_id", a.limit, config.seed)
    jobs = narrative.twin_jobs(profiles, config)
    n = config.n_pairs if a.n_pairs is None else a.n_pairs
    return jobs.unionByName(narrative.pair_jobs(spark, config, n)) if n else jobs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=("profiles", "edges", "render", "submit", "wait", "collect", "qc", "advise", "gate"))
    p.add_argument("--config", default=None)
    p.add_argument("--profiles", default="data/profiles.jsonl")
    p.add_argument("--vignettes-dir", default="data/vignettes")
    p.add_argument("--out", default=None)
    p.add_argument("--cache", default="cache/rewrites.jsonl")
    p.add_argument("--responses", default="results/batch_output.jsonl")
    p.add_argument("--results", default="results/s3_results.jsonl")
    p.add_argument("--n-pairs", type=int, default=None)
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("--no-paraphrase", action="store_true", help="leave the cache aside")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--backend", default=None)
    p.add_argument("--model", default=None)
    for name in ("--rewriter", "--classifier", "--scorer", "--service", "--tokenizer"):
        p.add_argument(name, default=None, metavar="MODULE:NAME")
    p.add_argument("--batch", default=None, help="the batch to wait for; without it the one that submit kept, or else the input is submitted")
    p.add_argument("--then-render", action="store_true", help="collect goes on with render and qc")
    p.add_argument("--device", default=None, help="given to the scorer's class")
    p.add_argument("--max-workers", type=int, default=None, help="calls that a worker has open")
    p.add_argument("--rate", type=float, default=None, help="calls a second of all workers together")
    p.add_argument("--commit-size", type=int, default=2000, help="rewrites that are stored together")
    p.add_argument("--interval", type=float, default=60.0, help="seconds between questions")
    a = p.parse_args(argv)
    config = Config.load(a.config) if a.config else Config()
    config = replace(config, **{k: v for k, v in (("backend", a.backend), ("model", a.model), ("max_workers", a.max_workers)) if v is not None})
    spark = SparkSession.builder.appName(f"plumbline-{a.step}").getOrCreate()
    if a.step == "wait":
        if not a.service:
            p.error("wait needs --service")
        service, kept = loaded(a.service), f"{a.out or 'results'}/batch_id.txt"
        batch = a.batch or (jsonl.get_text(spark, kept).strip() if jsonl.exists(spark, kept) else service.submit(f"{a.out or 'results'}/batch_input.jsonl"))
        state = plugins.awaited(service, batch, a.interval)
        got = service.output(batch) if hasattr(service, "output") else None
        if got:
            spark.read.text(got).write.mode("overwrite").text(a.responses)
        print(f"batch {batch}: {state}" + " with what was finished; submit again for the rest" * bool(got and state != "completed"))
        return int(state != "completed" and not got)
    if a.step == "profiles":
        kept, drawn = generate.balanced_profiles(spark, config.rubric, config.n_profiles // len(TIERS), config.seed)
        jsonl.write(kept.drop("draw"), a.out or a.profiles)
        print(f"{a.out or a.profiles}: {config.n_profiles // len(TIERS)} profiles of each tier from {drawn} draws")
    elif a.step == "edges":
        jsonl.write(generate.edge_profiles(spark, config.rubric, config.seed), a.out or "data/profiles_edge.jsonl")
    elif a.step == "render":
        jobs = jobs_of(spark, config, a)
        done = narrative.finalized(jobs, config) if a.no_paraphrase else rendered(spark, jobs, config, a)
        jsonl.write_buckets(done, a.out or a.vignettes_dir)
    elif a.step == "submit":
        jobs = jobs_of(spark, config, a).select(F.col("template_text").alias("text"), F.col("vignette_type").alias("mode"))
        lines, sidecar = requests.build_batch(jobs, Cache(spark, a.cache).read(), config, rewriting.SYSTEM)
        jsonl.write(lines, f"{a.out or 'results'}/batch_input.jsonl")
        jsonl.write(sidecar, f"{a.out or 'results'}/batch_sidecar.jsonl")
        if a.service:
            batch = loaded(a.service).submit(f"{a.out or 'results'}/batch_input.jsonl")
            jsonl.put_text(spark, f"{a.out or 'results'}/batch_id.txt", batch)
            print(f"batch {batch}")
    elif a.step == "collect":
        if not jsonl.exists(spark, a.responses):
            print("no responses")
            return 1
        rows = requests.collected(jsonl.read(spark, a.responses, jsonl.RESPONSE), jsonl.read(spark, f"{a.out or 'results'}/batch_sidecar.jsonl", SIDECAR), config).cache()
        Cache(spark, a.cache).append(rows.select("cache_id", "text", "model"))
        print(requests.summary(rows).first().asDict())
        if a.then_render:
            rest = [x for x in argv or sys.argv[1:] if x not in ("collect", "--then-render")]
            at = rest.index("--out") if "--out" in rest else len(rest)
            return main(["render", *rest[:at], *rest[at + 2 :]]) or main(["qc", *rest])
    elif a.step == "qc":
        profiles = jsonl.read(spark, a.profiles, jsonl.PROFILE) if jsonl.exists(spark, a.profiles) else None
        vignettes = jsonl.read_union(spark, a.vignettes_dir)
        report = qc.report(vignettes, profiles, config, loaded(a.tokenizer) if a.tokenizer else None)
        if a.classifier:
            report["round_trip"] = plugins.round_trip(vignettes.where("vignette_type = 'implicit'"), config, loaded(a.classifier)).first().asDict()
        jsonl.write_report(spark, report, f"{a.out or config.paths['results_dir']}/{jsonl.report_name(a.vignettes_dir)}")
        print(report)
        return int(report["hard_fail"])
    elif a.step == "advise":
        rows = jsonl.read_union(spark, a.vignettes_dir)
        if a.dry_run:
            rows = sampling.stratified_sample(rows, "tier", "vignette_id", config.dry_run_n, config.seed, flag="contradictory")
        scored = scored_units(gate.scoring_units(rows, config), config, a)
        got = gate.results(scored, config).join(rows.select("vignette_id", "profile_id", "pair_id", "vignette_type", "tier", "risk_score", "contradictory"), "vignette_id")
        jsonl.write(got, a.out or a.results)
    else:
        report = gate.gate_report(jsonl.read(spark, a.results, jsonl.RESULT), config)
        jsonl.write_report(spark, report, f"{a.out or config.paths['results_dir']}/s3_gate.json")
        print(report)
        print("PASS" if report["gate"]["PASS"] else "FAIL")
    return 0


if __name__ == "__main__":
    sys.exit(main())
