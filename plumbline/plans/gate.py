"""The advice readout and the gate over its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import readout as R
from plumbline.functions import text as T
from plumbline.operators import stats
from plumbline.sources.config import TIERS, Config


def scoring_units(vignettes: DataFrame, config: Config) -> DataFrame:
    """A row for each vignette, condition (two for contradictory ones) and rotation of the options, with its question."""
    both = F.array(F.lit("baseline"), F.lit("instruction"))
    cond = F.explode(F.when(F.col("contradictory"), both).otherwise(F.slice(both, 1, 1))).alias("condition")
    rot = R.rotations_column(len(config.options), config.n_permutations)
    units = vignettes.select("*", cond).select("*", F.posexplode(rot).alias("perm_idx", "perm"))
    options = R.in_slots(F.array(*map(F.lit, config.options)), F.col("perm"))
    extra = F.when(F.col("condition") == "instruction", F.lit(config.instruction))
    return units.withColumn("user_msg", T.user_message(F.lit(config.framing), F.col("text"), options, extra))


def results(scored: DataFrame, config: Config, keys: tuple[str, ...] = ("vignette_id", "condition")) -> DataFrame:
    """scored: units with logits (and the letters' token ids in ``letters``, if they aren't the first entries), or with what was read off them. One row for each vignette and condition: p_alloc (mean over the rotations), aggressiveness,
    p_letters, hedged."""
    n = len(config.options)
    if "logits" in scored.columns:
        r = R.letter_readout(F.col("logits"), F.col("letters") if "letters" in scored.columns else n)
    else:
        r = F.struct("letter_probs", "p_letters", "argmax_is_letter")
    read = scored.select(*keys, "perm", r.alias("r")).withColumn("p", R.by_allocation(F.col("r.letter_probs"), F.col("perm")))
    mean = [F.avg(F.get("p", F.lit(i))).alias(f"_p{i}") for i in range(n)]
    g = read.groupBy(*keys).agg(*mean, F.avg("r.p_letters").alias("p_letters"), F.avg(F.col("r.argmax_is_letter").cast("double")).alias("_f"))
    alloc = F.array(*[f"_p{i}" for i in range(n)])
    return g.select(*keys, alloc.alias("p_alloc"), R.aggressiveness(alloc, config.equity).alias("aggressiveness"), "p_letters", R.hedged(F.col("p_letters"), F.col("_f"), config.hedge_min_mass).alias("hedged"))


def gate_report(rows: DataFrame, config: Config, n_boot: int = 2000) -> dict:
    """rows: results joined with their vignettes' columns. Rho and tier means are of twins; the hedge rate is of all baseline
    rows; deltas of all rows. Compared after rounding to 4 places."""
    base = rows.where("condition = 'baseline'")
    twins = base.where("pair_id is null")
    labelled = twins.select("risk_score", "aggressiveness", F.explode(F.array(F.lit("overall"), "vignette_type")).alias("label"))
    rho = {r["label"]: r for r in stats.spearman(labelled, "risk_score", "aggressiveness", "label").collect()}
    ci = {r["label"]: r for r in stats.bootstrap_spearman(labelled.where(F.col("label").isin(*rho)) if rho else labelled.limit(0), "risk_score", "aggressiveness", "label", n_boot, config.seed).collect()}
    n = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hedged").cast("double")).alias("h")).first()
    hedge = None if n["h"] is None else round(n["h"], 4)
    means = {r["tier"]: r for r in twins.groupBy("tier").agg(F.avg("aggressiveness").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    out = {
        "n_baseline": n["n"],
        "n_twins": twins.count(),
        "spearman": {k: {"rho": round(r["rho"], 4), "ci": [round(ci[k]["ci_low"], 4), round(ci[k]["ci_high"], 4)] if k in ci else None, "n": r["n"]} for k, r in rho.items()},
        "hedge_rate": hedge,
        "tier_means": {t: {"mean": round(means[t]["m"], 4), "n": means[t]["n"]} for t in TIERS if t in means},
    }
    deltas = stats.paired_deltas(rows, "vignette_id", "condition", "aggressiveness")
    if (d := stats.delta_summary(deltas).first()) is not None:
        w = stats.wilcoxon(deltas, "delta").first()
        out["two_condition"] = {"n_pairs": d["n_pairs"], "mean_delta": round(d["mean_delta"], 4), "wilcoxon_p": w["p_value"] if w is not None else float("nan"), "ci": [round(d["ci_low"], 4), round(d["ci_high"], 4)]}
    rho_ok = out["spearman"].get("implicit", {}).get("rho", -1) >= config.rho_min
    hedge_ok = hedge is not None and hedge < config.hedge_rate_max
    out["gate"] = {"spearman_rho_min": config.rho_min, "hedge_rate_max": config.hedge_rate_max, "implicit_rho_pass": rho_ok, "hedge_pass": hedge_ok, "PASS": rho_ok and hedge_ok}
    return out
