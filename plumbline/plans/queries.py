"""The library's operators as queries over the driver's tables, each over whole tables, with equivalent SQL.

Roles: orders with their customers are profiles; documents are texts; embeddings are logits over a vocabulary, four letters of which stand at other
ids in each row, and four vectors the four rotations of one question; labels are a cache or the answers of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import readout as R
from plumbline.functions import text as T
from plumbline.functions.rubric import contradictory, score, subscore, tier
from plumbline.operators import generate as G
from plumbline.operators import narrative as N
from plumbline.operators import plugins, qc, requests, rewriting, sampling, similarity, stats
from plumbline.plans import gate
from plumbline.sources import jsonl
from plumbline.sources.cache import Cache
from plumbline.sources.config import SUITABILITY, Config, FieldSpec, Rubric
from plumbline.sources.jsonl import bucket
from plumbline.sources.stored import new_path, scratch

PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
ORDERS = Rubric(
    (
        FieldSpec("o_orderpriority", 0.4, PRIORITIES),
        FieldSpec("o_totalprice", 0.3, range=(1000.0, 500000.0)),
        FieldSpec("c_acctbal", 0.2, range=(-1000.0, 10000.0)),
        FieldSpec("o_orderstatus", 0.1, ("F", "O", "P")),
    )
)
LEXICON = ("tion", "ing", "stupid", "clown", "loser", "schl", "vequ")
PATTERN = r"(?i)(?:the|der|les|los) [a-z]{3,7} (?:the|der|les|los)"
SIZES = {"p_size": ((1, 10), (11, 25), (26, 50))}
CONFIG = Config(banned=LEXICON)
OPTIONS, EQUITY = CONFIG.options, CONFIG.equity
RHO_MIN, HEDGE_MAX = 0.5, 0.2


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    cust = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    both = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return both.withColumn("s", score(ORDERS)).withColumn("tier", tier(F.col("s"), ORDERS))


def rubric_score_tier(spark, d):
    return scored_orders(spark, d).select("o_orderkey", F.round("s", 6).alias("score"), "tier")


def tier_counts(spark, d):
    return qc.group_counts(scored_orders(spark, d), "tier")


def tier_means(spark, d):
    return scored_orders(spark, d).groupBy("tier").agg(F.round(qc.mean_or_zero("o_totalprice"), 3).alias("mean_price"), F.count(F.lit(1)).alias("n"))


def contradiction_flags(spark, d):
    return t(spark, d, "orders").select("o_orderkey", contradictory(ORDERS, ("o_orderpriority", "o_orderstatus")).alias("contradictory"))


def borderline_window(spark, d):
    rows = scored_orders(spark, d).where(G.in_windows(F.col("s"), [(38, 42), (68, 72)]))
    return rows.select("o_orderkey", F.round("s", 6).alias("score"))


def balanced_first_n_per_tier(spark, d):
    return G.first_n_per_group(scored_orders(spark, d), "tier", "o_orderkey", 200).select("o_orderkey", "tier")


def round_robin_assign(spark, d):
    dealt = G.round_robin(t(spark, d, "part").select("p_partkey"), ["p_partkey"], {"city": G.CITIES, "net_worth_band": G.NET_WORTH})
    return dealt.select("p_partkey", "pos", F.format_string("e%05d", "pos").alias("profile_id"), "city", "net_worth_band")


def band_lookup(spark, d):
    return t(spark, d, "part").select("p_partkey", N.band("p_size", F.col("p_size"), bands=SIZES).alias("band"))


def tier_balance_check(spark, d):
    rows = qc.shares(t(spark, d, "documents").select("lang"), "lang")
    return rows.select("lang", "n", F.round("share", 8).alias("share"), (F.abs(F.col("share") - 0.25) <= 0.2).alias("within"))


def token_length_match(spark, d):
    m = qc.length_match(t(spark, d, "documents").select("lang", "text"), "lang", T.token_count(F.col("text")), 0.10)
    return m.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "matched")


def _texts(spark, d):
    """Documents as vignettes: languages are tiers, those of one source are pairs, long ones explicit."""
    pair = F.when(F.col("source") == "src3", F.concat(F.lit("pair_"), F.col("doc_id").cast("string")))
    kind = F.when(F.col("n_chars") > 2000, "explicit").otherwise("implicit")
    return t(spark, d, "documents").select(F.col("doc_id").alias("vignette_id"), F.col("doc_id").alias("profile_id"), "text", F.col("lang").alias("tier"), pair.alias("pair_id"), kind.alias("vignette_type"))


def all_checks(spark, d):
    return qc.measured(_texts(spark, d), CONFIG).select("check", "part", "n", F.round("value", 6).alias("value"))


def check_examples(spark, d):
    """The first ten leaks, by a lexicon that many documents hold a word of, and how many there are."""
    rows = qc.examples(qc.flagged(_texts(spark, d), None, CONFIG))
    return rows.select("kind", "i", "vignette_id", "n", F.array_join("hits", "|").alias("hits"))


def lexicon_hits(spark, d):
    hits = t(spark, d, "documents").select("doc_id", T.lexicon_hits(F.col("text"), LEXICON).alias("h"))
    return hits.select("doc_id", F.size("h").alias("n_hits"), F.array_join("h", "|").alias("hits"))


def lexicon_leak_gate(spark, d):
    hits = t(spark, d, "documents").select("lang", (F.size(T.lexicon_hits(F.col("text"), LEXICON)) > 0).alias("leak"))
    g = hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("leak").alias("leaks"))
    return g.select("lang", "n", "leaks", R.mark(F.col("leaks") == 0).alias("verdict"))


def pattern_snippets_lookup(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("vignette_id"), F.col("doc_id").alias("profile_id"), "text")
    hits = qc.tenure(rows, t(spark, d, "labels").select(F.col("doc_id").alias("profile_id"), F.col("quality").alias("age")), 0, PATTERN)
    return hits.select(F.col("vignette_id").alias("doc_id"), "snippet")


def shingle_counts(spark, d):
    sets = similarity.shingle_sets(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return sets.select("doc_id", F.size("s").alias("n_shingles"))


def near_dup_exact(spark, d):
    return similarity.duplicated(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 0.7)


def near_dup_minhash(spark, d):
    return similarity.minhash_duplicated(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def template_assignment(spark, d):
    return t(spark, d, "documents").select("doc_id", T.template_id(42, F.col("doc_id").cast("string")).alias("template_id"))


def content_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", T.content_id("openai", "gpt-4o-mini", F.lit("implicit"), F.col("text")).alias("cache_id"))


def twin_expansion(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("explicit"), F.lit("implicit"))).alias("vignette_type"))
    return rows.select(F.concat_ws("_", F.lit("v"), F.col("doc_id").cast("string"), "vignette_type").alias("vignette_id"), "doc_id", "vignette_type", T.template_id(42, F.col("doc_id").cast("string")).alias("template_id"))


def _vignettes(spark, d):
    docs = t(spark, d, "documents")
    pair = F.when(F.col("source") == "src3", F.concat(F.lit("pair_"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", "lang", pair.alias("pair_id"), F.when(F.col("n_chars") > 2000, "explicit").otherwise("implicit").alias("vignette_type"))


def bucket_routing(spark, d):
    return _vignettes(spark, d).select("doc_id", bucket().alias("bucket"))


def union_scan(spark, d):
    """Documents written as buckets of JSON Lines, and the buckets read again as one table."""
    rows = _texts(spark, d).withColumn("vignette_id", F.col("vignette_id").cast("string")).withColumn("profile_id", F.col("profile_id").cast("string"))
    fields = [f.split()[0] for f in jsonl.VIGNETTE.split(", ")]
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in fields])
    folder = new_path(spark, "vignettes")
    jsonl.write_buckets(rows, folder)
    return jsonl.read_union(spark, folder).select(F.col("vignette_id").cast("long").alias("doc_id"), "source_order", F.md5("text").alias("text_md5"))


def option_rotations(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", F.posexplode(R.rotations_column(4)).alias("perm_idx", "perm"))
    return rows.select("item_id", "perm_idx", F.array_join(R.in_slots(F.array(*map(F.lit, OPTIONS)), F.col("perm")), " / ").alias("slots"))


def scoring_units(spark, d):
    rows = t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("contradictory"), F.lit("").alias("text"))
    return gate.scoring_units(rows, CONFIG).select("doc_id", "condition", "perm_idx", F.array_join(F.transform("perm", lambda x: x.cast("string")), ",").alias("perm"))


def prompt_text(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 2 == 0).alias("contradictory"))
    return gate.scoring_units(rows, CONFIG).select("item_id", "condition", "perm_idx", F.md5("user_msg").alias("prompt_md5"))


def _logits(spark, d):
    """Whole vectors as logits. A prompt ends with three tokens; its first and third letter follow it as tokens of their own, the second and fourth
    take the place of its last one."""
    v, at = F.col("vec_id"), lambda j: (20 + F.pmod(F.col("vec_id") * 3 + j * 5, F.lit(40))).cast("int")
    prompt = F.array((v % 11).cast("int"), F.lit(7), (v % 13).cast("int"))
    continued = F.array(*[F.concat(F.slice("prompt", 1, 3 - j % 2), F.array(at(j))) for j in range(4)])
    rows = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8.0).alias("logits"), prompt.alias("prompt"))
    perm = F.element_at(R.rotations_column(4), (F.pmod("vec_id", F.lit(4)) + 1).cast("int"))
    return rows.withColumn("vignette", F.floor(F.col("vec_id") / 4)).withColumn("perm", perm).withColumn("letters", R.letter_ids(F.col("prompt"), continued))


def letter_readout(spark, d):
    rows = _logits(spark, d).select("vec_id", R.letter_readout(F.col("logits"), F.col("letters")).alias("r"))
    return rows.select("vec_id", *[F.round(F.get("r.letter_probs", F.lit(i)), 6).alias(f"letter_{i}") for i in range(4)], F.round("r.p_letters", 6).alias("p_letters"), "r.argmax_is_letter")


def _results(spark, d):
    return gate.results(_logits(spark, d), CONFIG, ("vignette",))


def allocation_probs(spark, d):
    return _results(spark, d).select("vignette", *[F.round(F.get("p_alloc", F.lit(i)), 6).alias(f"alloc_{i}") for i in range(4)])


def advice_scores(spark, d):
    return _results(spark, d).select("vignette", F.round("aggressiveness", 6).alias("aggressiveness"), F.round("p_letters", 6).alias("p_letters"), "hedged")


def hedge_rate(spark, d):
    return _results(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hedged").cast("double")), 4).alias("hedge_rate"))


def spearman_by_group(spark, d):
    return stats.spearman(scored_orders(spark, d), "s", "o_totalprice", "c_mktsegment").select("c_mktsegment", F.round("rho", 6).alias("rho"), "n")


def gate_decision(spark, d):
    rho = stats.spearman(scored_orders(spark, d).withColumn("g", F.lit(1)), "s", "o_totalprice", "g").select(F.round("rho", 4).alias("rho"))
    one = hedge_rate(spark, d).join(rho, F.lit(True), "left")  # two rows of one
    ok, few = F.coalesce("rho", F.lit(-1.0)) >= RHO_MIN, F.col("hedge_rate") < HEDGE_MAX
    return one.select("rho", "hedge_rate", ok.alias("rho_pass"), few.alias("hedge_pass"), R.mark(ok & few).alias("verdict"))


def bootstrap_ci(spark, d):
    """Intervals of spearman_by_group's correlations, from resamples of the same orders."""
    ci = stats.bootstrap_spearman(scored_orders(spark, d), "s", "o_totalprice", "c_mktsegment")
    return ci.select("c_mktsegment", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


def _conditions(spark, d):
    rows = t(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return rows.select("user_id", F.when(F.col("event_type") == "click", "baseline").otherwise("instruction").alias("condition"), "value")


def _deltas(spark, d):
    return stats.paired_deltas(_conditions(spark, d), "user_id", "condition", "value").withColumn("delta", F.round("delta", 6))


def wilcoxon_statistic(spark, d):
    g = stats.signed_ranks(_deltas(spark, d), "delta")
    return g.select("n", "w_plus", "w_minus", "ties")


def wilcoxon_p(spark, d):
    return stats.wilcoxon(_deltas(spark, d), "delta")


def paired_delta(spark, d):
    return stats.delta_summary(_deltas(spark, d)).select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean_delta", "ci_low", "ci_high")])


def uncached_jobs(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("cache_id"))
    return requests.misses(jobs, t(spark, d, "labels").select(F.col("doc_id").alias("cache_id")))


def cache_lookup(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("cache_id"))
    cache = t(spark, d, "labels").select(F.col("doc_id").alias("cache_id"), F.concat(F.lit("cached-"), F.col("quality").cast("string")).alias("text"), F.lit("m").alias("model"))
    return requests.hits(jobs, cache).select("cache_id", F.coalesce("cached_text", F.lit("(none)")).alias("cached_text"))


def request_dedup(spark, d):
    jobs = t(spark, d, "documents").select("text", F.when(F.col("lang") == "en", "implicit").otherwise("explicit").alias("mode"))
    none = spark.createDataFrame([], "cache_id string, text string, model string")
    lines, _ = requests.build_batch(jobs, none, CONFIG, "system")
    return lines.select("custom_id", F.get("body.messages", F.lit(1))["content"].alias("c")).select("custom_id", F.md5("c").alias("prompt_md5"))


def collect_fallbacks(spark, d):
    """Labels as answers: of quality 1, with the document's text; others failed. English documents are implicit ones."""
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("custom_id"), F.when(F.col("lang") == "en", "implicit").otherwise("explicit").alias("mode"), F.col("text").alias("source"))
    rows = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("custom_id"), "quality").join(docs.select("custom_id", "source"), "custom_id")
    body = F.struct(F.array(F.struct(F.struct(F.col("source").alias("content")).alias("message"))).alias("choices"))
    answers = rows.select("custom_id", F.struct(F.when(F.col("quality") == 1, 200).otherwise(500).alias("status_code"), body.alias("body")).alias("response"))
    return requests.summary(requests.collected(answers, docs, CONFIG))


def stratified_sample(spark, d):
    return sampling.stratified_sample(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 200, None, order=F.col("doc_id"))


def seeded_limit(spark, d):
    return sampling.shuffled_limit(t(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


def fixed_batches(spark, d):
    return sampling.fixed_batches(t(spark, d, "documents").select("doc_id"), "doc_id", 32)


def distinct_coverage(spark, d):
    return t(spark, d, "part").agg(*[F.count_distinct(c).alias(f"n_{c}") for c in ("p_brand", "p_type", "p_size")])


def _clients(spark, d):
    """A drawn profile for each customer."""
    return G.drawn_profiles(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), SUITABILITY, 42)


def generated_profiles(spark, d):
    return _clients(spark, d).drop("draw")


def generated_edges(spark, d):
    """Customers whose draw is near a cut-off or contradicts itself, dealt the pools in turn."""
    hard = _clients(spark, d).select("draw", "risk_score", "tier", contradictory(SUITABILITY).alias("contradictory"), G.in_windows(score(SUITABILITY), [(38, 42), (68, 72)]).alias("borderline")).where("contradictory or borderline")
    return G.round_robin(hard, ["draw"], {"occupation": G.OCCUPATIONS, "city": G.CITIES}).drop("pos")


def _told(rows):
    return rows.select("vignette_id", "profile_id", "pair_id", "tier", F.round("risk_score", 2).alias("risk_score"), "vignette_type", "template_id", "contradictory", "paraphrase_model", F.array_join("banned_terms_found", "|").alias("banned_terms"), "text")


def twin_vignettes(spark, d):
    return _told(N.finalized(N.twin_jobs(_clients(spark, d), Config()), Config()))


def pair_vignettes(spark, d):
    """A pair of clients for each supplier."""
    return _told(N.finalized(N.pair_jobs_of(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), Config()), Config()))


def roundtrip_accuracy(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("vignette_id"), "text", F.col("lang").alias("tier"))
    return plugins.round_trip(rows, Config(), plugins.stub_classifier)


def rewriter_fallbacks(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 2 == 0, "implicit").otherwise("explicit").alias("mode"))
    return rewriting.rewritten(rows, CONFIG, str.upper).select("item_id", "final_text", "model")


def _turned(prompt: str) -> str:
    """A rewriter without a network: a text's first 40 characters turned round."""
    return prompt[:40][::-1]


def resumed_rewrites(spark, d):
    """All documents rewritten through a cache that already holds those of two of three jobs, as if a run had been broken off. English documents are
    implicit; of repeated texts one is asked for; rewrites that hold a word of the lexicon, however often they are asked for, leave the text as it is."""
    jobs = t(spark, d, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "implicit").otherwise("explicit").alias("mode"))
    with scratch(spark) as keep:
        cache = Cache(spark, new_path(spark, "rewrites"))
        had = requests.with_ids(jobs, CONFIG).where(F.substring("cache_id", 1, 1) < "a").dropDuplicates(["cache_id"])
        cache.append(had.select("cache_id", F.lit("had").alias("text"), F.lit("earlier").alias("model")))
        done = rewriting.rewrite_through(jobs, cache, CONFIG, _turned)
        return keep(done.select("doc_id", F.md5("final_text").alias("final_md5"), "model"), "rewritten")


def rewrites_in_order(spark, d):
    """Whole items rewritten by several calls at a time; the rows of a partition stay in order."""
    rows = t(spark, d, "benchmark").select("item_id", "text", F.lit("explicit").alias("mode")).repartitionByRange(4, "item_id").sortWithinPartitions("item_id")
    part = F.spark_partition_id()
    rows = rewriting.rewritten(rows, CONFIG, _turned).select("item_id", F.md5("final_text").alias("final_md5"), "model", part.alias("p"), F.monotonically_increasing_id().alias("i"))
    ahead = F.lead("item_id").over(Window.partitionBy("p").orderBy("i"))
    return rows.select("item_id", "final_md5", "model", F.coalesce(ahead >= F.col("item_id"), F.lit(True)).alias("in_order"))


def subscores(spark, d):
    return t(spark, d, "orders").select("o_orderkey", *[F.round(subscore(ORDERS.field(f)), 8).alias(f"a_{f}") for f in ("o_orderpriority", "o_totalprice", "o_orderstatus")])


QUERIES = {f.__name__: f for f in (
    rubric_score_tier, subscores, tier_counts, tier_means, contradiction_flags, borderline_window, balanced_first_n_per_tier, round_robin_assign, band_lookup,
    tier_balance_check, token_length_match, lexicon_hits, lexicon_leak_gate, pattern_snippets_lookup, shingle_counts, near_dup_exact, near_dup_minhash,
    template_assignment, content_ids, twin_expansion, bucket_routing, union_scan, option_rotations, scoring_units, prompt_text, letter_readout,
    allocation_probs, advice_scores, hedge_rate, spearman_by_group, gate_decision, bootstrap_ci, wilcoxon_statistic, wilcoxon_p, paired_delta,
    uncached_jobs, cache_lookup, request_dedup, collect_fallbacks, stratified_sample, seeded_limit, fixed_batches, distinct_coverage,
    generated_profiles, generated_edges, twin_vignettes, pair_vignettes, roundtrip_accuracy, rewriter_fallbacks, resumed_rewrites, rewrites_in_order, all_checks, check_examples,
)}
