"""The rubric, generation and narratives."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.rubric import contradictory, score, subscore, tier
from plumbline.operators import generate as G
from plumbline.operators import narrative as N
from plumbline.sources.config import SUITABILITY, TIERS, Config, FieldSpec, Rubric

MIDDLE = {"past_drawdown_reaction": "held", "horizon_years": 18, "investing_experience": "some", "income_stability": "variable", "stated_goal": "balanced_growth", "emergency_fund_months": 12, "dependents": 2, "age": 49}


def one(spark, fields):
    return spark.createDataFrame([fields])


def test_weights_sum_to_one():
    assert math.isclose(sum(f.weight for f in SUITABILITY.fields), 1.0)


@pytest.mark.parametrize(("fields", "want", "name"), [(G.ALL_LOW, 0, "conservative"), (G.ALL_HIGH, 100, "aggressive"), (MIDDLE, 56.33, "moderate")])
def test_anchors(spark, fields, want, name):
    r = G.scored(one(spark, fields), SUITABILITY).first()
    assert abs(r["risk_score"] - want) < 0.01 and r["tier"] == name


def test_cuts_belong_to_the_middle(spark):
    df = spark.createDataFrame([(39.999,), (40.0,), (70.0,), (70.001,), (None,)], "s double")
    assert [r[0] for r in df.select(tier(F.col("s"), SUITABILITY)).collect()] == ["conservative", "moderate", "moderate", "aggressive", None]


def test_unknown_level_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(Exception, match="unknown level"):
        df.select(subscore(FieldSpec("a", 1.0, ("p", "q")))).collect()


def test_inverted_range(spark):
    df = spark.createDataFrame([(0,), (4,), (1,)], "a int")
    assert [r[0] for r in df.select(subscore(FieldSpec("a", 1.0, range=(0, 4), invert=True))).collect()] == [1.0, 0.0, 0.75]


@pytest.mark.parametrize(("goal", "reaction", "want"), [("maximum_growth", "sold_everything", True), ("capital_preservation", "bought_more", True), ("maximum_growth", "bought_more", False), ("maximum_growth", "reduced", False)])
def test_contradiction(spark, goal, reaction, want):
    df = one(spark, {"stated_goal": goal, "past_drawdown_reaction": reaction})
    assert df.select(contradictory(SUITABILITY)).first()[0] is want


def test_balanced_counts(spark):
    kept, drawn = G.balanced_profiles(spark, SUITABILITY, 30, 7)
    assert {r["tier"]: r["count"] for r in kept.groupBy("tier").count().collect()} == dict.fromkeys(TIERS, 30)
    assert drawn == kept.agg(F.max("draw")).first()[0] + 1
    again, _ = G.balanced_profiles(spark, SUITABILITY, 30, 7)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.repartition(7).collect()))


def test_natural_shares(spark):
    n = 50_000
    got = {r["tier"]: r["count"] / n for r in G.profiles(spark, SUITABILITY, n, 0).groupBy("tier").count().collect()}
    assert all(abs(got[t] - x) < 0.03 for t, x in zip(TIERS, (0.26, 0.64, 0.10), strict=True))


def test_edge_profiles(spark):
    rows = G.edge_profiles(spark, SUITABILITY, 42).collect()
    count = {}
    for r in rows:
        count[r["edge_bucket"]] = count.get(r["edge_bucket"], 0) + 1
    assert count == {"borderline": 20, "contradiction": 12, "extreme_demo": 8, "anchor_conservative": 10, "anchor_aggressive": 10}
    assert len({r["profile_id"] for r in rows}) == 60
    assert [len({r[c] for r in rows}) for c in ("occupation", "city", "hobbies")] == [10, 10, 10]
    assert all(38 <= r["risk_score"] <= 42 or 68 <= r["risk_score"] <= 72 for r in rows if r["edge_bucket"] == "borderline")


def test_pairs(spark):
    rows = N.pair_jobs(spark, Config(), 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["pair_id"], []).append(r)
    assert len(by) == 8
    for pair in by.values():
        assert {r["tier"] for r in pair} == {"conservative", "aggressive"} and len({r["template_id"] for r in pair}) == 1
        a, b = (r["template_text"].split(", ")[0] for r in pair)
        assert a[:8] == b[:8]


def test_pair_draw_that_cannot_be(spark):
    never = Rubric(SUITABILITY.fields, 0.0, 100.0)
    keys = spark.createDataFrame([("k", "aggressive")], "key string, tier string")
    with pytest.raises(Exception, match="no draw of tier"):
        G.tier_draws(never, keys, "tier", 1, 50).collect()


def test_twins_share_a_template_and_do_not_leak(spark):
    rows = N.finalized(N.twin_jobs(G.profiles(spark, SUITABILITY, 300, 3), Config()), Config())
    assert rows.groupBy("profile_id").agg(F.count_distinct("template_id").alias("n")).where("n <> 1").count() == 0
    assert rows.where("vignette_type = 'implicit' and size(banned_terms_found) > 0").count() == 0
    assert rows.where(F.size(T.lexicon_hits(F.col("text"), Config().banned)) > 0).where("vignette_type = 'explicit'").count() > 250
    assert rows.columns == ["vignette_id", "profile_id", "pair_id", "tier", "risk_score", "vignette_type", "template_id", "contradictory", "paraphrase_model", "banned_terms_found", "text"]


def test_no_implicit_phrasing_leaks(spark):
    said = [t for _, texts in N.LEVELS.items() for t in texts[1]] + [b[3] for bands in N.BANDS.values() for b in bands] + [t for v in N.WORTH.values() for t in v] + list(N.OPENINGS) + list(N.PASTIMES)
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert df.where(F.size(T.lexicon_hits(F.col("t"), Config().banned)) > 0).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (35,)], "horizon_years int")
    assert [r[0] for r in df.select(N.band("horizon_years", F.col("horizon_years"))).collect()] == [0, 0, 1, 3]
    with pytest.raises(Exception, match="out of its bands"):
        spark.createDataFrame([(36,)], "v int").select(N.band("horizon_years", F.col("v"))).collect()


def test_score_needs_all_fields(spark):
    assert one(spark, MIDDLE).select(score(SUITABILITY)).first()[0] == pytest.approx(56.33, abs=0.01)


def test_few_bytes_of_ids_are_many_tasks(spark):
    """Drawing and telling a client is much work for few bytes: a table in one part is dealt to as many tasks as shuffles have."""
    ids = spark.range(0, 1000, 1, 1)
    assert ids.rdd.getNumPartitions() == 1
    twins = N.finalized(N.twin_jobs(G.drawn_profiles(ids, SUITABILITY, 3), Config()), Config())
    sizes = [r["count"] for r in twins.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 2000 and max(sizes) < 700
