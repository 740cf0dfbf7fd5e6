"""Client narratives: phrasing tables, twins and counterfactual pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.rubric import contradictory
from plumbline.operators.generate import filler_draw, spread, tier_draws
from plumbline.sources.config import Config

#: (field, value) -> explicit and implicit phrasings, any of which will do. Implicit ones hold no stem of the lexicon.
LEVELS = {
    ("past_drawdown_reaction", "sold_everything"): (
        ("A falling market made me sell all I had; I am a conservative person.", "I have no tolerance for losses and left the market when it fell.", "Being safe mattered most in the last slump, and I sold the lot."),
        ("After the last slide I moved all of it to my bank account.", "I closed my whole account near the bottom of the last slump.", "When prices tumbled I was out within a week and have not been back."),
    ),
    ("past_drawdown_reaction", "reduced"): (
        ("I cut my positions when prices fell, to lower my risk.", "In the last slump I turned cautious and sold a part.", "Falling prices made me wary, and I sold some of my funds."),
        ("When prices fell I sold about a third of what I owned.", "I trimmed my holdings during the last slump.", "Part of my money came out of the market on its way down."),
    ),
    ("past_drawdown_reaction", "held"): (
        ("I accepted the risk and held on through the last slump.", "Volatility did not move me; I held everything.", "I saw the gamble through and sold nothing when prices fell."),
        ("I left my account alone through the last slump.", "Prices fell, and I changed nothing.", "My orders were the same before, during and after the last crash: none."),
    ),
    ("past_drawdown_reaction", "bought_more"): (
        ("I am aggressive: I bought more while prices fell.", "A slump is a bold buyer's chance, and I took it.", "Others called it reckless, but I bought all the way down."),
        ("While prices fell I put in two more months of pay.", "I added to my account all through the last slump.", "Every red day last time saw me place another order to buy."),
    ),
    ("investing_experience", "none"): (("I have never invested and feel wary of it.", "Investment risk is something I have no experience of."), ("I have only ever had a savings book.", "Funds and shares are words from the news to me.")),
    ("investing_experience", "some"): (("I know a little about investment risk.", "I have taken small risks with a fund or two."), ("I own a couple of funds and read about them now and then.", "A friend showed me how to buy an index fund, and I kept it.")),
    ("investing_experience", "extensive"): (("I understand risk well from much experience.", "I have managed volatile portfolios of my own."), ("I build my own portfolio and follow the markets daily.", "I read company reports for pleasure and place my own orders.")),
    ("income_stability", "precarious"): (("My income is not secure.", "I cannot call my pay safe."), ("Some months bring hardly any pay.", "I never know in spring what autumn will pay me.")),
    ("income_stability", "variable"): (("My income is volatile.", "My pay is neither secure nor hopeless."), ("My pay differs from month to month.", "Good quarters and thin ones take turns at my work.")),
    ("income_stability", "stable"): (("My income is secure.", "My pay carries no risk."), ("The same pay arrives on the first of every month.", "My employer has paid me on time without a gap.")),
    ("stated_goal", "capital_preservation"): (("Above all my money must be safe.", "I am after safety, not profit."), ("I want to end with no less than I began with.", "All I ask is that nothing is lost.")),
    ("stated_goal", "income"): (("I want a prudent, regular income.", "Secure payments each quarter are my aim."), ("I want my savings to pay a part of my bills.", "What I hope for is a cheque that comes every quarter.")),
    ("stated_goal", "balanced_growth"): (("I want growth at a moderate risk.", "Some growth, without being reckless, is my aim."), ("I want my savings to grow a fair bit over time.", "My aim is steady growth with a few calm years in between.")),
    ("stated_goal", "maximum_growth"): (("I want the highest growth, whatever the risk.", "My aim is bold: as much growth as there is."), ("I want my savings to grow as much as they possibly can.", "The biggest sum at the end is the only thing I look at.")),
}
#: field -> (lowest, highest, explicit, implicit), ends included, with no gaps.
BANDS = {
    "horizon_years": (
        (1, 3, ("My horizon is short, so I must be cautious.", "With so few years left I can take no risk."), ("I will need this money within three years.", "A house purchase is due before three years are out.")),
        (4, 10, ("My horizon of some years allows a little risk.", "Being a few years away, I can be less cautious."), ("I will need this money in four to ten years.", "My plans for this sum begin after some years, but within ten.")),
        (11, 20, ("My horizon is long enough for some risk.", "I have time to sit out a volatile decade."), ("This money can stay where it is into my next decade.", "I have no use for this sum for eleven years at least.")),
        (21, 35, ("My very long horizon allows an aggressive stance.", "With that many years ahead I can be bold."), ("I will not touch this money for more than twenty years.", "Whoever I am in twenty-odd years will spend this, not me.")),
    ),
    "emergency_fund_months": (
        (0, 2, ("I have hardly any safety cushion.", "My reserve is not a safe one."), ("My spare cash would last for a few weeks.", "One broken boiler would empty my reserve.")),
        (3, 8, ("I have a fair safety cushion.", "My reserve makes me fairly secure."), ("My spare cash would last for about half a year.", "I could go some months without pay.")),
        (9, 24, ("My safety cushion is large.", "My reserve makes me very secure."), ("My spare cash would last for the better part of a year or more.", "I could live on my reserve through four seasons.")),
    ),
    "dependents": (
        (0, 0, ("Nobody depends on me, so I can bear risk.", "With no one to support I can be bold."), ("I look after nobody but myself.", "Mine is the only mouth I feed.")),
        (1, 2, ("One or two people depend on me, which calls for caution.", "I support a small family and am a bit cautious for it."), ("There are one or two people I support.", "My pay feeds one or two people besides me.")),
        (3, 4, ("Several people depend on me, so I must be safe.", "With a large family, prudent is the only way."), ("I support a large household.", "Dinner at our house is for four people or more.")),
    ),
}
WORTH = {
    "under_100k": ("All told I own less than a hundred thousand.", "Put together, my things and accounts come to five figures."),
    "100k_to_500k": ("All told I own a few hundred thousand.", "Put together, my things and accounts come to six figures, below the half million."),
    "500k_to_2m": ("All told I own about a million.", "Put together, my things and accounts come to a million, give or take."),
    "over_2m": ("All told I own more than two million.", "Put together, my things and accounts come to well over two million."),
}
OPENINGS = (
    "Client file: %s, age %s. Trade: %s. Home: %s.",
    "For your records I am called %s, was born %s years ago, have the trade of %s and rent in %s.",
    "A few facts first. Name, %s; age, %s; job, %s; town, %s.",
    "The person writing this, %s, has turned %s, holds the job title %s and votes in %s.",
    "Please note for the file: %s, %s years of age, %s by profession, resident of %s.",
    "You asked who I am: %s. I have %s birthdays behind me, the job title %s and a flat in %s.",
)
PASTIMES = ("Most Sundays are for %s.", "If I had one more day a week, it would be for %s.", "Friends know me for %s.")
KEYS = ("past_drawdown_reaction", "horizon_years", "investing_experience", "income_stability", "stated_goal", "emergency_fund_months", "dependents", "net_worth", "hobbies")
#: Four orders of the sentences, by rule: from some place of KEYS on, in steps of so many places.
ORDERINGS = tuple(tuple((start + step * i) % len(KEYS) for i in range(len(KEYS))) for start, step in ((3, 1), (7, 2), (5, 4), (1, 7)))


def band(field: str, value: Column, mode: Column | None = None, *key: Column, bands=BANDS) -> Column:
    """A phrasing of the band that holds a value, picked by a hash of the key (the band's number if mode is none); an error if
    none does."""
    out = None
    for k, (lo, hi, *texts) in enumerate(bands[field]):
        explicit, implicit = (T.pick(F.array(*map(F.lit, t)), F.lit(field), *key) for t in texts) if mode is not None else (None, None)
        said = F.lit(k) if mode is None else F.when(mode == "explicit", explicit).otherwise(implicit)
        out = F.when(value.between(lo, hi), said) if out is None else out.when(value.between(lo, hi), said)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"{field} out of its bands: "), value.cast("string"))).cast("int" if mode is None else "string"))


def verbalize(field: str, mode: Column, *key: Column) -> Column:
    """A sentence for one field, picked by a hash of the key."""
    if field in BANDS:
        return band(field, F.col(field), mode, *key)
    if field == "hobbies":
        return F.format_string("%s", T.pick(F.array(*[F.format_string(p, F.col("hobbies")) for p in PASTIMES]), F.lit(field), *key))
    if field == "net_worth":
        cases = [(F.col("net_worth_band") == v, T.pick(F.array(*map(F.lit, t)), F.lit(field), *key)) for v, t in WORTH.items()]
    else:
        cases = [((F.col(field) == v) & (mode == m), T.pick(F.array(*map(F.lit, t[i])), F.lit(field), *key)) for (f, v), t in LEVELS.items() if f == field for i, m in enumerate(("explicit", "implicit"))]
    out = reduce(lambda acc, c: F.when(*c) if acc is None else acc.when(*c), cases, None)
    return out.otherwise(F.raise_error(F.lit(f"no phrasing of {field}")).cast("string"))


def narrative(template: Column, mode: Column, *key: Column) -> Column:
    """The opening and nine sentences in the template's order; openings may name a number before the trade, so all are strings."""
    number = F.substring(template, 6, 2).cast("int")
    said = [(number == i, F.format_string(o, "name", F.col("age").cast("string"), "occupation", "city")) for i, o in enumerate(OPENINGS)]
    opening = reduce(lambda acc, c: F.when(*c) if acc is None else acc.when(*c), said, None)  # only the one that is told is made
    said = F.array(*[verbalize(k, mode, *key) for k in KEYS])
    order = F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in ORDERINGS]), F.substring(template, 9, 1).cast("int") + 1)
    return F.concat_ws(" ", opening, F.array_join(F.transform(order, lambda i: F.get(said, i)), " "))


def twin_jobs(profiles: DataFrame, config: Config) -> DataFrame:
    """Each profile told twice, explicitly and implicitly, by one template."""
    df = profiles.withColumn("vignette_type", F.explode(F.array(F.lit("explicit"), F.lit("implicit"))))
    df = df.withColumn("template_id", T.template_id(config.seed, F.col("profile_id")))
    return _jobs(df.withColumn("pair_id", F.lit(None).cast("string")).withColumn("vignette_id", F.concat_ws("_", F.lit("v"), "profile_id", "vignette_type")), config)


def pair_jobs(spark: SparkSession, config: Config, n_pairs: int, mode: str = "implicit") -> DataFrame:
    return pair_jobs_of(spark.range(n_pairs), config, mode)


def pair_jobs_of(ids: DataFrame, config: Config, mode: str = "implicit") -> DataFrame:
    """A pair for each id: a conservative and an aggressive client who share all filler and the template."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(t).alias("tier")) for s, t in (("cons", "conservative"), ("aggr", "aggressive"))]))
    keys = spread(ids).select(F.format_string("pair_%04d", F.col("id")).alias("pair_id"), side.alias("x")).select("pair_id", F.concat_ws("_", "pair_id", "x.side").alias("key"), "x.tier")
    df = tier_draws(config.rubric, keys, "tier", config.seed)
    df = df.select("*", *filler_draw(config.seed, F.col("pair_id"))).withColumn("profile_id", F.col("key")).withColumn("risk_score", F.round("_s", 2))
    df = df.withColumn("template_id", T.template_id(config.seed, F.col("pair_id"))).withColumn("vignette_type", F.lit(mode)).withColumn("vignette_id", F.concat(F.lit("v_"), "key"))
    return _jobs(df, config)


def _jobs(df: DataFrame, config: Config) -> DataFrame:
    text = narrative(F.col("template_id"), F.col("vignette_type"), F.lit(config.seed), F.col("profile_id"), F.col("vignette_type"))
    return df.select("vignette_id", "profile_id", "pair_id", "tier", "risk_score", "vignette_type", "template_id", contradictory(config.rubric).alias("contradictory"), text.alias("template_text"))


def finalized(jobs: DataFrame, config: Config, text: Column | None = None, model: Column | None = None) -> DataFrame:
    """Jobs with their final text; only implicit texts are searched for the lexicon."""
    text = F.col("template_text") if text is None else text
    model = F.lit("template-only") if model is None else model
    none = F.array().cast("array<string>")
    hits = F.when(F.col("vignette_type") == "implicit", T.lexicon_hits(text, config.banned)).otherwise(none)
    keep = ("vignette_id", "profile_id", "pair_id", "tier", "risk_score", "vignette_type", "template_id", "contradictory")
    return jobs.select(*keep, model.alias("paraphrase_model"), hits.alias("banned_terms_found"), text.alias("text"))
