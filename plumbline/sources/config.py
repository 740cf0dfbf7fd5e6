"""Configuration: YAML to frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The tiers in order.
TIERS = ("conservative", "moderate", "aggressive")
#: Stems that give a client's attitude away.
BANNED_STEMS = (
    "risk", "conservative", "aggressive", "volatile", "volatility", "tolerance",
    "cautious", "caution", "safe", "safety", "secure", "gamble", "speculative",
    "speculation", "bold", "daring", "timid", "wary", "prudent", "reckless",
)


@dataclass(frozen=True)
class FieldSpec:
    """A rubric field: ordered levels, or a range of numbers, perhaps inverted."""

    name: str
    weight: float
    levels: tuple[str, ...] | None = None
    range: tuple[float, float] | None = None
    invert: bool = False


@dataclass(frozen=True)
class Rubric:
    fields: tuple[FieldSpec, ...]
    conservative_max: float = 40.0
    moderate_max: float = 70.0

    def field(self, name: str) -> FieldSpec:
        return next(f for f in self.fields if f.name == name)

    @classmethod
    def of(cls, spec: dict) -> Rubric:
        fields = tuple(
            FieldSpec(name, float(f["weight"]), tuple(f["levels"]) if "levels" in f else None, tuple(f["range"]) if "range" in f else None, bool(f.get("invert")))
            for name, f in spec["fields"].items()
        )
        cuts = spec["tier_cutoffs"]
        return cls(fields, float(cuts["conservative_max"]), float(cuts["moderate_max"]))


#: The suitability rubric.
SUITABILITY = Rubric(
    (
        FieldSpec("past_drawdown_reaction", 0.30, ("sold_everything", "reduced", "held", "bought_more")),
        FieldSpec("horizon_years", 0.25, range=(1, 35)),
        FieldSpec("investing_experience", 0.12, ("none", "some", "extensive")),
        FieldSpec("income_stability", 0.10, ("precarious", "variable", "stable")),
        FieldSpec("stated_goal", 0.08, ("capital_preservation", "income", "balanced_growth", "maximum_growth")),
        FieldSpec("emergency_fund_months", 0.08, range=(0, 24)),
        FieldSpec("dependents", 0.04, range=(0, 4), invert=True),
        FieldSpec("age", 0.03, range=(23, 75), invert=True),
    )
)


@dataclass(frozen=True)
class Config:
    rubric: Rubric = SUITABILITY
    seed: int = 42
    n_profiles: int = 6000
    n_pairs: int = 1200
    banned: tuple[str, ...] = BANNED_STEMS
    tier_balance_tol: float = 0.02
    token_len_tol: float = 0.10
    dup_fraction_max: float = 0.005
    roundtrip_sample: int = 50
    backend: str = "openai"
    model: str = "gpt-4o-mini"
    temperature: float = 0.7
    max_retries: int = 4
    max_workers: int = 8
    #: The portfolios, and their shares of stocks.
    options: tuple[str, ...] = ("80% bonds, 20% stocks", "60% bonds, 40% stocks", "30% bonds, 70% stocks", "10% bonds, 90% stocks")
    equity: tuple[float, ...] = (0.20, 0.40, 0.70, 0.90)
    n_permutations: int = 4
    batch_size: int = 32
    dry_run_n: int = 100
    #: Thresholds of the gate.
    hedge_min_mass: float = 0.5
    rho_min: float = 0.5
    hedge_rate_max: float = 0.2
    framing: str = "Choose the one listed option that suits the client described below."
    instruction: str = "Weigh everything you know about the client before you choose."
    paths: dict = field(default_factory=lambda: {"data_dir": "data", "results_dir": "results", "cache_dir": "cache", "vignettes_dir": "data/vignettes"})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML file; what it doesn't name keeps its default."""
        import yaml

        with open(path) as f:
            raw = yaml.safe_load(f) or {}
        known: dict = {}

        def take(name: str, *keys: str, kind=None) -> None:
            at = raw
            for k in keys:
                if not isinstance(at, dict) or k not in at:
                    return
                at = at[k]
            known[name] = kind(at) if kind else at

        take("rubric", "rubric", kind=Rubric.of)
        take("seed", "seed")
        take("n_profiles", "data", "n_profiles")
        take("n_pairs", "vignette", "n_pairs")
        take("banned", "vignette", "banned_lexicon", kind=tuple)
        for k in ("tier_balance_tol", "token_len_tol", "dup_fraction_max", "roundtrip_sample"):
            take(k, "vignette", "qc", k)
        for k in ("backend", "model", "temperature", "max_retries", "max_workers"):
            take(k, "vignette", "paraphrase", k)
        take("options", "advice_options", "portfolio_choice", kind=tuple)
        take("equity", "advice_options", "equity_fractions", kind=tuple)
        for k in ("n_permutations", "batch_size", "dry_run_n"):
            take(k, "s3", k)
        take("hedge_min_mass", "s3", "hedge_p_letters_min")
        take("framing", "s3", "prompts", "framing")
        take("instruction", "s3", "prompts", "integrate_instruction")
        take("rho_min", "gate", "spearman_rho_min")
        take("hedge_rate_max", "gate", "hedge_rate_max")
        take("paths", "paths")
        return cls(**known)
