"""The rubric as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.sources.config import FieldSpec, Rubric


def subscore(spec: FieldSpec, value: Column | str | None = None) -> Column:
    """0 to 1: a level's place among evenly spaced ones, or a number's within its range. A level that isn't known is an error."""
    c = F.col(spec.name) if value is None else F.col(value) if isinstance(value, str) else value
    if spec.levels is not None:
        levels = F.array(*map(F.lit, spec.levels))
        unknown = F.raise_error(F.concat(F.lit(f"unknown level of {spec.name}: "), c)).cast("double")
        place = F.array_position(levels, c)
        return F.when(c.isNull(), F.lit(None)).when(place > 0, (place - 1).cast("double") / F.lit(float(len(spec.levels) - 1))).otherwise(unknown)
    lo, hi = map(float, spec.range)
    a = (c.cast("double") - F.lit(lo)) / F.lit(hi - lo)
    return F.lit(1.0) - a if spec.invert else a


def score(rubric: Rubric) -> Column:
    """100 times the weighted subscores, added in the rubric's order."""
    parts = [F.lit(f.weight) * subscore(f) for f in rubric.fields]
    return F.lit(100.0) * reduce(lambda a, b: a + b, parts)


def tier(s: Column, rubric: Rubric) -> Column:
    """Of the score before it is rounded; both cut-offs belong to the middle tier."""
    return F.when(s < rubric.conservative_max, "conservative").when(s <= rubric.moderate_max, "moderate").when(s.isNotNull(), "aggressive")


def contradictory(rubric: Rubric, fields: tuple[str, str] = ("stated_goal", "past_drawdown_reaction"), hi: float = 0.8, lo: float = 0.2) -> Column:
    """One field's subscore is at least hi and the other's at most lo."""
    parts = [subscore(rubric.field(f)) for f in fields]
    return (F.greatest(*parts) >= hi) & (F.least(*parts) <= lo)
