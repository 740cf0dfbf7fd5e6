"""Choice probabilities over rotated options, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotations(n: int, n_rot: int | None = None) -> list[list[int]]:
    """Rotation r puts option (slot + r) modulo n into each slot."""
    return [[(slot + r) % n for slot in range(n)] for r in range(n if n_rot is None else n_rot)]


def rotations_column(n: int, n_rot: int | None = None) -> Column:
    last = (n if n_rot is None else n_rot) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.pmod(s + r, F.lit(n))))


def in_slots(options: Column, permutation: Column) -> Column:
    return F.transform(permutation, lambda i: F.get(options, i))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def letter_ids(prompt: Column, continued: Column) -> Column:
    """The token id by which each answer's letter is told: where the ids of the prompt with the letter (an array for each letter) part from those of the
    prompt alone, since a tokenizer may join the letter with what stands before it. A letter without a place of its own, or two letters with
    one id, is an error."""
    parts = F.transform(continued, lambda ids: F.zip_with(prompt, ids, lambda a, b: ~a.eqNullSafe(b)))
    found = F.zip_with(continued, parts, lambda ids, other: F.get(ids, F.array_position(other, F.lit(True)).cast("int") - 1))
    return (
        F.when(F.exists(found, lambda i: i.isNull()), F.raise_error(F.lit("a letter has no token of its own")).cast("array<int>"))
        .when(F.size(F.array_distinct(found)) < F.size(found), F.raise_error(F.lit("two letters have one token")).cast("array<int>"))
        .otherwise(found)
    )


def letter_readout(logits: Column, letters: Column | int) -> Column:
    """struct(letter_probs, p_letters, argmax_is_letter) of logits over a whole vocabulary. letters: the letters' token ids, which may differ by row, or how
    many of the first entries are letters. Only the letters' entries are kept; the others are added up. An id outside the vocabulary is an error."""
    ids = F.sequence(F.lit(0), F.lit(letters - 1)) if isinstance(letters, int) else letters
    top = F.array_max(logits)
    all_ = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mass = F.transform(ids, lambda i: F.exp(F.element_at(logits, i.cast("int") + 1) - top) / all_)
    total = added(mass)
    return F.struct(
        F.transform(mass, lambda x: x / F.greatest(total, F.lit(1e-9))).alias("letter_probs"),
        total.alias("p_letters"),
        F.array_contains(ids, (F.array_position(logits, top) - 1).cast("int")).alias("argmax_is_letter"),
    )


def by_allocation(letter_probs: Column, permutation: Column) -> Column:
    """Slot probabilities back in the order of the options."""
    return F.transform(permutation, lambda p, i: F.get(letter_probs, F.array_position(permutation, i).cast("int") - 1))


def aggressiveness(p_alloc: Column, equity) -> Column:
    return F.aggregate(F.zip_with(p_alloc, F.array(*[F.lit(float(e)) for e in equity]), lambda p, f: p * f), F.lit(0.0), lambda a, x: a + x)


def hedged(p_letters: Column, frac_argmax: Column, least_mass: float = 0.5) -> Column:
    return (p_letters < least_mass) | (frac_argmax < 0.5)


def mark(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")
