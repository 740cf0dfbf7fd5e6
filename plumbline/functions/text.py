"""Text expressions: lexicon, tokens, shingles, stable picks, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a long past of investing is told.
TENURE = (
    r"(?iU)(?:been\s+(?:actively\s+)?investing|been\s+an\s+investor|investing|invested)"
    r"\s+(?:for|since)\s+(?:the\s+|past\s+|last\s+|about\s+|nearly\s+|over\s+|almost\s+|roughly\s+)*"
    r"(?:(?:a\s+couple\s+of\s+|two|three|four|five|six|seven|eight|nine|several|many|ten|fifteen|twenty|thirty|\d{2})\s+decades?"
    r"|(?:ten|fifteen|twenty|thirty|\d{2})\s+years?)"
)
#: Fixed value: up to this age a long past of investing is not believed.
YOUNG = 30
#: How an adviser is asked to answer.
ANSWER = "Answer with the letter of the one option that you choose, and with nothing else."


def stems_pattern(words) -> str:
    """Words that begin with one of the stems, the longest first, in any case."""
    return r"(?iU)\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\w*"


def lexicon_hits(text: Column, words) -> Column:
    return F.regexp_extract_all(text, F.lit(stems_pattern(words)), F.lit(0))


def tokens(text: Column) -> Column:
    """Split at Unicode white space; no empty ones."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def shingles(toks: Column, n: int = 5) -> Column:
    """The different runs of n tokens (a shorter text is one run; an empty one has one empty run)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(toks, i + 1, n), " ")))


def snippet(text: Column, pattern: str, around: int = 15) -> Column:
    """The first match with so many characters on either side, trimmed; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_extract(text, pattern, 0)
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(text, begin, at + F.length(hit) + around - begin)))


def stable_mod24(key: Column) -> Column:
    """The md5 of key as a 128-bit number, modulo 24: since 16^k is 16 modulo 24, its four 32-bit parts suffice."""
    digest = F.md5(key)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return (16 * (parts[0] + parts[1] + parts[2]) + parts[3]) % 24


def template_id(seed: int, key: Column) -> Column:
    """One of 24 templates: 6 openings by 4 orderings."""
    k = stable_mod24(F.concat_ws("|", F.lit(str(seed)), key))
    return F.format_string("tmpl_%02d_%d", F.floor(k / 4).cast("int"), (k % 4).cast("int"))


def content_id(backend: str, model: str, mode: Column, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{backend}|{model}|"), mode, F.lit("|"), text))


def drawn(n: Column | int, *key: Column) -> Column:
    """A number from 0 to n - 1 by the md5 of the key, so that any engine draws the same; nulls in the key are left out."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n).cast("int")


def pick(values: Column, *key: Column) -> Column:
    """One of an array's values by a hash of the key."""
    return F.element_at(values, drawn(F.size(values), *key) + 1)


def user_message(framing: Column, narrative: Column, options: Column, instruction: Column | None = None) -> Column:
    """The question to an adviser, with lettered options; a null instruction leaves nothing."""
    lettered = F.transform(options, lambda o, i: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, "ABCDE")), i + 1), F.lit("] "), o))
    first = [F.trim(instruction)] if instruction is not None else []
    return F.concat_ws("\n", *first, F.trim(framing), F.lit("The client writes:"), narrative, F.lit("To choose from:"), F.array_join(lettered, "\n"), F.lit(ANSWER))


def rewrite_prompt(mode: Column, text: Column, banned, again: bool = False) -> Column:
    """What a rewriter is asked: implicit texts name the words to leave out, the second time more firmly."""
    rule = "\n\nLeave out all of these words and their forms: " + ", ".join(banned) + "."
    return F.when(mode == "implicit", F.concat(text, F.lit(rule + " Your last answer held one of them; try once more." * again))).otherwise(text)
