"""Scoring prompts by a model's next token: chat template, letters' token ids, and a readout that leaves the logits where they are made.

A model is named, not passed: each Python worker loads it once, with its options, when its first prompt comes, keeps it for later tasks and closes it at
its end. Of a prompt's logits only one number a letter and two more leave the worker, so rows stay small whatever the vocabulary.
"""

from __future__ import annotations

import atexit
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.package import ship

LETTERS = "ABCDE"
#: What the answer begins with, so that the next token is a letter.
PREFILL = "("


class ChatModel(Protocol):
    """``close()``, if there is one, is called when the worker ends."""

    def chat(self, message: str) -> str: ...

    def ids(self, text: str) -> list[int]: ...

    def logits(self, prompts: list[str]) -> np.ndarray: ...


_LOADED: dict[Model, Any] = {}


@dataclass(frozen=True)
class Model:
    """``module:name`` of a class or function and the options it is called with."""

    name: str
    options: tuple[tuple[str, Any], ...] = ()

    def get(self) -> Any:
        """This process's instance; the first call makes it."""
        if self not in _LOADED:
            module, _, attribute = self.name.partition(":")
            if not attribute:
                raise ValueError(f"{self.name}: write module:name")
            made = getattr(importlib.import_module(module), attribute)(**dict(self.options))
            if hasattr(made, "close"):
                atexit.register(made.close)
            _LOADED[self] = made
        return _LOADED[self]


def told_by(ids: Callable[[str], list[int]], prompt: str, n: int) -> list[int]:
    """The token ids that tell the first n letters after a prompt, as ``readout.letter_ids`` finds them."""
    alone, out = ids(prompt), []
    for letter in LETTERS[:n]:
        whole = ids(prompt + letter)
        at = next((i for i, x in enumerate(whole) if i >= len(alone) or x != alone[i]), None)
        if at is None:
            raise ValueError(f"letter {letter!r} has no token of its own")
        out.append(whole[at])
    if len(set(out)) < n:
        raise ValueError(f"two letters have one token: {out}")
    return out


def sample_letters(units: DataFrame, model: Model, n: int, key: str, prefill: str = PREFILL) -> list[int]:
    """The letters' ids after one prompt, the unit of the least key. A worker loads the model, the driver doesn't. No ids without units."""
    ship(units.sparkSession)

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = model.get()
            yield pd.DataFrame({"ids": [told_by(m.ids, m.chat(x) + prefill, n) for x in pdf["user_msg"]]})

    found = units.select(key, "user_msg").orderBy(key, "user_msg").limit(1).select("user_msg").mapInPandas(f, "ids array<int>").collect()
    return found[0]["ids"] if found else []


def read(logits: np.ndarray, letters: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter probabilities, their mass, and whether the largest logit is a letter's, for each row of logits."""
    x = np.asarray(logits, np.float64)
    e = np.exp(x - x.max(axis=1, keepdims=True))
    mass = e[:, letters] / e.sum(axis=1, keepdims=True)
    total = mass.sum(axis=1)
    return mass / np.maximum(total, 1e-9)[:, None], total, np.isin(x.argmax(axis=1), letters)


def letter_scores(units: DataFrame, model: Model, n: int, letters: list[int] | None = None, batch_size: int = 32, prefill: str = PREFILL) -> DataFrame:
    """units (with user_msg) with letter_probs, p_letters and argmax_is_letter. Prompts of like length are scored together. letters: their ids, the same for all
    prompts; without them each prompt's own are found, and prompts are batched by them."""
    ship(units.sparkSession)

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = model.get()
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                prompts = [m.chat(x) + prefill for x in part["user_msg"]]
                ids = [letters or told_by(m.ids, p, n) for p in prompts]
                logits = np.asarray(m.logits(prompts))
                got = [read(logits[i : i + 1], x) for i, x in enumerate(ids)] if letters is None else [read(logits, letters)]
                probs, total, top = (np.concatenate(c) for c in zip(*got, strict=True))
                yield part.assign(letter_probs=list(probs), p_letters=total, argmax_is_letter=top)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in units.dtypes)
    return units.sortWithinPartitions(F.length("user_msg")).mapInPandas(f, f"{fields}, letter_probs array<double>, p_letters double, argmax_is_letter boolean")


class CharacterModel:
    """A stand-in without weights: a character is a token, and logits are hashes of the prompt's characters and their number."""

    def __init__(self, vocabulary: int = 256, device: str = "cpu") -> None:
        self.vocabulary, self.device = vocabulary, device

    def chat(self, message: str) -> str:
        return f"<user>{message}</user><assistant>"

    def ids(self, text: str) -> list[int]:
        return [ord(c) % self.vocabulary for c in text]

    def logits(self, prompts: list[str]) -> np.ndarray:
        seeds = np.array([[sum(p.encode()), len(p)] for p in prompts], np.int64)
        return (seeds[:, :1] * (np.arange(self.vocabulary) + 3) + seeds[:, 1:]) % 101 / 10.0
