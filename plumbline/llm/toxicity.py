"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are words (what stands between white space, lower-cased, without punctuation at the ends, with marks for both ends; letters
spelt apart form one more word). The kernel counts common subsequences of three characters with at most two inserted among them in all (``_STEPS``); one
with g inserted weighs DECAY^g in its word, so ``id.iot`` and ``idi0ot`` stay near ``idiot`` (``i--d--i--o--t``, with two between any two letters, doesn't). Landmarks are training
words; the Nystroem map K_mm^(-1/2) k(., landmarks) makes the kernel machine linear.

Sentences and documents are labelled, not words, so the machine is a multiple-instance one: all words of clean sentences
are negative, and words that mark toxic ones positive, found anew from its own scores in each round. A document is scored by a logistic curve
from its two most toxic words and from how many words are toxic among how many. Since the kernel has an explicit map, the trained machine is folded into one
table of weights by hashed subsequence, and scoring a word is a sum of table entries: the same value as through
the landmarks.

The curve is fitted on documents that a machine trained on the others hasn't seen, then the machine on all of them. Fitted on a
bounded sample: up to SAMPLE toxic and CLEAN * SAMPLE clean documents, chosen by a hash of doc_id, of up to SAMPLE_BYTES bytes.
"""

from __future__ import annotations

import gc
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, record, slices
from plumbline.llm.langid import held_out

SAMPLE = 1200
CLEAN = 3
SAMPLE_BYTES = 1 << 17
LANDMARKS = 128
NEGATIVES = 9_000
ROUNDS = 3
COST = 4.0
#: A clean word weighs (1 + its documents) to this power; a toxic one, its documents.
POWER = 0.5
#: The score from which an unclear word of toxic documents becomes positive.
EXPAND = 0.0
DECAY = 0.6
BITS = 20
_STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
_WORDS = 150_000
#: Fewer different words than the first, or more than the second, count as so many.
_LENGTHS = (40, 1500)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> set[str]:
    """The different words, and the words spelt in single letters."""
    parts = text.lower().split()
    out = {w.strip(_MARKS) for w in set(parts)}
    out.discard("")
    if sum(len(w) == 1 for w in out) > 2:
        run = ""
        for w in [*parts, "  "]:
            if len(w) == 1:
                run += w
            else:
                if len(run) > 3:
                    out.add(run)
                run = ""
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number, hashed subsequence and weight of each subsequence, and each word's norm."""
    marked = [f"\x02{w}\x03" for w in words]
    x = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    rows, keys, weights = [], [], []
    for a, b in _STEPS:
        m = len(x) - a - b
        if m <= 0:
            continue
        inside = row[:m] == row[a + b :]
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31)) ^ x[a : m + a]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29)) ^ x[a + b :]) * np.uint64(0x94D049BB133111EB)
        keys.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[:m][inside])
        weights.append(np.full(len(rows[-1]), DECAY ** (a + b - 2), np.float64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.ones(len(words))
    rows, keys, weights = map(np.concatenate, (rows, keys, weights))
    norm = np.sqrt(np.bincount(rows, weights * weights, minlength=len(words)))
    return rows, keys, weights, np.maximum(norm, 1e-12)


def table_scores(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    rows, keys, weights, norm = subsequences(words)
    return np.bincount(rows, weights * table[keys], minlength=len(words)) / norm + bias


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each word with each landmark."""
    out = np.zeros((len(words), len(landmarks)))
    dense = np.zeros(1 << BITS)
    r, k, w, norm = subsequences(words)
    for j, mark in enumerate(landmarks):
        _, lk, lw, ln = subsequences([mark])
        np.add.at(dense, lk, lw / ln[0])
        out[:, j] = np.bincount(r, w * dense[k], minlength=len(words)) / norm
        dense[lk] = 0
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton's method on the rows inside the margin."""
    m = x.shape[1]
    w = np.zeros(m + 1)
    for _ in range(20):
        lhs, rhs = np.eye(m + 1), np.zeros(m + 1)
        lhs[-1, -1] = 1e-3
        for at in range(0, len(x), 2048):
            part = np.hstack([x[at : at + 2048].astype(np.float64), np.ones((len(x[at : at + 2048]), 1))])
            inside = y[at : at + 2048] * (part @ w) < 1
            part, k = part[inside], (c * weight[at : at + 2048])[inside]
            lhs += (part * k[:, None]).T @ part
            rhs += part.T @ (k * y[at : at + 2048][inside])
        new = np.linalg.solve(lhs, rhs)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    table: np.ndarray | None  # none: all texts score the prior
    bias: float
    curve: np.ndarray  # of the logistic, for the columns of summary()
    prior: float

    def score(self, texts: list[str], cache: dict[str, float]) -> np.ndarray:
        """0 to 1 for each text; cache: scores of words seen before."""
        if self.table is None:
            return np.full(len(texts), self.prior)
        own = [words_of(t) for t in texts]
        new = list(set().union(*own).difference(cache))
        if len(cache) + len(new) > _WORDS:
            cache.clear()
            new = list(set().union(*own))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            cache.update(zip(part, table_scores(part, self.table, self.bias).tolist(), strict=True))
        return logistic(summary([list(map(cache.__getitem__, ws)) for ws in own]) @ self.curve)


def summary(margins: list) -> np.ndarray:
    """Rows of 1, the largest and the second largest margin (within -3 and 3), the log of how many words are toxic (each by a
    steep logistic) and the log of how many there are. A text without words has margins of -3."""
    out = np.zeros((len(margins), 5))
    out[:, 0] = 1
    out[:, 1:3] = -3
    for i, m in enumerate(margins):
        if len(m):
            x = np.asarray(m)
            k = np.partition(x, len(x) - 2)[-2:] if len(x) > 1 else np.array([-3.0, x[0]])
            out[i, 1:] = k[1], k[0], np.log1p(logistic(8 * x).sum()), np.log(np.clip(len(x), *_LENGTHS))
    out[:, 1:3] = np.clip(out[:, 1:3], -3, 3)
    out[:, 4] = np.where(out[:, 4] > 0, out[:, 4], np.log(_LENGTHS[0]))
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Logistic regression by Newton's method. More evidence (the columns 1 to 3) never counts against toxicity: a column that
    would is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        z = x[:, use]
        for _ in range(50):
            p = logistic(z @ w[use])
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(h, z.T @ (p - y) + ridge * w[use])
            w[use] -= step
            if np.abs(step).max() < 1e-8:
                break
        if not (w[1:4] < 0).any():
            return w
        use[1 + int(w[1:4].argmin())] = False


class Bags:
    """The words of labelled texts as numbers, so that training holds no texts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[tuple, int, np.ndarray]] = []

    def add(self, order: tuple, text: str, label: int) -> None:
        bag = np.array([self.number.setdefault(w, len(self.number)) for w in sorted(words_of(text))], np.int32)
        self.rows.append((order, label, bag))

    def ordered(self) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """Words, bags and labels by the texts' order, whatever order they came in: words are numbered as they first occur."""
        self.rows.sort(key=lambda r: r[0])
        bags, y = [b for _, _, b in self.rows], np.array([label for _, label, _ in self.rows], int)
        seen, first = np.unique(np.concatenate([np.zeros(0, np.int32), *bags]), return_index=True)
        order = seen[np.argsort(first)]
        place = np.zeros(len(self.number), np.int32)
        place[order] = np.arange(len(order))
        names = list(self.number)
        return [names[i] for i in order.tolist()], [place[b] for b in bags], y


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """Texts and their labels (1 or 0)."""
    bags = Bags()
    for i, (t, label) in enumerate(zip(texts, toxic, strict=True)):
        bags.add((i,), t, label)
    return train_bags(bags, landmarks, seed)


def train_bags(given: Bags, landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """All texts score the share of toxic ones unless both labels have words."""
    words, bags, y = given.ordered()
    prior = float(y.mean()) if len(y) else 0.0
    if not all(any(len(b) for b, t in zip(bags, y, strict=True) if t == label) for label in (0, 1)):
        return Model(None, 0.0, np.zeros(5), prior)
    unseen = np.arange(len(y)) % 3 == 0 if y.sum() >= 60 else np.zeros(len(y), bool)
    first = _machine(words, bags, y, ~unseen, landmarks, seed)[2]
    if not unseen.any():
        unseen = ~unseen
    curve = _curve(summary([first[b] for b, c in zip(bags, unseen, strict=True) if c]), y[unseen].astype(float))
    table, bias, _ = _machine(words, bags, y, np.ones(len(y), bool), landmarks, seed) if not unseen.all() else _machine(words, bags, y, unseen, landmarks, seed)
    return Model(table, bias, curve, prior)


def _machine(words: list[str], bags: list[np.ndarray], y: np.ndarray, use: np.ndarray, landmarks: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """The multiple-instance machine of the documents in use: its table and bias, and the scores of all words."""
    bags, y = [b for b, c in zip(bags, use, strict=True) if c], y[use]
    bad, good = (np.bincount(np.concatenate([b for b, t in zip(bags, y, strict=True) if t == label]), minlength=len(words)) for label in (1, 0))
    n_bad, n_good = int(y.sum()), max(1, int((1 - y).sum()))
    rng = np.random.default_rng(seed)
    ratio = (bad / n_bad) / ((good + 0.5) / n_good)
    positive = (bad >= (3 if n_bad >= 60 else 2)) & (ratio > 8)
    if not positive.any():
        order = sorted(np.flatnonzero(bad).tolist(), key=lambda i: (-ratio[i], words[i]))
        positive[order[:8]] = True
    clean = np.flatnonzero(good)
    negative = np.zeros(len(words), bool)
    negative[clean[np.argsort(-good[clean], kind="stable")[: NEGATIVES // 3]]] = True
    negative[rng.choice(clean, min(len(clean), NEGATIVES), replace=False)] = True
    for step in range(ROUNDS):
        negative &= ~positive
        pos = np.flatnonzero(positive)
        pos = pos[np.argsort(-bad[pos], kind="stable")]
        neg = np.flatnonzero(negative)
        marks = [words[i] for i in [*pos[:landmarks], *rng.choice(neg, min(len(neg), landmarks), replace=False)]]
        pos = pos[: NEGATIVES // 2]
        kmm = kernel(marks, marks)
        values, vecs = np.linalg.eigh((kmm + kmm.T) / 2)
        keep = values > 1e-4 * values.max()
        root = vecs[:, keep] / np.sqrt(values[keep])
        every = np.concatenate([pos, neg])
        x = np.empty((len(every), root.shape[1]), np.float32)  # filled in place: the largest array of training, held once
        for k in range(0, len(every), 2048):
            x[k : k + 2048] = kernel([words[i] for i in every[k : k + 2048]], marks) @ root
        sign = np.repeat([1.0, -1.0], [len(pos), len(neg)])
        weight = np.concatenate([bad[pos].astype(float), (1.0 + good[neg]) ** POWER])
        if len(neg):
            weight[sign > 0] *= max(1.0, 0.5 * weight[sign < 0].sum() / weight[sign > 0].sum())
        w, bias = svm(x, sign, weight, COST)
        alpha = root @ w
        del x  # before all words are scored
        table = np.zeros(1 << BITS)
        for a, mark in zip(alpha, marks, strict=True):
            _, k, v, norm = subsequences([mark])
            np.add.at(table, k, a * v / norm[0])
        s = np.concatenate([table_scores(words[i : i + 8_000], table, bias) for i in range(0, len(words), 8_000)])
        if step == ROUNDS - 1:
            break
        positive |= (bad > 1) & (good == 0) & (s > EXPAND)
        for bag, t in zip(bags, y, strict=True):  # the witness of a toxic text that has none yet
            if t and len(bag) and not positive[bag].any():
                u = bag[s[bag].argmax()]
                positive[u] |= s[u] > -0.5 and good[u] == 0
        negative |= (good > 0) & ~positive & (s > -0.5)
    return table, bias, s


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows of labels (doc_id, toxic) that are not held out and not null. If a document has several labels, it is
    toxic if any says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(u < F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, CLEAN * sample / max(1, n.get(0, 0))))))
    rows = documents_of(docs).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES)  # about (1 + CLEAN) * SAMPLE rows of two numbers

    def f(batches):
        bags = Bags()
        for batch in batches:
            for d, t, y in zip(*(batch.column(c) for c in ("doc_id", "text", "toxic")), strict=True):
                t = t.as_py()
                bags.add((d.as_py(), hashlib.sha256(t).digest()), t.decode("utf-8", "replace"), y.as_py())
        m = train_bags(bags)
        del bags
        gc.collect()
        yield record(table=pa.array([None if m.table is None else m.table.astype("<f4").tobytes()], pa.binary()), bias=[float(m.bias)], curve=pa.array([m.curve.tolist()], pa.list_(pa.float64())), prior=[float(m.prior)])

    # one task, since the sample is bounded
    r = rows.select("doc_id", "text", "toxic").repartition(1).transform(mapped, f, "table binary, bias double, curve array<double>, prior double").first()
    if r is None:
        return Model(None, 0.0, np.zeros(5), 0.0)
    return Model(None if r["table"] is None else np.frombuffer(r["table"], "<f4").astype(np.float64), r["bias"], np.array(r["curve"]), r["prior"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted. Null and empty texts get the score of a text without words. Rows
    without a doc_id are left out; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def f(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            for b in slices(batch, "text"):
                s = sent.value.score([(x or b"").decode("utf-8", "replace") for x in b.column("text").to_pylist()], cache)
                yield record(doc_id=b.column("doc_id"), score=pa.array(s, pa.float64()), predicted=pa.array((s >= 0.5).astype(np.int32)))

    return documents_of(docs).transform(mapped, f, "doc_id long, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from labels that are not held out."""
    return scored(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score as toxic, all columns and all other rows kept (also those without a doc_id)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def f(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            for b in slices(batch, "text"):
                s = sent.value.score([x or "" for x in b.column("text").to_pylist()], cache)
                yield b.filter(pa.array(s < 0.5))

    return docs.transform(mapped, f, docs.schema)
