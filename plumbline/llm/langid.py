"""Language identification by nearest centroid.

A text is a unit vector of log-scaled TF-IDF weights of its letter 1- to 3-grams, hashed to DIM places. Each language has
up to CLUSTERS centroids (spherical k-means), since one language has several kinds of text; the nearest by cosine names
the language, and a text farther from it than nearly all of its training texts is marked as rejected.

Document frequencies count all learning documents. The centroids are fitted on a bounded sample: SAMPLE documents at
most, dealt evenly to the languages, chosen by a hash of doc_id among texts of up to SAMPLE_BYTES bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, record, slices

DIM = 1 << 13
CLUSTERS = 4
SAMPLE = 2400
#: Texts of a language that its centroids are learnt from at least.
LEAST = 8
SAMPLE_BYTES = 1 << 17
UNKNOWN = "und"
_SLICE = 1 << 20
_ROWS = 256


def held_out(doc_id: str = "doc_id"):
    """The documents that nothing may be learnt from: crc32 of the id's decimal digits is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _letters() -> np.ndarray:
    """For each code point of the basic plane, itself if it is a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = c
    return out


_TABLE: list[np.ndarray] = []


def counts(texts: list[str], piece: int = _SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts, a row of DIM for each text, and whether each has a letter. All letters count, whatever their plane. Long texts are
    counted in pieces of ``piece`` characters, each gram in the piece that it begins in."""
    if not _TABLE:
        _TABLE.append(_letters())
    out, has = np.zeros((len(texts), DIM), np.int64), np.zeros(len(texts), bool)
    held: list[tuple[int, str, int]] = []
    room = 0
    for i, t in enumerate(texts):
        low = f" {t.lower()} "
        for s in range(0, max(1, len(low) - 2), piece):
            e = s + piece if s + piece < len(low) - 2 else len(low)
            held.append((i, low[s : e + 2], e - s))
            room += e - s
            if room >= piece:
                _count(held, out, has)
                held, room = [], 0
    if held:
        _count(held, out, has)
    return out, has


def _count(parts: list[tuple[int, str, int]], out: np.ndarray, has: np.ndarray) -> None:
    """Adds the grams of parts (row, characters, how many of them grams begin at) to the rows of out."""
    x = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(x, 0xFFFF)
    c = _TABLE[0][low]
    high = np.flatnonzero(x > 0xFFFF)
    c[high] = [v if chr(v).isalpha() else 32 for v in x[high].tolist()]
    size = np.array([len(p) for _, p, _ in parts])
    row = np.repeat(np.arange(len(parts), dtype=np.int64), size)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    begins = at < np.array([n for *_, n in parts])[row]
    letter = c != 32
    target = np.array([i for i, *_ in parts])
    has[target[row[letter]]] = True
    c = c.astype(np.uint64)
    keys = []
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ c[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some |= letter[k : m + k]
        some &= (row[:m] == row[n - 1 :]) & begins[:m]
        if n == 3:
            some &= letter[1 : m + 1]
        keys.append(row[:m][some] * DIM + (h[some] >> np.uint64(20)).astype(np.int64) % DIM)
    flat = np.bincount(np.concatenate(keys) if keys else np.zeros(0, np.int64), minlength=len(parts) * DIM).reshape(len(parts), DIM)
    if len(np.unique(target)) == len(target):
        out[target] += flat
    else:
        np.add.at(out, target, flat)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def _texts(b: pa.RecordBatch):
    """Runs of up to _ROWS texts of up to about _SLICE bytes."""
    for s in slices(b, "text", _SLICE):
        for i in range(0, s.num_rows, _ROWS):
            part = s.slice(i, _ROWS)
            yield part, [(x or b"").decode("utf-8", "replace") for x in part.column("text").to_pylist()]


def _frequencies(batches):
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, texts in _texts(batch):
            tf, has = counts(texts)
            df += (tf > 0).sum(axis=0)
            n += int(has.sum())
    used = np.flatnonzero(df)
    yield record(place=np.append(used, -1), n=np.append(df[used], n))


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray
    of: np.ndarray  # the language of each centroid
    idf: np.ndarray
    least: np.ndarray  # cosine below which a centroid's texts are rejected

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine with the nearest centroid, 0 to 1) and rejection of each text."""
        tf, has = counts(texts)
        if not len(self.langs):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(tf, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        lang = [self.langs[self.of[k]] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
        return lang, np.where(has, score, 0.0), ~has | (score < self.least[best])


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun at mutually far vectors; deterministic."""
    c = [v.mean(axis=0)]
    c[0] /= max(np.linalg.norm(c[0]), 1e-12)
    near = v @ c[0]
    for _ in range(1, min(k, len(v))):
        c.append(v[int(near.argmin())])
        near = np.maximum(near, v @ c[-1])
    c = np.array(c)
    for _ in range(12):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learns from all rows of docs (doc_id, text, lang) whose lang is not null. Centroids are learnt from about ``sample`` texts, LEAST a language at
    least: so many languages that this doesn't suffice are an error, and texts and centroids on the driver and in the broadcast stay bounded."""
    rows = documents_of(docs, "lang").where(F.col("lang").isNotNull())
    found = rows.select("text").transform(mapped, _frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIM rows at most
    n = max(1, sum(r["n"] for r in found if r["place"] < 0))
    df = np.zeros(DIM)
    for r in found:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    short = rows.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    most = sample // LEAST
    per = {r["lang"]: r["n"] for r in short.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(per) > most:
        raise ValueError(f"over {most} languages: learn them from a larger sample, of {LEAST} texts a language at least")
    if not per:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0, int), idf, np.zeros(0))
    each = sample // len(per)
    share = F.create_map(*[x for lang, k in per.items() for x in (F.lit(lang), F.lit(min(1.0, each / k)))])
    u = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = short.where(u < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text").collect()
    langs, cs, of, least = sorted(per), [], [], []
    for i, lang in enumerate(langs):
        own = [bytes(r["text"]).decode("utf-8", "replace") for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["doc_id"])]
        v = [vectors(tf[has], idf) for k in range(0, len(own), _ROWS) for tf, has in [counts(own[k : k + _ROWS])]]
        v = np.concatenate(v) if v else np.zeros((0, DIM), np.float32)
        if not len(v):
            continue
        c = _clusters(v, clusters)
        cos = v @ c.T
        at = cos.argmax(axis=1)
        for j in range(len(c)):
            d = cos[at == j, j]
            cs.append(c[j])
            of.append(i)
            least.append(float(d.mean() - 4 * d.std()) if len(d) else 0.0)
    if not cs:
        langs = []
    return Model(langs, np.array(cs, np.float32).reshape(len(cs), DIM), np.array(of, int), idf, np.array(least))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rejected. A text that is null or has no letter is ``und`` with
    score 0 and rejected. Rows without a doc_id are left out; an empty table gives an empty result."""
    rows = documents_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x centroids floats

    def f(batches):
        for batch in batches:
            for part, texts in _texts(batch):
                lang, score, rejected = sent.value.predict(texts)
                yield record(doc_id=part.column("doc_id"), lang_pred=pa.array(lang, pa.string()), score=score, rejected=rejected)

    return rows.transform(mapped, f, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score, rejected. Rows as in predict();
    rows that repeat are learnt from each, and predicted each. Of equally near centroids the first counts, in order of the languages' names.
    Without a learnable row all are ``und``."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
