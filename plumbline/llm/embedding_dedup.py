"""Near-duplicate vectors by cross-polytope hashing, multiprobe buckets and verified pairs.

A vector is rotated at random by three rounds of sign flips and fast Hadamard transforms; its code is the axis of the
largest absolute coordinate, with its sign. A table's code joins ``halves`` such codes. Vectors are stored in the bucket of their code and
probe those of the PROBES best axes of each half. At cosine 0.93 in 64 dimensions one table finds 0.92 of pairs with one half and 0.84
with two; 4 + 2 * halves tables miss fewer than one in a million with one or two halves, one in 10,000 with four. ``halves`` follows the number
of vectors of a label, so buckets stay small; at most four are joined, beyond which buckets grow, are dealt in blocks, and lose nothing.

Buckets are dealt with what is needed to find candidates only: an id and SKETCH signs of random projections. A member goes on only if
some other's sketch is near enough (five and a half standard deviations allow for chance); then vectors are fetched, once a bucket
and block, and the codes are found again from them. A pair is compared in every bucket that brings it together, but
counted in the first table only, which each side's codes tell; so counts need no pair table, and tasks return a row
for each member: its links found there and its root in the bucket's spanning forest. Equal vectors are one class with a multiplicity.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.buckets import block_pairs, groups
from plumbline.llm.common import mapped, mix64, record, ship, written
from plumbline.llm.components import Forest, components

COSINE = 0.93
PROBES = 3
BUCKET = 512
SKETCH = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, tables: int, halves: int, count: int = PROBES, seed: int = 1) -> np.ndarray:
    """The best axes with their signs of each row's rotations, the best first: rows x tables x halves x count (fewer in a space of fewer
    dimensions)."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    out = np.zeros((n, tables, halves, min(count, wide)), np.int32)
    rng = np.random.default_rng([seed, wide])
    for t in range(tables):
        for k in range(halves):
            r = padded
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], wide))
            best = np.argsort(-np.abs(r), axis=1, kind="stable")[:, : out.shape[3]]
            out[:, t, k] = 2 * best + (np.take_along_axis(r, best, axis=1) < 0)
    return out


def codes(best: np.ndarray) -> np.ndarray:
    """The codes of the buckets that rows store in (the first) and probe: rows x tables x count ** halves."""
    n, tables, halves, count = best.shape
    out = np.zeros((n, tables, count**halves), np.int64)
    for p, way in enumerate(itertools.product(range(count), repeat=halves)):
        for k, j in enumerate(way):
            out[:, :, p] = out[:, :, p] * np.int64(1 << 15) + best[:, :, k, j]
    return out


def meets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of axes (pairs x tables x halves x count), by table: where b probes a's bucket, and where a probes b's."""
    return (b == a[..., :1]).any(axis=3).all(axis=2), (a == b[..., :1]).any(axis=3).all(axis=2)


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs of SKETCH random projections of each row, as two 64-bit words."""
    rng = np.random.default_rng([7, x.shape[1]])
    bits = x @ rng.normal(size=(x.shape[1], SKETCH)) > 0
    return np.packbits(bits, axis=1).view(np.uint64)


def most_apart(cosine: float) -> int:
    """Signs in which sketches of vectors of this cosine differ at most, but for one pair in some ten million."""
    p = np.arccos(min(1.0, cosine)) / np.pi
    return int(np.ceil(SKETCH * p + 5.5 * np.sqrt(SKETCH * p * (1 - p))))


def _classed(kind: str):
    """Vectors to a digest of their values (equal for equal ones), their length and the values as ``kind``."""

    def f(batches):
        for b in batches:
            keys, raw, dims = [], [], []
            for v in b.column("v").to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                a = np.array(v if ok else [], kind) + np.dtype(kind).type(0)  # -0.0 is 0.0
                ok = ok and bool(np.isfinite(a).all()) and bool(a.any())
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(a.tobytes()), np.int64).tolist() if ok else (None, None))
                raw.append(a.tobytes() if ok else None)
                dims.append(len(a) if ok else 0)
            yield record(vec_id=b.column("vec_id"), label=b.column("label"), k1=pa.array([k[0] for k in keys], pa.int64()), k2=pa.array([k[1] for k in keys], pa.int64()), dim=pa.array(dims, pa.int64()), v=pa.array(raw, pa.binary()))

    return f


def _matrix(column, kind: str) -> np.ndarray:
    """Vectors of one length, in double precision."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _dealt(tables: int, halves: int, kind: str):
    """Vectors to the buckets that they store in or probe. A bucket's key is a hash of its group and code."""

    def f(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == d))
                    x = _matrix(part.column("v"), kind)
                    code = codes(axes(x, tables, halves))
                    sketch, grp = sketches(x).view(np.int64), part.column("grp").to_numpy().view(np.uint64)
                    use = np.ones(code.shape, bool)
                    use[:, :, 1:] = code[:, :, 1:] != code[:, :, :1]
                    row, tab, probe = np.nonzero(use)
                    key = mix64(mix64(grp[row]) ^ code[use].view(np.uint64)).view(np.int64)
                    yield record(key=key, tab=tab, stored=pa.array(probe == 0), node=part.column("node").take(pa.array(row)), s1=sketch[row, 0], s2=sketch[row, 1])

    return f


def _plausible(most: int):
    """Buckets to their members that have another's sketch near theirs, one of both being stored."""

    def f(batches):
        for g in groups(batches, ["key", "tab", "lo", "hi"]):
            stored = g.column("stored").to_numpy()
            if len(stored) < 2 or not stored.any():
                continue
            s1, s2 = (g.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            near = np.zeros(len(stored), bool)
            at = np.flatnonzero(stored)
            for k in range(0, len(at), 256):
                i = at[k : k + 256]
                apart = np.bitwise_count(s1[i][:, None] ^ s1[None, :]) + np.bitwise_count(s2[i][:, None] ^ s2[None, :])
                close = apart <= most
                close[np.arange(len(i)), i] = False
                near[i] |= close.any(axis=1)
                near |= close.any(axis=0)
            if near.any():
                t = g.filter(pa.array(near)).combine_chunks()
                yield from t.select(["key", "tab", "node", "stored"]).to_batches()

    return f


def _linked(tables: int, halves: int, cosine: float, kind: str):
    def f(batches):
        for bucket in groups(batches, ["key", "tab", "lo", "hi"]):
            for grp in np.unique(bucket.column("grp").to_numpy()).tolist():  # one, but for equal hashes
                g = bucket.filter(pa.array(bucket.column("grp").to_numpy() == grp))
                stored = g.column("stored").to_numpy()
                if len(stored) < 2 or not stored.any():
                    continue
                own, lo, hi, tab = g.column("own").to_numpy(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py(), g.column("tab")[0].as_py()
                ids, n = g.column("node").to_numpy(), g.column("n").to_numpy()
                v = _matrix(g.column("v"), kind)
                best = np.concatenate([axes(v[k : k + 512], tables, halves) for k in range(0, len(v), 512)])
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                links, forest = np.zeros(len(ids), np.int64), Forest()
                s_all = np.flatnonzero(stored)
                for at in range(0, len(s_all), 512):
                    s = s_all[at : at + 512]
                    i, j = np.nonzero(v[s] @ v.T >= cosine)
                    i = s[i]
                    fits = np.where(own[i] == own[j], lo == hi, True) & (ids[i] != ids[j]) & (~stored[j] | (ids[i] < ids[j]))
                    i, j = i[fits], j[fits]
                    for k in range(0, len(i), 20_000):
                        x, y = i[k : k + 20_000], j[k : k + 20_000]
                        there, back = meets(best[x], best[y])
                        first = ~(there | back)[:, :tab].any(axis=1)
                        first &= stored[y] | ~back[:, tab] | (ids[x] < ids[y])
                        x, y = x[first], y[first]
                        np.add.at(links, x, n[y])
                        np.add.at(links, y, n[x])
                        for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
                            forest.join(a, b)
                got = np.flatnonzero(links)
                if len(got):
                    yield record(u=ids[got], n=links[got], v=np.array([forest.root(a) for a in ids[got].tolist()], np.int64))

    return f


def code_length(vectors: int, dim: int, bucket: int = BUCKET) -> int:
    """How many codes a table joins, so that a bucket of so many random vectors holds about ``bucket`` of them; 4 at most."""
    cells, halves = 2 << max(1, (dim - 1).bit_length()), 1
    while vectors > bucket * cells**halves and halves < 4:
        halves += 1
    return halves


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", bucket: int = BUCKET) -> DataFrame:
    """One row per row of rows: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine in double precision is at
    least ``cosine``. A vector that is null, empty, zero or holds null or non-finite components links with nothing and is its
    own component. Each row is a vector of its own, also where it repeats a vec_id (with the same values or others); a
    component is named by the smallest vec_id in it. Rows without a vec_id are left out; other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    ship(rows.sparkSession)
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).where("vec_id is not null")
    base = base.transform(mapped, _classed(kind), "vec_id long, label string, k1 long, k2 long, dim long, v binary")
    base = written(base.withColumn("node", F.monotonically_increasing_id()).withColumn("grp", F.when(F.expr("label is not null and v is not null"), F.xxhash64("label", "dim"))), "vectors")
    classes = base.where("grp is not null").groupBy("grp", "k1", "k2").agg(F.min("node").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    reps = written(base.select("node", "grp", "dim", "v").join(classes.select(F.col("rep").alias("node"), "n"), "node"), "vectors")
    # the code length of the largest group; its dimensions are those of the label's vectors
    top = reps.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.min("dim").alias("d")).agg(F.max("c").alias("c"), F.min("d").alias("d")).first()
    halves = code_length(top["c"] or 1, top["d"] or 2, bucket)
    tables = 4 + 2 * halves
    thin = reps.transform(mapped, _dealt(tables, halves, kind), "key long, tab long, stored boolean, node long, s1 long, s2 long")
    wanted = block_pairs(thin, ["key", "tab"], "node").transform(mapped, _plausible(most_apart(cosine)), "key long, tab long, node long, stored boolean")
    wanted = written(wanted.distinct(), "wanted")
    fetched = block_pairs(wanted, ["key", "tab"], "node", more=reps.select("node", "grp", "n", "v"))
    found = written(fetched.transform(mapped, _linked(tables, halves, cosine, kind), "u long, n long, v long"), "links")
    links = found.groupBy("u").agg(F.sum("n").alias("more"))
    named = classes.join(components(found.select("u", "v")), F.col("rep") == F.col("node"), "left").select("grp", "k1", "k2", "rep", "n", "least", F.coalesce("root", "rep").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").join(links, F.col("rep") == links["u"], "left")
    out = base.select("vec_id", "grp", "k1", "k2").join(named.select("grp", "k1", "k2", "component", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links")), ["grp", "k1", "k2"], "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
