"""MinHash near-dedup with min-max hashing.

A document's set is its word shingles. Each of PERMUTATIONS permutations of 64-bit words gives two signature values, the
smallest and the largest image of the set: two values for one evaluation, each equal for two documents with the probability of
their Jaccard similarity. ROWS values make a band; documents that share a band are candidates (at similarity 0.8 fewer than 4 pairs in
a million are missed, at 0.85 none to speak of), and a link is confirmed on the whole sets.

Only components are wanted, so pairs of the same component needn't be confirmed, and pairs never leave a task. Documents
with equal sets are one class. First each class is tried with its best partner among few pivots of its buckets. Then the members of
different components that share a bucket are compared within it, in blocks, and the bucket returns a spanning forest of
the links. A pair is passed over only if the signatures rule the similarity out (by over five standard deviations) or if its sides are
connected already.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.buckets import groups, open_blocks
from plumbline.llm.common import documents_of, mapped, mix64, record, slices, tidy, written
from plumbline.llm.components import Forest, components

PERMUTATIONS = 48
ROWS = 4
#: Members of a bucket whose sets are in one task, twice.
SETS = 1024
_rng = np.random.default_rng(20_240_602)
_XOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 18
#: Powers of the base and of its inverse, made once a worker.
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, in order."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = _BLANK.search(text, at + PIECE)
            end = cut.start() if cut else end
        part = text[at:end]
        if len(part) <= 2 * PIECE:
            out.append(_hashed(part))
        else:  # it ends in a word of over PIECE bytes
            words = part.split()
            out += [_hashed(b" ".join(words[:-1])), np.array([xxhash.xxh3_64_intdigest(words[-1].lower())], np.uint64)] if words and len(words[-1]) > PIECE else [_hashed(part)]
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashed(part: bytes) -> np.ndarray:
    """By sums of bytes times powers of an odd base, which prefix sums give for all words at once."""
    x = np.frombuffer(part.lower(), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[x], [True]]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    power, back = _powers(max(len(x), 2 * PIECE))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * power[: len(x)], out=total[1:])
    return mix64((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes: its runs of k words; the whole sequence if it has fewer; none without words."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(s: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The smallest and largest image of a set (not empty) under each permutation, as 32-bit words."""
    low, high = np.full(permutations, np.iinfo(np.uint64).max, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(s), 1024):
        x = (s[None, at : at + 1024] ^ _XOR[:permutations, None]) * _MUL[:permutations, None]
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    both = np.stack([low, high], axis=1).reshape(-1)
    return ((both * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _signed(k: int):
    def f(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                n, k1, k2, sig, bands = [], [], [], [], []
                for t in b.column("text").to_pylist():
                    s = shingles(t, k)
                    n.append(len(s))
                    if not len(s):
                        for x in (k1, k2, sig, bands):
                            x.append(None)
                        continue
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    g = signature(s)
                    k1.append(int(d[0]))
                    k2.append(int(d[1]))
                    sig.append(g.tobytes())
                    raw = g.tobytes()
                    bands.append([xxhash.xxh3_64_intdigest(raw[i : i + 4 * ROWS], i) - (1 << 63) for i in range(0, len(raw), 4 * ROWS)])
                yield record(doc_id=b.column("doc_id"), n=pa.array(n, pa.int64()), k1=pa.array(k1, pa.int64()), k2=pa.array(k2, pa.int64()), sig=pa.array(sig, pa.binary()), bands=pa.array(bands, pa.list_(pa.int64())))

    return f


def _sets(k: int):
    def f(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                yield record(doc_id=b.column("doc_id"), s=pa.array([shingles(t, k).tobytes() for t in b.column("text").to_pylist()], pa.binary()))

    return f


def _confirmed(percent: int):
    def f(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield record(u=batch.column("u"), v=batch.column("v"), ok=pa.array(ok, pa.bool_()))

    return f


def _alike(batches):
    """Pairs with both signatures to pairs with the number of equal values."""
    for b in batches:
        same = [int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
        yield record(u=b.column("u"), v=b.column("v"), same=pa.array(same, pa.int64()))


def _across(least: int, percent: int):
    """Buckets (their rows with component, set size, signature and bands) to their members that may have a link to another
    component for which this is the first bucket in common. Pairs stay within the task."""

    def f(batches):
        for g in groups(batches, ["band", "key", "lo", "hi"]):
            own, lo, hi, band = g.column("own").to_numpy(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py(), g.column("band")[0].as_py()
            ids, comp, n = (g.column(c).to_numpy() for c in ("doc_id", "comp", "n"))
            if (comp == comp[0]).all():
                continue
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            bands = g.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            wanted = np.zeros(len(ids), bool)
            for i, others in open_pairs(comp, n, percent):
                j = others[(own[others] != own[i]) | (lo == hi)]
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
                j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
                if len(j):
                    wanted[i] = True
                    wanted[j] = True
            if wanted.any():
                yield record(band=np.full(wanted.sum(), band, np.int64), key=np.full(wanted.sum(), g.column("key")[0].as_py(), np.int64), doc_id=ids[wanted])

    return f


def open_pairs(comp: np.ndarray, n: np.ndarray, percent: int):
    """Each member outside the largest component, with the members of other components whose set size allows a link. Each pair
    of different components' members is there at least once."""
    names, size = np.unique(comp, return_counts=True)
    most = names[size.argmax()]
    for i in np.flatnonzero(comp != most).tolist():
        fits = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        fits[:i] &= comp[:i] == most  # the others have met already
        j = np.flatnonzero(fits)
        if len(j):
            yield i, j


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of incidence matrices, some thousand
    elements at a time."""
    flat = np.concatenate([*a, *b])
    kinds, place = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(kinds), 8192):
        lo, hi = np.searchsorted(place, [at, at + 8192])
        m = np.zeros((len(a) + len(b), min(8192, len(kinds) - at)), np.float32)
        m[row[lo:hi], place[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _joined(percent: int):
    """Buckets (their rows with component and set) to links between components, a spanning forest of them."""

    def f(batches):
        for g in groups(batches, ["band", "key", "lo", "hi"]):
            ids, comp = (g.column(c).to_numpy() for c in ("doc_id", "comp"))
            if (comp == comp[0]).all():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g.column("s").to_pylist()]
            n = np.array([len(x) for x in sets])
            names, size = np.unique(comp, return_counts=True)
            few, every = np.flatnonzero(comp != names[size.argmax()]), np.arange(len(ids))
            forest, u, v = Forest(), [], []
            for p in range(0, len(few), 256):
                x = few[p : p + 256]
                for q in range(0, len(every), 256):
                    y = every[q : q + 256]
                    apart = comp[x][:, None] != comp[y][None, :]
                    if not apart.any():
                        continue
                    both = common_counts([sets[i] for i in x], [sets[j] for j in y])
                    linked = apart & (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both))
                    for i, j in np.argwhere(linked).tolist():
                        if forest.join(int(comp[x[i]]), int(comp[y[j]])):
                            u.append(int(ids[x[i]]))
                            v.append(int(ids[y[j]]))
            if u:
                yield record(u=np.array(u, np.int64), v=np.array(v, np.int64))

    return f


def least_equal(percent: int) -> int:
    """Equal signature values that a pair of this similarity falls short of less than once in ten million."""
    m, p = 2 * PERMUTATIONS, percent / 100
    return max(0, int(m * p - 5.3 * np.sqrt(m * p * (1 - p))))


def near_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its own).

    Documents link if 100 * intersection >= percent * union of their sets. A text that is null or has no words has an empty
    set, links with nothing and is kept. Rows that repeat a doc_id belong to one component, and it links by any of their
    sets. Rows without a doc_id are left out; an empty table gives an empty result.
    """
    rows = written(documents_of(docs).transform(mapped, _signed(shingle), "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>"), "signatures")
    some = rows.where("n > 0")
    classes = written(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    members = some.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])
    shared = members.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("u", "v")  # of repeated ids
    reps = written(some.join(classes, ["k1", "k2"]).where("doc_id = rep").dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n", "sig", "bands"), "signatures")
    spread = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # few pivots a bucket: the smallest ids, and the smallest of two other orders
    first, second = (F.min_by("doc_id", F.xxhash64(F.lit(s), F.col("doc_id"))) for s in (1, 2))
    sizes = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.array_distinct(F.array(F.min("doc_id"), first, second)).alias("pivots")).where("m > 1")
    buckets = written(spread.join(sizes, ["band", "key"]).select("band", "key", "doc_id", "pivots"), "buckets")
    tried = buckets.select(F.col("doc_id").alias("u"), F.explode("pivots").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = least_equal(percent)
    sig = reps.select("doc_id", "n", "sig")
    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    likely = tried.join(sig.select(F.col("doc_id").alias("u"), F.col("sig").alias("sa"), F.col("n").alias("na")), "u").join(sig.select(F.col("doc_id").alias("v"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "v").where(sized)
    likely = written(likely.select("u", "v", "sa", "sb").transform(mapped, _alike, "u long, v long, same long").where(F.col("same") >= least), "pairs")
    both = likely.union(likely.select(F.col("v").alias("u"), F.col("u").alias("v"), "same"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("same", "v")).alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    ids = buckets.select("doc_id").distinct()  # one shuffle of texts for all comparisons
    sets = documents_of(docs).join(ids, "doc_id", "left_semi").transform(mapped, _sets(shingle), "doc_id long, s binary")
    repeated = not shared.isEmpty() or not some.groupBy("doc_id", "k1", "k2").count().where("count > 1").isEmpty()
    sets = written(sets.dropDuplicates() if repeated else sets, "sets")  # of a doc_id that repeats, all its sets count
    tidy(docs.sparkSession)
    both = best.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("sa")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sb")), "v")
    links = written(both.transform(mapped, _confirmed(percent), "u long, v long, ok boolean").where("ok").select("u", "v"), "links").union(shared)
    roots = written(components(links), "roots")
    named = buckets.select("band", "key", "doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select(F.col("band").cast("long").alias("band"), "key", "doc_id", F.coalesce("root", "doc_id").alias("comp"))
    wanted = written(open_blocks(named, ["band", "key"], "doc_id", [reps.select("doc_id", "n", "sig", "bands")]).transform(mapped, _across(least, percent), "band long, key long, doc_id long").distinct(), "wanted")
    compared = open_blocks(wanted.join(named, ["band", "key", "doc_id"]), ["band", "key"], "doc_id", [sets], block=SETS)
    more = written(compared.transform(mapped, _joined(percent), "u long, v long"), "links")
    roots = written(components(links.union(more)), "roots")
    ids = classes.join(roots, classes["rep"] == roots["node"], "left").select("k1", "k2", F.coalesce("root", "rep").alias("comp"))
    own = F.coalesce("comp", "doc_id")
    return rows.join(ids, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id, all columns kept. Of rows that repeat its
    doc_id one stays; rows without a doc_id all stay."""
    stay = near_documents(docs, shingle, percent).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    stay = written(stay, "kept")
    one, more = stay.where("_n = 1"), stay.where("_n > 1")
    once = docs.join(one, docs["doc_id"].cast("long") == one["_id"], "left_semi")
    if not more.isEmpty():
        once = once.unionByName(docs.join(more, docs["doc_id"].cast("long") == more["_id"], "left_semi").dropDuplicates(["doc_id"]))
    return once.unionByName(docs.where(docs["doc_id"].isNull()))
