"""Near-duplicate texts by Jaccard similarity of word shingles: exact by an inverted index, and MinHash banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.sources.package import ship
from plumbline.sources.stored import scratch, tidy, written


#: Rows of a common shingle or band that meet in a task, of each of two blocks.
BLOCK = 2048
#: Bits of a shingle's hash by which its rareness is counted: a table of 8 MB.
SLOTS = 20
#: Keys of classes that meet in one round, and the most rounds: each round leaves the disk before the next.
KEYS, ROUNDS = 1 << 22, 8
#: Pairs of classes whose sets are made and compared in one round, the rows for each of its pairs, and the most rounds.
PAIRS, SPARE, CHECKS = 1 << 18, 6, 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def run_hashes(tokens: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts given as hashes of their tokens, one after another, to the sorted hashes of each text's different runs of n tokens (a shorter
    text is one run, an empty one an empty run), one after another, and where each text's end."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - begin
    many = np.maximum(size - n, 0) + 1
    row = np.repeat(np.arange(len(size)), many)
    at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    h = np.full(len(row), 0x9E3779B97F4A7C15, np.uint64)
    padded = np.append(tokens, np.zeros(n, np.uint64))
    for j in range(n):
        inside = j < size[row]
        h = np.where(inside, _mixed(h * np.uint64(3) + padded[np.minimum(at + j, len(tokens))]), h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.cumsum(np.bincount(row[new], minlength=len(size)))


def _runs(n: int):
    def f(batches):
        for b in batches:
            t = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            ends = t.offsets.to_numpy()[1:].astype(np.int64) - t.offsets[0].as_py()
            h, upto = run_hashes(t.flatten().to_numpy().view(np.uint64), ends, n)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], [b.schema.names[0], "s"])

    return f


def shingle_sets(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, s): the sorted hashes of each text's different shingles, within the row. The JVM splits texts and hashes tokens; runs of
    their hashes are made in Arrow batches, since nested array functions are interpreted. A null text has no tokens."""
    ship(df.sparkSession)
    toks = df.select(key, F.coalesce(F.transform(T.tokens(F.lower(text)), lambda w: F.xxhash64(w)), F.array().cast("array<long>")).alias("_t"))
    return toks.mapInArrow(_runs(n), f"`{key}` {df.schema[key].dataType.simpleString()}, s array<long>")


def classes(df: DataFrame, key: str, text: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Texts of equal sets as one class, told apart by 128 bits of the set: (key, c1, c2) of each row, and (c1, c2, rep, copies, s) of
    each class, rep being its smallest key."""
    sets = shingle_sets(df, key, text, n).withColumn("c1", F.xxhash64("s")).withColumn("c2", F.xxhash64(F.lit(1), F.reverse("s")))
    rows = written(sets.select(F.col(key).alias("k"), "c1", "c2"), "shingles")  # without the sets, which are made again rather than written twice
    least = rows.groupBy("c1", "c2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"))
    own = sets.select(F.col(key).alias("rep"), "c1", "c2", "s").dropDuplicates(["rep", "c1", "c2"])
    return rows, written(least.join(own, ["c1", "c2", "rep"]), "classes")  # read several times: sets are shuffled once


def _partitions(df: DataFrame) -> int:
    """As many as the session says: cells of blocks are few bytes but much work, so adaptive execution must not join them by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _marked(reps: DataFrame) -> DataFrame:
    """reps (rep, s) with n, the set's size, and m, a bitmap of 256 bits in which each member turns one bit round: two bitmaps differ in no more bits than
    the sets have members that the other lacks."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate(F.filter("s", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(3)) == i), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    return reps.select("rep", F.size("s").alias("n"), F.array(*[word(i) for i in range(4)]).alias("m"), "s")


def met_pairs(rows: DataFrame, on: str, threshold: float, more: Column | None = None, block: int = BLOCK, marks: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, of classes (rep, n, m and other columns; m can be given apart, as marks (rep, m), so that only rows that meet carry it) that meet under a value of ``on`` and could be at the threshold by their sizes and bitmaps, and by
    ``more``, a condition on the columns of both, named with _a and _b.

    The rows of a value are dealt to blocks, and each pair of blocks is a cell of its own, compared by one task: however many rows a value has, a cell sees
    2 * block of them about, and no pair is left out. All conditions hold within the join, before a row leaves it.
    """
    blocks = F.ceil(F.col("_c") / F.lit(block)).cast("int")
    sizes = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    rows = rows.join(sizes, on)
    if marks is not None:
        rows = rows.join(marks, "rep")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(F.lit(5), "rep"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("_lo", F.least("_own", "_j")).withColumn("_hi", F.greatest("_own", "_j")).drop("_c", "_j")
    cell = [on, "_lo", "_hi"]
    dealt = written(dealt, "cells")
    sides = [dealt.select(*cell, *[F.col(c).alias(f"{c}_{side}") for c in dealt.columns if c not in cell]).repartition(_partitions(rows), *cell) for side in "ab"]
    na, nb = F.col("n_a"), F.col("n_b")
    apart = sum((F.bit_count(F.get("m_a", F.lit(i)).bitwiseXOR(F.get("m_b", F.lit(i)))) for i in range(4)), F.lit(0))
    near = (F.col("rep_a") < F.col("rep_b")) & ((F.col("_own_a") != F.col("_own_b")) | (F.col("_lo") == F.col("_hi")))
    near &= (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & ((na + nb - apart) / 2 >= (na + nb) * threshold / (1 + threshold) - 1e-9)
    both = sides[0].join(sides[1], cell).where(near if more is None else near & more)
    return both.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs of classes whose whole sets are at the threshold."""
    pairs = written(pairs, "candidates")  # few as a rule: then Spark knows it, and only the sets that they name are shuffled
    reps = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _counts(reps: DataFrame) -> np.ndarray:
    """How many shingles of all sets have each value of their first SLOTS bits: a table of bounded size, whatever the input's."""

    def f(batches):
        n = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - SLOTS), minlength=1 << SLOTS)
        i = np.flatnonzero(n)
        for lo in range(0, len(i), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + (1 << 16)].astype(np.int32)), pa.array(n[i[lo : lo + (1 << 16)]])], ["i", "n"])

    got = reps.select("s").mapInArrow(f, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOTS, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


def _prefixes(sent, threshold: float):
    """Of each set the shingles that a pair at the threshold must share one of, the rarest first, and how many."""

    def f(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h.view(np.int64), sent.value[h >> np.uint64(64 - SLOTS)], row))
        keep = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        return h[order[place < keep[row]]], keep

    return f


def _signed(keys):
    """(key, s) to (key, c1, c2, n, m, w, keys): 128 bits that tell the set from others, its size, its bitmap as _marked() makes it, a bitmap of two to four
    bits a member, and the keys by which it meets others."""

    def lists(flat: np.ndarray, many: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(flat.view(np.int64)))

    def f(batches):
        for b in batches:
            if not b.num_rows:
                continue
            h, n = b.column(1).flatten().to_numpy().view(np.uint64), b.column(1).value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(n) - n  # no set is empty
            told = [np.add.reduceat(_mixed(_mixed(h ^ np.uint64(x)) + np.uint64(x)), start).view(np.int64) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
            bit, word = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(6) & np.uint64(3)
            marks = np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), start) for i in range(4)], axis=1)
            words = 1 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)
            ends = np.cumsum(words)
            wide = np.zeros(int(ends[-1]), np.uint64)
            np.bitwise_xor.at(wide, np.repeat(ends - words, n) + ((h >> np.uint64(6)).astype(np.int64) & np.repeat(words - 1, n)), bit)
            held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int32)), pa.py_buffer(wide)])
            columns = [b.column(0), *map(pa.array, told), pa.array(n.astype(np.int32)), lists(marks.ravel(), np.full(len(n), 4)), held, lists(*keys(h, n))]
            yield pa.RecordBatch.from_arrays(columns, [b.schema.names[0], "c1", "c2", "n", "m", "w", "keys"])

    return f


def _entries(round_: int, rounds: int):
    """(rep, n, keys) to (rep, n, p, h): those keys, with their places, that meet in a round."""

    def f(batches):
        for b in batches:
            keys = b.column(2)
            h, many = keys.flatten().to_numpy(), keys.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many)
            got = np.flatnonzero(_mixed(h.view(np.uint64)) % np.uint64(rounds) == np.uint64(round_))
            for lo in range(0, len(got), 1 << 14):
                at = got[lo : lo + (1 << 14)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), b.column(1).take(pa.array(row[at])), pa.array(place[at].astype(np.int32)), pa.array(h[at])], ["rep", "n", "p", "h"])

    return f


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the other's length: the sets differ by as many members at least."""
    one, two, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), [len(x), len(y)]
    while size[0] != size[1]:
        if size[0] < size[1]:
            one, two, size = two, one, size[::-1]
        size[0] //= 2
        one = (one >> 8 * size[0]) ^ (one & ((1 << 8 * size[0]) - 1))
    return (one ^ two).bit_count()


def _near(threshold: float):
    """(a, b, na, wa, nb, wb) to the pairs that could be at the threshold by their long bitmaps."""

    def f(batches):
        for b in batches:
            na, wa, nb, wb = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [(p + q - _apart(x, y)) / 2 >= (p + q) * threshold / (1 + threshold) - 1e-9 for p, x, q, y in zip(na, wa, nb, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return f


def _nearer(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (rep, n, w) but for those whose long bitmaps differ too much: 256 bits say little of sets of many hundreds."""
    kind = signed.schema["rep"].dataType.simpleString()
    pairs = written(pairs, "pairs")  # Spark knows how many there are: bitmaps of others are not shuffled
    some = signed.select("rep", "n", "w").join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    both = pairs.join(some.toDF("a", "na", "wa"), "a").join(some.toDF("b", "nb", "wb"), "b")
    return both.select("a", "b", "na", "wa", "nb", "wb").mapInArrow(_near(threshold), f"a {kind}, b {kind}")


def _met(signed: DataFrame, threshold: float, more: Column | None, block: int = BLOCK, round_: int = 0, rounds: int = 1) -> DataFrame:
    """met_pairs() of the keys of classes (rep, n, m, keys), or of a round's."""
    kind = signed.schema["rep"].dataType.simpleString()
    rows = signed.select("rep", "n", "keys").mapInArrow(_entries(round_, rounds), f"rep {kind}, n int, p int, h long")
    return met_pairs(rows, "h", threshold, more, block, signed.select("rep", "m"))


def _with_keys(sets: DataFrame, keys) -> DataFrame:
    key, kind = sets.columns[0], sets.schema[0].dataType.simpleString()
    return sets.mapInArrow(_signed(keys), f"`{key}` {kind}, c1 long, c2 long, n int, m array<long>, w binary, keys array<long>")


def _by_prefix(sets: DataFrame, threshold: float):
    return _prefixes(sets.sparkSession.sparkContext.broadcast(_counts(sets)), threshold)


def _room(threshold: float) -> Column:
    """Positional filter of two places of one shingle in their prefixes."""
    enough = (F.col("n_a") + F.col("n_b")) * threshold / (1 + threshold) - 1e-9
    return F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= enough  # from here on; most at the first that both have


def class_links(reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, jaccard) for pairs of classes (rep, s) at or over the threshold, a < b.

    Prefix filter: each set is put in one order, the rarest shingles first (by how many shingles share 20 bits of their hash, so that a small table says it and
    no shingle is shuffled for it; any order is right), and only as many of them are joined as a pair at the
    threshold must share one of. A pair is a candidate where such a shingle meets, and only if the lengths, both places (positional filter) and
    the bitmaps of the whole sets leave room for enough in common, so most of the pairs of a common shingle end in the join.
    """
    signed = written(_with_keys(reps.select("rep", "s"), _by_prefix(reps, threshold)), "signed")
    return verified(_met(signed, threshold, _room(threshold), block), reps, threshold)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.7, n: int = 5) -> DataFrame:
    """(a, b, jaccard) for all pairs of rows at or over the threshold, a < b: copies make all their pairs, which is what this
    returns; duplicated() needs none of them."""
    rows, reps = classes(df, key, text, n)
    members = rows.join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).select("k", "rep")
    links = class_links(reps, threshold)
    out = links.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select("x", "y", "jaccard")
    copies = members.toDF("x", "r").join(members.toDF("y", "r"), "r").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return out.union(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _checked(pairs: DataFrame, df: DataFrame, key: str, text: str, threshold: float, n: int, told: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) of classes at the threshold by their whole sets, which are made anew from the texts, in rounds: what a round shuffles is bounded by its pairs.
    told: (rep, c1, c2) of all classes; rows: how many rows there are."""
    spark, total = df.sparkSession, pairs.count()
    rounds = min(max(-(-total // PAIRS), -(-total * SPARE // max(rows, 1)), 1), CHECKS)
    few = F.broadcast if total <= 2 * PAIRS * rounds else lambda t: t
    out = []
    for r in range(rounds):
        with scratch(spark) as keep:
            some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == r)
            ids = written(told.join(some.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep"), "ids")
            texts = df.join(few(ids.select(F.col("rep").alias(key)).distinct()), key, "left_semi")
            sets = _with_sets(shingle_sets(texts, key, text, n)).withColumnRenamed(key, "rep").join(few(ids), ["rep", "c1", "c2"], "left_semi")
            sides = [sets.select(F.col("rep").alias(c), F.col("s").alias(f"s{c}")).join(few(some), c) for c in "ab"]
            both = sides[0].join(sides[1], ["a", "b"]).withColumn("i", F.size(F.array_intersect("sa", "sb")))
            alike = F.col("i") / (F.size("sa") + F.size("sb") - F.col("i")) >= threshold
            out.append(keep(both.where(alike).select("a", "b").distinct(), "alike"))
        del some, ids, texts, sets, sides, both
        tidy(spark)
    return _union(out)


def _with_sets(sets: DataFrame) -> DataFrame:
    """(key, s) to (key, c1, c2, s), told apart as _signed() does."""
    none = lambda h, n: (h, n)
    return _with_keys(sets, none).select(sets.columns[0], "c1", "c2", F.col("keys").alias("s"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _linked(pairs: DataFrame, *of) -> DataFrame:
    """(rep): the classes that a pair at the threshold holds. A class needs one such pair: one of each is checked, and then those of which a side is without."""
    pairs = written(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"), "a", "b")
    one = written(ends.groupBy("rep").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("x")).select("x.*").distinct(), "one")
    reps = lambda found: found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    linked = written(reps(_checked(one, *of)), "linked")
    both = pairs.join(linked.toDF("a").withColumn("x", F.lit(1)), "a", "left").join(linked.toDF("b").withColumn("y", F.lit(1)), "b", "left")
    left = both.where("x is null or y is null").select("a", "b").join(one, ["a", "b"], "left_anti")
    return linked.union(reps(_checked(written(left, "left"), *of))).distinct()


def _flagged(df: DataFrame, key: str, text: str, n: int, threshold: float, keys_of, more: Column | None) -> DataFrame:
    """(key, is_dup) by class: one of several copies, or one that is linked with another that shares one of the keys by ``keys_of`` (of rows' sets).

    Whole sets are neither stored nor shuffled, but for those of candidates: rows are stored with their keys, classes with the keys of one row, and keys meet in rounds.
    """
    spark = df.sparkSession
    sets = shingle_sets(df, key, text, n)
    keys = keys_of(sets)
    tidy(spark)
    rows = written(_with_keys(sets, keys).withColumnRenamed(key, "k"), "signed")
    one = F.min_by(F.struct("n", "m", "w", "keys"), "k").alias("x")
    reps = written(rows.groupBy("c1", "c2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"), one).select("c1", "c2", "rep", "copies", "x.*"), "classes")
    tidy(spark)
    known = reps.where("rep is not null")
    total = reps.agg(F.sum("copies").alias("rows"), F.sum(F.size("keys")).alias("keys")).first()
    rounds = min(max(-(-(total["keys"] or 0) // KEYS), 1), ROUNDS)
    met = []
    for r in range(rounds):
        with scratch(spark) as keep:
            met.append(keep(_nearer(_met(known, threshold, more, round_=r, rounds=rounds), known, threshold), "met"))
        tidy(spark)
    linked = _linked(_union(met).distinct(), df, key, text, threshold, n, known.select("rep", "c1", "c2"), total["rows"] or 0).withColumn("linked", F.lit(True))
    flags = reps.select("c1", "c2", "rep", "copies").join(linked, "rep", "left").where((F.col("copies") > 1) | F.col("linked")).select("c1", "c2", F.lit(True).alias("is_dup"))
    return rows.select("k", "c1", "c2").join(flags, ["c1", "c2"], "left").select(F.col("k").alias(key), F.coalesce("is_dup", F.lit(False)).alias("is_dup"))


def duplicated(df: DataFrame, key: str, text: str, threshold: float = 0.7, n: int = 5) -> DataFrame:
    """(key, is_dup) for each row: whether another text is at least so similar. Rows are flagged by their class: one of several
    copies, or one that is linked; copies make no pairs."""
    return _flagged(df, key, text, n, threshold, lambda sets: _by_prefix(sets, threshold), _room(threshold))


def _bands(bands: int, rows: int):
    rng = np.random.default_rng(20_240_604)
    xor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def f(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((len(n), bands), np.uint64)
        for k, end in enumerate(np.cumsum(n).tolist()):
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for at in range(end - int(n[k]), end, 4096):
                low = np.minimum(low, ((h[None, at : min(at + 4096, end)] ^ xor[:, None]) * mul[:, None]).min(axis=1))
            band = np.arange(bands, dtype=np.uint64)
            for part in low.reshape(bands, rows).T:
                band = _mixed(band * np.uint64(3) + part)
            out[k] = band
        return out.ravel(), np.full(len(n), bands)

    return f


def banding(threshold: float, permutations: int = 128, misses: float = 0.9999, steps: int = 200) -> tuple[int, int]:
    """(bands, rows) of at most so many permutations: the least weighted sum of the area of false candidates below the threshold and that of missed pairs from it
    on, by the midpoint rule. misses: the weight of the second; false candidates only cost work, since they are verified."""
    at = (np.arange(steps) + 0.5) / steps
    below, above = at * threshold, threshold + at * (1 - threshold)
    best = (np.inf, 1, 1)
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            false = threshold * np.mean(1 - (1 - below**rows) ** bands)
            missed = (1 - threshold) * np.mean((1 - above**rows) ** bands)
            best = min(best, ((1 - misses) * false + misses * missed, bands, rows))
    return best[1:]


def minhash_links(reps: DataFrame, threshold: float, permutations: int = 128, misses: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """(a, b, jaccard) of classes (rep, s) that share a band of MinHash values and are at the threshold by their whole sets. Signatures are made within
    the row, so only bands are shuffled."""
    signed = written(_with_keys(reps.select("rep", "s"), _bands(*banding(threshold, permutations, misses))), "signed")
    return verified(_met(signed, threshold, None, block), reps, threshold)


def minhash_duplicated(df: DataFrame, key: str, text: str, threshold: float = 0.7, n: int = 5, permutations: int = 128, misses: float = 0.9999) -> DataFrame:
    """(key, is_dup) as duplicated() gives it, but for pairs that share no band: banding() says how few."""
    return _flagged(df, key, text, n, threshold, lambda sets: _bands(*banding(threshold, permutations, misses)), None)
