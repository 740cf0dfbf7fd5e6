"""Line dedup that can be undone: exact reference counts of lines, and sharded cuckoo filters of the frequent ones.

State (written tables):
 * postings (k1, k2, doc_id): which document holds which line key (128 bits of it), once each;
 * counts (k1, k2, n_docs, last_doc): the exact reference counts;
 * filters (shard, blob): a cuckoo filter for each shard with the keys that reach ``least_docs`` documents.
Insertions and document deletions add tables with the counts of the keys they touch, and insert into or delete from the filters of
the shards of keys that become or cease to be frequent only. Lines are dropped by probing the filters and confirming what passes by the counts.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, mix64, record, slices, written

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARD_KEYS = 1 << 17
#: Postings that one task probes, about.
PLACE = 1 << 19
_SPACE = b" \t\n\x0b\x0c\r"
_SLOTS = 4


def _turns(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal keys."""
    at = np.arange(len(sorted_keys))
    new = np.ones(len(at), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


class CuckooFilter:
    """16-bit fingerprints, buckets of four, partial-key cuckoo hashing. A key that was inserted is always found; one that
    wasn't is found about once in 8,000 times. Each insertion takes one slot, so each can be deleted again."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.slots = np.zeros((buckets, _SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, math.ceil(math.log2(max(1, keys) / _SLOTS / 0.85))))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of 64-bit keys."""
        h = mix64(keys.view(np.uint64))
        fp = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, a, self.other(a, fp)

    def other(self, bucket, fp):
        return bucket ^ (mix64(np.atleast_1d(fp).astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _placed(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots, in whole rounds. Returns the numbers of those that found none."""
        left = np.arange(len(fp))
        for bucket in (a, b, a, b):
            order = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[order]
            free = np.argsort(self.slots[at] != 0, axis=1, kind="stable")  # free slots first
            nth = _turns(at)
            fits = nth < (self.slots[at] == 0).sum(axis=1)
            self.slots[at[fits], free[fits, nth[fits]]] = fp[order[fits]]
            left = order[~fits]
        return left

    def insert(self, keys: np.ndarray) -> None:
        """All keys: whole rounds first, evictions for the few that are left. OverflowError if one finds no place."""
        fps, a, b = self.places(keys)
        rng = np.random.default_rng(len(keys))
        for i in self._placed(fps, a, b).tolist():
            fp, at = fps[i], int(a[i])
            for _ in range(500):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
                j = rng.integers(_SLOTS)
                fp, self.slots[at, j] = self.slots[at, j], fp
                at = int(self.other(at, fp)[0])
            else:
                raise OverflowError("the filter is full")

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = cls.sized(len(keys)).buckets
        while True:
            f = cls(buckets)
            try:
                f.insert(keys)
                return f
            except OverflowError:
                buckets *= 2

    def delete(self, keys: np.ndarray) -> None:
        """One fingerprint of each key, in whole rounds. Keys that were never inserted must not be given."""
        fp, a, b = self.places(keys)
        left = np.arange(len(keys))
        for bucket in (a, b):
            order = left[np.lexsort((fp[left], bucket[left]))]
            at, own = bucket[order], fp[order]
            same = self.slots[at] == own[:, None]
            hit = same & (np.cumsum(same, axis=1) == _turns(at.astype(np.int64) * 65536 + own)[:, None] + 1)
            found = hit.any(axis=1)
            self.slots[at[found], hit[found].argmax(axis=1)] = 0
            left = order[~found]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        return (self.slots[a] == fp[:, None]).any(axis=1) | (self.slots[b] == fp[:, None]).any(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", self.buckets) + self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        n = struct.unpack_from("<Q", blob)[0]
        return cls(n, np.frombuffer(blob, "<u2", n * _SLOTS, 8).reshape(n, _SLOTS).copy())


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """ASCII white space stripped at both ends, A-Z lower-cased; None if shorter than least_chars code points."""
    k = line.strip(_SPACE).lower()
    if len(k) < least_chars or (len(k) < 4 * least_chars and not k.isascii() and len(k.decode("utf-8", "replace")) < least_chars):
        return None
    return k


def _keys(least_chars: int):
    def f(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                rows: list[bytes] = []
                docs: list[int] = []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    own = {xxhash.xxh3_128_digest(k) for x in (t or b"").split(b"\n") if len(x) >= least_chars and (k := line_key(x, least_chars))}
                    rows += own
                    docs += [d] * len(own)
                k = np.frombuffer(b"".join(rows), np.int64).reshape(-1, 2)
                yield record(k1=pa.array(k[:, 0]), k2=pa.array(k[:, 1]), doc_id=pa.array(docs, pa.int64()))

    return f


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, doc_id) for each different line key of each row of docs."""
    return documents_of(docs).transform(mapped, _keys(least_chars), "k1 long, k2 long, doc_id long")


def _filters(batches):
    """Rows (shard, k1) sorted by shard to a filter for each shard."""
    shard, held = None, []
    for batch in batches:
        shards, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if shards[lo] != shard and held:
                yield record(shard=[shard], blob=[CuckooFilter.build(np.concatenate(held)).to_bytes()])
                held = []
            shard = int(shards[lo])
            held.append(keys[lo:hi])
    if held:
        yield record(shard=[shard], blob=[CuckooFilter.build(np.concatenate(held)).to_bytes()])


def _probed(batches):
    """Rows (shard, salt, blob, k1, k2, doc_id), each shard's filter before its postings, to the postings that pass."""
    shard, f = None, None
    for batch in batches:
        at = np.flatnonzero(batch.column("blob").is_valid())
        cuts = sorted({0, *at.tolist(), *(at + 1).tolist(), batch.num_rows})
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            blob = part.column("blob")[0].as_py()
            if blob is not None:
                shard, f = part.column("shard")[0].as_py(), CuckooFilter.from_bytes(blob)
                continue
            keep = np.zeros(part.num_rows, bool)
            own = part.column("shard").to_numpy() == shard
            if f is not None and own.any():
                keep[own] = f.holds(part.column("k1").to_numpy()[own])
            if keep.any():
                part = part.filter(pa.array(keep))
                yield record(k1=part.column("k1"), k2=part.column("k2"), doc_id=part.column("doc_id"))


def _rewritten(least_chars: int):
    def f(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                out, lines, dropped, digest = [], [], [], []
                for t, k1, k2 in zip(b.column("text").to_pylist(), b.column("d1").to_pylist(), b.column("d2").to_pylist(), strict=True):
                    kept = whole = (t or b"").split(b"\n")
                    if k1:
                        gone = set(np.array([k1, k2], np.int64).T.tobytes()[i : i + 16] for i in range(0, 16 * len(k1), 16))
                        kept = [x for x in whole if (k := line_key(x, least_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                    lines.append(len(whole))
                    dropped.append(len(whole) - len(kept))
                    text = b"\n".join(kept)
                    out.append(text)
                    digest.append(hashlib.sha256(text).hexdigest())
                yield record(doc_id=b.column("doc_id"), n_lines=pa.array(lines, pa.int64()), n_dropped=pa.array(dropped, pa.int64()), kept_sha256=pa.array(digest, pa.string()), kept=pa.array(out, pa.binary()))

    return f


BROADCAST = 32 << 20


def _few(df: DataFrame) -> DataFrame:
    """Rows of a few numbers for a broadcast if as many as there are allow it; they are counted first."""
    return F.broadcast(df) if df.count() * 16 * (len(df.columns) + 2) <= BROADCAST else df


@dataclass(frozen=True)
class LineIndex:
    """The state over the documents seen so far: tables that are only added to, the newest last.

    postings: tables (k1, k2, doc_id). gone: (doc_id, upto): documents deleted from the first ``upto`` tables of postings. counts: tables (k1, k2, n_docs, last_doc) of
    keys in two documents or more when a table of counts was written, a later row in place of earlier ones (n_docs may have fallen to 1 or 0 there). filters: tables (shard, blob), a later row in place of earlier ones.
    An update writes the postings, counts and filters that it changes, and shuffles no more than the rows of the keys it touches: older tables are read where they lie,
    against a broadcast of those keys or documents. compact() makes one table of each again.
    """

    postings: tuple[DataFrame, ...]
    counts: tuple[DataFrame, ...]
    filters: tuple[DataFrame, ...]
    shards: int
    least_chars: int = LEAST_CHARS
    least_docs: int = LEAST_DOCS
    gone: DataFrame | None = None
    n_frequent: int = 0

    @classmethod
    def build(cls, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> LineIndex:
        return cls._of(written(line_keys(docs, least_chars), "lines"), cls._repeats(docs), least_chars, least_docs)

    @classmethod
    def _of(cls, keys: DataFrame, repeats: bool, least_chars: int, least_docs: int) -> LineIndex:
        n = F.count_distinct("doc_id") if repeats else F.count(F.lit(1))
        counts = written(keys.groupBy("k1", "k2").agg(n.alias("n_docs"), F.max("doc_id").alias("last_doc")).where("n_docs > 1"), "counts")
        frequent = counts.where(F.col("n_docs") >= least_docs)
        n_frequent = frequent.count()
        shards = max(1, -(-n_frequent // SHARD_KEYS))
        return cls((keys,), (counts,), (cls._built(frequent, shards),), shards, least_chars, least_docs, None, n_frequent)

    @staticmethod
    def _repeats(docs: DataFrame) -> bool:
        """Whether a doc_id repeats, so that its lines must be counted once."""
        n = docs.agg(F.count("doc_id").alias("n")).first()["n"]
        return docs.select("doc_id").where("doc_id is not null").distinct().count() < n

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.col("k2"), F.lit(shards)).cast("long")

    @classmethod
    def _built(cls, frequent: DataFrame, shards: int) -> DataFrame:
        dealt = frequent.select(cls._shard(shards).alias("shard"), "k1").repartition("shard").sortWithinPartitions("shard")
        return written(dealt.transform(mapped, _filters, "shard long, blob binary"), "filters")

    @staticmethod
    def _numbered(tables: tuple[DataFrame, ...]) -> DataFrame:
        out = tables[0].withColumn("gen", F.lit(0))
        for i, t in enumerate(tables[1:], 1):
            out = out.unionByName(t.withColumn("gen", F.lit(i)))
        return out

    def _alive(self) -> DataFrame:
        """All postings that hold: those of no deleted document, unless it was inserted again."""
        rows = self._numbered(self.postings)
        if self.gone is not None:
            rows = rows.join(_few(self.gone), "doc_id", "left").where("upto is null or gen >= upto").drop("upto")
        return rows.drop("gen")

    @staticmethod
    def _newest(tables: tuple[DataFrame, ...], keys: list[str], only: DataFrame | None = None) -> DataFrame:
        """The last row of each key, of those in ``only``."""
        if len(tables) == 1:
            return tables[0] if only is None else tables[0].join(only, keys, "left_semi")
        rows = LineIndex._numbered(tables)
        rows = rows if only is None else rows.join(only, keys, "left_semi")
        values = [c for c in tables[0].columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "gen").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])

    def passing(self, postings: DataFrame) -> DataFrame:
        """The postings that the filters of their shards hold. A shard's postings are dealt to as many places as their number asks for (PLACE
        each), each with a copy of the filter (a few hundred KB), so a line of a third of all rows doesn't meet in one task."""
        salts = max(1, -(-postings.count() // (PLACE * self.shards)))
        probes = postings.select(self._shard(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("blob"), "k1", "k2", "doc_id")
        none = F.lit(None).cast("long")
        filters = self._newest(self.filters, ["shard"]).select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "blob", none.alias("k1"), none.alias("k2"), none.alias("doc_id"))
        dealt = filters.union(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").asc_nulls_last())
        return dealt.transform(mapped, _probed, "k1 long, k2 long, doc_id long")

    def drops(self, postings: DataFrame | None = None) -> DataFrame:
        """(doc_id, d1, d2): the keys that each document loses, confirmed by the exact counts."""
        frequent = self._newest(self.counts, ["k1", "k2"]).where(F.col("n_docs") >= self.least_docs)
        hits = self.passing(self._alive() if postings is None else postings).join(frequent, ["k1", "k2"]).where("doc_id <> last_doc")
        pairs = hits.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("d"))
        return pairs.select("doc_id", F.col("d.k1").alias("d1"), F.col("d.k2").alias("d2"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept (the text that stays, UTF-8).

        A null or empty text is one empty line. A key's copies stay in the largest doc_id that holds it, all of them. Rows
        that repeat a doc_id are one document when counting. Rows without a doc_id are left out.
        """
        rows = documents_of(docs).join(self.drops(), "doc_id", "left")
        return rows.transform(mapped, _rewritten(self.least_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary")

    def _of_documents(self, ids: DataFrame) -> DataFrame:
        """The postings that hold of some documents; older tables are read, not shuffled."""
        near = _few(ids)
        return LineIndex(tuple(t.join(near, "doc_id", "left_semi") for t in self.postings), self.counts, self.filters, self.shards, gone=self.gone)._alive().distinct()

    def _before(self, keys: DataFrame) -> DataFrame:
        """(k1, k2, n_docs, last_doc) of the keys as they are: from the counts, and for keys that those don't have from the one posting there may be."""
        near = _few(keys)
        known = written(self._newest(self.counts, ["k1", "k2"], near), "known")
        rest = _few(keys.join(known, ["k1", "k2"], "left_anti"))
        alone = self._alive().join(rest, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return known.unionByName(alone)

    def _moved(self, before: DataFrame, after: DataFrame) -> tuple[tuple[DataFrame, ...], int]:
        """The filters with one table more, of the shards in which a key becomes or ceases to be frequent."""
        old, new = (x.where(F.col("n_docs") >= self.least_docs).select("k1", "k2") for x in (before, after))
        moves = new.join(old, ["k1", "k2"], "left_anti").withColumn("by", F.lit(1)).union(old.join(new, ["k1", "k2"], "left_anti").withColumn("by", F.lit(-1)))
        moves = written(moves.select(self._shard(self.shards).alias("shard"), F.lit(None).cast("binary").alias("blob"), "k1", "by"), "moves")
        if moves.isEmpty():
            return self.filters, 0
        held = self._newest(self.filters, ["shard"], _few(moves.select("shard").distinct())).select("shard", "blob", F.lit(None).cast("long").alias("k1"), F.lit(-2).alias("by"))
        dealt = held.union(moves).repartition("shard").sortWithinPartitions("shard", "by")
        return (*self.filters, written(dealt.transform(mapped, _moved, "shard long, blob binary"), "filters")), moves.agg(F.sum("by")).first()[0]

    def _updated(self, postings: tuple[DataFrame, ...], gone: DataFrame | None, before: DataFrame, after: DataFrame) -> LineIndex:
        after = written(after, "counts")
        filters, more = self._moved(before, after)
        out = LineIndex(postings, (*self.counts, after), filters, self.shards, self.least_chars, self.least_docs, gone, self.n_frequent + more)
        full = len(filters) > len(self.filters) and not filters[-1].where("blob is null").isEmpty()
        return out.compact() if full or -(-out.n_frequent // SHARD_KEYS) > self.shards else out  # more keys than the shards are made for

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents. A document that is there already gets the lines that it hasn't; rows without a doc_id are left out."""
        more = written(line_keys(docs, self.least_chars).distinct(), "lines")
        added = written(more.join(self._of_documents(more.select("doc_id").distinct()), ["k1", "k2", "doc_id"], "left_anti"), "lines")
        grown = added.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("d"))
        before = written(self._before(added.select("k1", "k2").distinct()), "before")
        both = grown.join(before, ["k1", "k2"], "left")
        after = both.select("k1", "k2", (F.coalesce("n_docs", F.lit(0)) + F.col("n")).alias("n_docs"), F.greatest("last_doc", "d").alias("last_doc")).where("n_docs > 1")
        return self._updated((*self.postings, added), self.gone, before, after)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: the documents (column doc_id) to forget. Where a key's last document goes, the last one left is found among its postings."""
        ids = written(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
        lost = written(self._of_documents(ids), "lost")
        mark = ids.withColumn("upto", F.lit(len(self.postings)))
        gone = written(mark if self.gone is None else self.gone.join(ids, "doc_id", "left_anti").unionByName(mark), "gone")
        left = LineIndex(self.postings, self.counts, self.filters, self.shards, gone=gone)
        before = written(self._before(lost.select("k1", "k2").distinct()), "before")
        fewer = before.join(lost.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), ["k1", "k2"]).withColumn("n_docs", F.col("n_docs") - F.col("n")).drop("n")
        bare = fewer.join(_few(ids.withColumnRenamed("doc_id", "last_doc")), "last_doc", "left_semi").select("k1", "k2")
        last = left._alive().join(_few(bare), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("d"))
        after = fewer.join(last, ["k1", "k2"], "left").select("k1", "k2", "n_docs", F.coalesce("d", "last_doc").alias("last_doc"))
        return self._updated(self.postings, gone, before, after)

    def compact(self) -> LineIndex:
        """The same state in one table of each kind, without what was deleted, and with filters for as many keys as there are."""
        keys = written(self._alive().distinct(), "lines")
        return self._of(keys, False, self.least_chars, self.least_docs)


def _moved(batches):
    """Rows (shard, blob, k1, by) sorted by shard: its filter, then the keys that go, then those that come. A batch of keys is held at a time."""
    shard, f, full = None, None, False

    def done():
        return record(shard=[shard], blob=pa.array([None if full else f.to_bytes()], pa.binary()))

    for batch in batches:
        shards, by = batch.column("shard").to_numpy(), batch.column("by").to_numpy()
        cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (by[1:] != by[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if shards[lo] != shard:
                if f is not None:
                    yield done()
                shard, full, f = int(shards[lo]), False, None
            part = batch.slice(lo, hi - lo)
            if by[lo] == -2:
                f = CuckooFilter.from_bytes(part.column("blob")[0].as_py())
                continue
            f = CuckooFilter.sized(SHARD_KEYS) if f is None else f
            keys = part.column("k1").to_numpy(zero_copy_only=False).astype(np.int64)
            if by[lo] < 0:
                f.delete(keys)
            elif not full:
                try:
                    f.insert(keys)
                except OverflowError:  # built anew from the counts
                    full = True
    if f is not None:
        yield done()


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """LineIndex.apply() of docs to themselves: nulls, empty texts, repeated rows and rows without a doc_id as there; an empty table gives an
    empty result."""
    return LineIndex.build(docs, least_chars, least_docs).apply(docs)
