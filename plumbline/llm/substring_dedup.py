"""Exact substring dedup by prefix-free parsing.

A rolling hash of TRIGGER bytes marks triggers, which cut each document into phrases, at the same places wherever the same bytes
stand. A string of ``length`` bytes is a suffix of a phrase (of up to REACH bytes) followed by the parse from the next trigger
on. So two strings are equal if their phrase suffixes are, and their parse suffixes to the depth that is left; and the
corpus order of strings is the order of (phrase suffix, parse suffix). No suffix of the corpus is ever a row:

1. Each trigger that can begin a parse suffix sends two fingerprints: of the ``length - REACH`` bytes from it on (its group), and of its
   whole context, the phrase before it and the bytes after it. Triggers of equal context are settled: all strings that begin
   in their phrases repeat. In highly repetitive text these are nearly all. A trigger alone in its group repeats nothing.
2. In a group with different contexts, one trigger of each context is compared: the group's dictionary suffix array (phrases
   sorted backwards, with common lengths) and parse suffix array (parse suffixes sorted, with common lengths) give for each
   split of the string a class on either side, and strings are equal if both classes are.

Fingerprints travel packed, a row for each run of documents and shard, and a fingerprint that repeats within a run goes once; so
one passage in a third of all documents is no large group. A group may still hold a third of all triggers with as many contexts (a
common line in different company). So where a run has more than a few contexts of one group, it deals them by context, and sends the group's
shard a mark only; a shard gets ENTRIES entries of a group, or 4 a run if that is more. In marked groups and those of more than HOT
contexts strings are compared in place of contexts, each a row that is counted before and after a shuffle. Both ways give the same result.

Strings without a trigger in their first REACH bytes are fingerprinted whole, each by itself. Long texts are parsed in pieces that overlap,
so memory is a few times the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, mix64, record, slices, tidy, written

LENGTH = 200
REACH = 128
TRIGGER = 8
EVERY = 24
SHARD_BYTES = 16 << 20
RUN_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
PIECE = 1 << 20
COMPARED = 20_000
#: Contexts of a group that are compared in one task; a group with more is hot. Entries of a group in its shard.
HOT, ENTRIES = 20_000, 1 << 20
_rng = np.random.default_rng(20_240_603)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEY = np.dtype([("g", "<u8"), ("a", "<u8")])
#: What a trigger is: nothing, settled, settled and to be compared, to be compared; by strings if of a hot group.
SETTLED, SAMPLE, OPEN, BY_STRINGS = 1, 2, 3, 4
_WAY = np.uint8(3)


class Parse:
    """The triggers of a run of texts: for each its document, place, and the least and most bytes that a string can begin before
    it. A string without a trigger near is its own trigger (``alone``)."""

    def __init__(self, texts: list[bytes], length: int = LENGTH) -> None:
        reach = min(REACH, length - TRIGGER)
        self.length, self.depth = length, length - reach
        self.x = x = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        n = len(x)
        h = _BYTE[x]
        k = 1
        while k < TRIGGER:
            h = h[: len(h) - k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:] if len(h) > k else h[:0]
            k *= 2
        at = np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) < np.uint64((1 << 32) // EVERY))
        doc = np.searchsorted(self.end, at, "right")
        inside = at + TRIGGER <= self.end[doc]
        at, doc = at[inside], doc[inside]
        before = np.full(len(at), -1, np.int64)
        before[1:] = at[:-1]
        before = np.maximum(before, self.begin[doc] - 1)
        most = np.minimum(at - before - 1, reach)
        least = np.maximum(at - (self.end[doc] - length), 0)
        use = least <= most
        at, doc, most, least = at[use], doc[use], most[use], least[use]
        # strings that no trigger covers
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, at - most, 1)
        np.add.at(mark, at - least + 1, -1)
        ok = np.cumsum(mark[:n]) == 0
        for b, e in zip(self.begin[size > 0], self.end[size > 0], strict=True):
            ok[max(b, e - length + 1) : e] = False
        lone = np.flatnonzero(ok)
        order = np.argsort(np.concatenate([at, lone]), kind="stable")
        self.at = np.concatenate([at, lone])[order]
        self.doc = np.concatenate([doc, np.searchsorted(self.end, lone, "right")])[order]
        self.most = np.concatenate([most, np.zeros(len(lone), np.int64)])[order]
        self.least = np.concatenate([least, np.zeros(len(lone), np.int64)])[order]
        self.alone = np.concatenate([np.zeros(len(at), bool), np.ones(len(lone), bool)])[order]

    def keys(self) -> np.ndarray:
        """The two fingerprints of each trigger."""
        n = len(self.x)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.x] * power[:n], out=total[1:])
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (total[b] - total[a]) * back[a]

        out = np.zeros(len(self.at), _KEY)
        g = mix64(of(self.at, self.at + self.depth) + self.alone.astype(np.uint64))
        left, right = of(self.at - self.most, self.at), of(self.at, self.at + self.length - self.least)
        shape = (self.least * 1024 + self.most).astype(np.uint64)
        out["g"] = g
        out["a"] = mix64(mix64(left + shape) * np.uint64(3) + mix64(right) + self.alone.astype(np.uint64))
        return out


@dataclass
class Triggers:
    """The triggers of some texts in order: text, place in it, most and least bytes that a string can begin before it, whether it is a
    string of its own, and the two fingerprints."""

    doc: np.ndarray
    at: np.ndarray
    most: np.ndarray
    least: np.ndarray
    alone: np.ndarray
    keys: np.ndarray


def triggers(texts: list[bytes], length: int, piece: int = PIECE) -> Triggers:
    """Of whole texts; those of over ``piece`` bytes are parsed piece by piece, with as much on either side as decides on a trigger."""
    reach = min(REACH, length - TRIGGER)
    parts: list[tuple[int, int, int, int, int]] = []  # text, bytes to parse, and bytes whose triggers count
    out: list[tuple[np.ndarray, ...]] = []

    def parse() -> None:
        p = Parse([texts[d][lo:hi] for d, lo, hi, _, _ in parts], length)
        d, lo, s, e = (np.array([x[k] for x in parts], np.int64) for k in (0, 1, 3, 4))
        at = p.at - p.begin[p.doc] + lo[p.doc]
        use = (s[p.doc] <= at) & (at < e[p.doc])
        out.append((d[p.doc][use], at[use], p.most[use], p.least[use], p.alone[use], p.keys()[use]))
        parts.clear()

    held = 0
    for d, t in enumerate(texts):
        for s in range(0, max(1, len(t)), piece):
            e = min(len(t), s + piece)
            parts.append((d, max(0, s - reach - 1), min(len(t), e + reach + length + TRIGGER), s, e))
            held += e - s
            if held >= piece:
                parse()
                held = 0
    if parts or not out:
        parse()
    return Triggers(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _sent(shards: int, length: int, many: int):
    """Documents to packed fingerprints by shard, and for each run the documents in it."""

    def f(batches):
        part, run = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        hashes: list[int] = []
        sizes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0

        def rows():
            name = (part << 32) | run
            k = np.concatenate(keys)
            n = np.concatenate(sizes)
            first, inverse, count = _distinct(k)
            turn = np.argsort(first)  # contexts are numbered as they come, which packs well
            place = np.empty_like(turn)
            place[turn] = np.arange(len(turn))
            first, inverse, count = first[turn], place[inverse], count[turn]
            group = k["g"][first]
            marked, of, contexts = np.unique(group, return_inverse=True, return_counts=True)
            apart = (contexts > many)[of]
            marked = marked[contexts > many]
            shard = (np.where(apart, mix64(group ^ k["a"][first]), group) % np.uint64(shards)).astype(np.int64)
            home = int(mix64(np.array([name], np.uint64))[0] % np.uint64(shards))
            held_docs = np.array([len(docs)], "<i8").tobytes() + np.array(docs, "<i8").tobytes() + np.array(hashes, "<i8").tobytes() + n.astype("<i4").tobytes()
            ids, blobs = [home], [b"D" + zlib.compress(held_docs + np.array([len(first)], "<i8").tobytes() + first.astype("<i4").tobytes() + inverse.astype("<i4").tobytes(), 1)]
            for kind, some in ((b"K", np.flatnonzero(~apart)), (b"C", np.flatnonzero(apart))):
                for s, j in _by(shard[some], some):
                    ids.append(s)
                    blobs.append(kind + _packed(k[first[j]], j, count[j] > 1))
            for s, j in _by((marked % np.uint64(shards)).astype(np.int64), np.arange(len(marked))):
                ids.append(s)
                blobs.append(b"M" + np.ascontiguousarray(marked[j]).view("u1").reshape(-1, 8)[:, 2:].tobytes())
            return record(shard=np.array(ids, np.int64), run=np.full(len(ids), name, np.int64), blob=pa.array(blobs, pa.binary()))

        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                texts = [t or b"" for t in b.column("text").to_pylist()]
                t = triggers(texts, length)
                docs += b.column("doc_id").to_pylist()
                hashes += [_text_hash(x) for x in texts]
                sizes.append(np.bincount(t.doc, minlength=len(texts)))
                keys.append(t.keys)
                held += sum(map(len, texts))
                if held >= RUN_BYTES:
                    yield rows()
                    run, docs, hashes, sizes, keys, held = run + 1, [], [], [], [], 0
        if docs:
            yield rows()

    return f


def _by(shard: np.ndarray, values: np.ndarray):
    """The values of each shard that is there."""
    order = np.argsort(shard, kind="stable")
    names, begin = np.unique(shard[order], return_index=True)
    return zip(names.tolist(), np.split(values[order], begin[1:]), strict=True) if len(names) else ()


def _packed(keys: np.ndarray, places: np.ndarray, many: np.ndarray) -> bytes:
    """Keys with 48 bits of either fingerprint (the shard tells some more), their ascending places as steps, and a bit each."""
    step = np.diff(places, prepend=0)
    width = "<u2" if step.max() < 1 << 16 else "<u4"
    bits = [np.ascontiguousarray(keys[c]).view("u1").reshape(-1, 8)[:, 2:].tobytes() for c in ("g", "a")]
    return width[-1:].encode() + len(keys).to_bytes(4, "little") + b"".join(bits) + step.astype(width).tobytes() + np.packbits(many).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width, n, at = "<u" + chr(blob[1]), int.from_bytes(blob[2:6], "little"), 6
    keys = np.zeros(n, _KEY)
    for c in ("g", "a"):
        raw = np.zeros((n, 8), np.uint8)
        raw[:, 2:] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
        keys[c] = raw.view("<u8").reshape(n)
        at += 6 * n
    step = np.frombuffer(blob, width, n, at)
    many = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + step.nbytes), count=n)
    return keys, np.cumsum(step, dtype=np.int64), many


def _text_hash(text: bytes) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index, class and count of equal pairs."""
    order = np.lexsort((k["a"], k["g"]))
    s = k[order]
    new = np.ones(len(k), bool)
    new[1:] = (s["g"][1:] != s["g"][:-1]) | (s["a"][1:] != s["a"][:-1])
    cls = np.cumsum(new) - 1
    inverse = np.empty(len(k), np.int64)
    inverse[order] = cls
    return order[new], inverse, np.bincount(cls, minlength=0)


def _judged(most: int):
    """All runs' fingerprints of a shard to what each is. Documents of runs pass through."""

    def f(batches):
        shard, runs, keys, places, many, apart, marks = None, [], [], [], [], [], []

        def rows():
            size = [len(x) for x in keys]
            k, at, twice, of = np.concatenate(keys), np.concatenate(places), np.concatenate(many), np.repeat(runs, size)
            first, inverse, count = _distinct(k)
            repeated = (count > 1) | (np.bincount(inverse, twice) > 0)
            group = k["g"][first]  # sorted
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            contexts = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            # the other contexts of these groups are in other shards
            wide = (np.bincount(inverse, np.repeat(apart, size)) > 0) | np.isin(group, np.concatenate([np.zeros(0, np.uint64), *marks]))
            flag = np.where(repeated, SETTLED, 0)[inverse]
            one = np.zeros(len(k), bool)
            one[first] = True  # any of the context's triggers stands for it
            compare = ((contexts > 1) | wide)[inverse] & one
            flag = np.where(compare, np.where(flag == SETTLED, SAMPLE, OPEN) + BY_STRINGS * (wide | (contexts > most))[inverse], flag)
            got = np.flatnonzero(flag)
            for name, j in _by(of[got], got):
                yield record(run=[name], blob=pa.array([b"F" + at[j].astype("<i4").tobytes() + flag[j].astype("u1").tobytes()], pa.binary()))

        for b in batches:
            for s, name, blob in zip(b.column("shard").to_pylist(), b.column("run").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if blob[:1] == b"D":
                    yield record(run=[name], blob=pa.array([blob], pa.binary()))
                    continue
                if s != shard and (keys or marks):
                    if keys:
                        yield from rows()
                    runs, keys, places, many, apart, marks = [], [], [], [], [], []
                shard = s
                if blob[:1] == b"M":
                    g = np.zeros((len(blob) // 6, 8), np.uint8)
                    g[:, 2:] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, 6)
                    marks.append(g.view("<u8").ravel())
                    continue
                k, at, twice = _unpacked(blob)
                runs.append(name)
                keys.append(k)
                places.append(at)
                many.append(twice)
                apart.append(blob[:1] == b"C")
        if keys:
            yield from rows()

    return f


def _flagged(batches):
    """Rows (run, blob) sorted by run to what the triggers of each document are, for documents that have any."""
    name, blobs = None, []

    def rows():
        raw = next((zlib.decompress(x[1:]) for x in blobs if x[:1] == b"D"))
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        docs, hashes, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), np.frombuffer(raw, "<i4", n, 8 + 16 * n)
        m = int(np.frombuffer(raw, "<i8", 1, 8 + 20 * n)[0])
        first, inverse = np.frombuffer(raw, "<i4", m, 16 + 20 * n), np.frombuffer(raw, "<i4", -1, 16 + 20 * n + 4 * m)
        by = np.zeros(m, np.uint8)
        for x in blobs:
            if x[:1] == b"F":
                k = (len(x) - 1) // 5
                by[np.frombuffer(x, "<i4", k, 1)] = np.frombuffer(x, "u1", k, 1 + 4 * k)
        flags = by[inverse]
        one = np.zeros(len(inverse), bool)
        one[first] = True
        flags[~one & (flags & _WAY == SAMPLE)] = SETTLED
        ends = np.cumsum(sizes)
        out = [(int(d), int(h), flags[e - s : e]) for d, h, s, e in zip(docs, hashes, sizes, ends, strict=True)]
        out = [(d, h, zlib.compress(f.tobytes(), 1)) for d, h, f in out if f.any()]
        return record(d=pa.array([x[0] for x in out], pa.int64()), h=pa.array([x[1] for x in out], pa.int64()), flags=pa.array([x[2] for x in out], pa.binary()))

    for b in batches:
        for r, blob in zip(b.column("run").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if r != name and blobs:
                yield rows()
                blobs = []
            name = r
            blobs.append(blob)
    if blobs:
        yield rows()


def _strongest(batches):
    """Flags sorted by (d, h): of rows that repeat both, each trigger's strongest flag, since only one of them carries SAMPLE."""
    now, held = None, None
    for b in batches:
        out = []
        for d, h, blob in zip(*(b.column(c).to_pylist() for c in ("d", "h", "flags")), strict=True):
            flags = np.frombuffer(zlib.decompress(blob), np.uint8)
            if (d, h) == now:
                held = np.maximum(held, flags)
                continue
            if now is not None:
                out.append((*now, zlib.compress(held.tobytes(), 1)))
            now, held = (d, h), flags
        if out:
            yield record(d=pa.array([x[0] for x in out], pa.int64()), h=pa.array([x[1] for x in out], pa.int64()), flags=pa.array([x[2] for x in out], pa.binary()))
    if now is not None:
        yield record(d=pa.array([now[0]], pa.int64()), h=pa.array([now[1]], pa.int64()), flags=pa.array([zlib.compress(held.tobytes(), 1)], pa.binary()))


def _split(batches):
    """Documents with flags keep their text; of the others only the result stays."""
    for batch in batches:
        for b in slices(batch, "text"):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            flags = b.column("flags").to_pylist()
            yield record(
                doc_id=b.column("doc_id"), h=b.column("h"), n_bytes=np.array([len(t) for t in texts], np.int64), flags=b.column("flags"),
                sha=pa.array([None if f else hashlib.sha256(t).hexdigest() for t, f in zip(texts, flags, strict=True)], pa.string()),
                text=pa.array([t if f else None for t, f in zip(texts, flags, strict=True)], pa.binary()),
            )


def _flags(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in b.column("flags").to_pylist()])


def _windows(length: int):
    """Documents with flags to the strings that begin before their triggers of hot groups."""

    def f(batches):
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                flags = _flags(b)
                if not (flags & BY_STRINGS).any():
                    continue
                texts = b.column("text").to_pylist()
                t = triggers(texts, length)
                use = np.flatnonzero((flags & BY_STRINGS > 0) & ~t.alone)
                many = t.most[use] - t.least[use] + 1
                i = np.repeat(use, many)
                start = np.repeat(t.at[use] - t.most[use] - np.cumsum(many) + many, many) + np.arange(many.sum())
                for k in range(0, len(i), 50_000):
                    j, q = i[k : k + 50_000], start[k : k + 50_000]
                    doc = t.doc[j]
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[d][a : a + length]) for d, a in zip(doc.tolist(), q.tolist(), strict=True)), np.int64).reshape(-1, 2)
                    yield record(w1=w[:, 0].copy(), w2=w[:, 1].copy(), d=b.column("doc_id").take(pa.array(doc)), dh=b.column("h").take(pa.array(doc)), start=q, open=pa.array(flags[j] & _WAY == OPEN))

    return f


def _contexts(length: int):
    """Documents with flags to the contexts of their triggers that are to be compared, but for hot groups."""

    def f(batches):
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                flags = _flags(b)
                if not ((flags == SAMPLE) | (flags == OPEN)).any():
                    continue
                texts = b.column("text").to_pylist()
                t = triggers(texts, length)
                use = np.flatnonzero(((flags == SAMPLE) | (flags == OPEN)) & ~t.alone)
                for k in range(0, len(use), 20_000):
                    u = use[k : k + 20_000]
                    at, most, least, doc = t.at[u], t.most[u], t.least[u], t.doc[u]
                    yield record(
                        g=t.keys["g"][u].view(np.int64), doc_id=b.column("doc_id").take(pa.array(doc)), h=b.column("h").take(pa.array(doc)), at=at, most=most, least=least, open=pa.array(flags[u] == OPEN),
                        left=pa.array([texts[d][a - m : a] for d, a, m in zip(doc.tolist(), at.tolist(), most.tolist(), strict=True)], pa.binary()),
                        right=pa.array([texts[d][a : a + length - m] for d, a, m in zip(doc.tolist(), at.tolist(), least.tolist(), strict=True)], pa.binary()),
                    )

    return f


def _order(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A suffix array of byte strings of up to width bytes: their order, what each has in common with the one before, their lengths."""
    words = -(-width // 8)
    m = np.zeros((len(rows), 8 * words), np.uint8)
    size = np.array([len(r) for r in rows], np.int64)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    m[np.arange(8 * words)[None, :] < size[:, None]] = flat
    cols = m.view(">u8").reshape(len(rows), words)
    order = np.lexsort([size, *(cols[:, c] for c in range(words - 1, -1, -1))])
    s = m[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    return order, np.concatenate([[0], common]), size


def equal_splits(g: np.ndarray, left: list[bytes], right: list[bytes], most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each trigger and each number of bytes before it, whether the string that begins there is also another one's."""
    reach = int(most.max()) if len(most) else 0
    dictionary, left_common, _ = _order([x[::-1] for x in left], max(1, reach))
    parse, right_common, _ = _order(right, length)
    _, group = np.unique(g, return_inverse=True)
    out = np.zeros((len(g), reach + 1), bool)
    a, b = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    for k in range(reach + 1):
        has = np.flatnonzero((least <= k) & (k <= most))
        if len(has) < 2:
            continue
        a[dictionary] = np.cumsum(left_common < k)  # classes of the last k bytes before
        b[parse] = np.cumsum(right_common < length - k)  # and of the bytes from the trigger on
        key = np.stack([group[has], a[has], b[has]])
        order = np.lexsort(key)
        s = key[:, order]
        same = (s[:, 1:] == s[:, :-1]).all(axis=0)
        twice = np.zeros(len(has), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[has[order], k] = twice
    return out


def _compared(length: int):
    def f(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def rows():
            t = pa.Table.from_batches(held)
            most, least, is_open = t.column("most").to_numpy(), t.column("least").to_numpy(), t.column("open").to_numpy()
            found = equal_splits(t.column("g").to_numpy(), t.column("left").to_pylist(), t.column("right").to_pylist(), most, least, length)
            i, k = np.nonzero(found & is_open[:, None])
            return record(d=t.column("doc_id").to_numpy()[i], dh=t.column("h").to_numpy()[i], start=t.column("at").to_numpy()[i] - k)

        for b in batches:  # sorted by g; whole groups only
            g = b.column("g").to_numpy()
            cut = 0
            if n >= COMPARED:
                last = held[-1].column("g")[-1].as_py()
                new = np.flatnonzero(g != last)
                cut = int(new[0]) if len(new) else len(g)
                held.append(b.slice(0, cut))
                if len(new):
                    yield rows()
                    held, n = [], 0
            if cut < b.num_rows:
                held.append(b.slice(cut))
                n += b.num_rows - cut
        if n:
            yield rows()

    return f


def _cut(length: int):
    def f(batches):
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                texts = b.column("text").to_pylist()
                t, flags = triggers(texts, length), _flags(b)
                ends = np.cumsum([len(x) for x in texts])
                begins = np.concatenate([[0], ends[:-1]])
                mark = np.zeros(int(ends[-1]) + length + 1, np.int32)
                done = (flags & _WAY == SETTLED) | (flags & _WAY == SAMPLE)
                place = t.at[done] + begins[t.doc[done]]
                np.add.at(mark, place - t.most[done], 1)
                np.add.at(mark, place - t.least[done] + length, -1)
                for d, starts in enumerate(b.column("starts").to_pylist()):
                    if starts:
                        q = np.unique(starts) + begins[d]
                        np.add.at(mark, q, 1)
                        np.add.at(mark, q + length, -1)
                gone = np.cumsum(mark[: ends[-1]], out=mark[: ends[-1]]) > 0
                removed, spans, digest, kept = [], [], [], []
                for t, lo, hi in zip(texts, begins.tolist(), ends.tolist(), strict=True):
                    w = gone[lo:hi]
                    removed.append(int(w.sum()))
                    spans.append(int(w[:1].sum() + (w[1:] & ~w[:-1]).sum()))
                    rest = np.frombuffer(t, np.uint8)[~w].tobytes()
                    kept.append(rest)
                    digest.append(hashlib.sha256(rest).hexdigest())
                yield record(doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(digest, pa.string()), kept=pa.array(kept, pa.binary()))

    return f


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, null where
    nothing goes).

    Removes each byte that lies in a string of ``length`` bytes (64 at least) which also begins elsewhere in the input, in the same
    text or another; texts are UTF-8 bytes, null is empty, and strings don't cross texts. Rows that repeat a doc_id are
    separate texts. Rows without a doc_id are left out; an empty table gives an empty result.
    """
    if length < 64:
        raise ValueError("strings of at least 64 bytes")
    spark = docs.sparkSession
    base = documents_of(docs)
    total = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    many = max(4, ENTRIES // (1 + total // RUN_BYTES))
    sent = base.transform(mapped, _sent(shards, length, many), "shard long, run long, blob binary").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    judged = sent.transform(mapped, _judged(HOT), "run long, blob binary").repartition("run").sortWithinPartitions("run")
    flagged = judged.transform(mapped, _flagged, "d long, h long, flags binary").repartition("d", "h").sortWithinPartitions("d", "h")
    flags = written(flagged.transform(mapped, _strongest, "d long, h long, flags binary"), "flags")
    tidy(spark)
    own = base.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(b""))))
    joined = own.join(flags.withColumnRenamed("h", "fh"), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("fh")), "left").select("doc_id", "h", "text", "flags")
    split = written(joined.transform(mapped, _split, "doc_id long, h long, n_bytes long, flags binary, sha string, text binary"), "parsed")
    tidy(spark)
    some = split.where("flags is not null")
    once = some.select("doc_id", "h", "text", "flags")
    if once.count() != flags.count():  # rows that repeat both id and text
        once = once.dropDuplicates(["doc_id", "h"])
    contexts = once.transform(mapped, _contexts(length), "g long, doc_id long, h long, at long, most long, least long, open boolean, left binary, right binary")
    starts = contexts.repartition("g").sortWithinPartitions("g").transform(mapped, _compared(length), "d long, dh long, start long")
    strings = once.transform(mapped, _windows(length), "w1 long, w2 long, d long, dh long, start long, open boolean")
    twice = strings.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    starts = starts.union(strings.where("open").join(twice, ["w1", "w2"], "left_semi").select("d", "dh", "start"))
    starts = written(starts.groupBy("d", "dh").agg(F.collect_list("start").alias("starts")), "starts")
    tidy(spark)
    both = some.join(starts, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("dh")), "left").select("doc_id", "n_bytes", "text", "flags", "starts")
    changed = both.transform(mapped, _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    same = split.where("flags is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = changed.unionByName(same)
    return out if with_text else out.drop("kept")
