"""Phrase collocations, counted by generalised suffix automata of shards.

Texts become shards of up to SHARD words a language: a dictionary with counts and the words' codes. Words counted at least ``least`` times over all shards get
dense numbers; every other word ends a run, since no phrase that holds it can be frequent. Each shard's suffix automaton, for substrings of up to ``depth`` words,
is built from its end positions sorted by the words before them, last word first: a state is a run of positions that share so many words (its endpos
set), its count is the run's length, and its suffix link is the run around it that shares fewer. A state's strings all have its count, so they are read off
as (words, count), and the counts of all shards are added.

Two rounds: pairs first, then, with a blocked bit table of the frequent pairs, phrases of three words or more all of whose pairs pass the table. The table takes FILTER bytes at
most; pairs that pass it by chance cost rows, not results, since every phrase is judged by its full count.

Over all shards, the suffix link of a phrase is the phrase without its first word, and it is extended at the right by those that it begins. A phrase
is subsumed if one of these longer phrases has ``percent`` % of its count or more (counts fall with length, so the next longer ones suffice).
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import delete, mapped, mix64, ship, tidy, written
from plumbline.llm.naming import dense

SHARD = 1 << 19
#: Totals of so many languages are broadcast, those of more are joined.
_LANGS = 10_000
FILTER = 32 << 20
KNOWN = 32 << 20
#: A to Z to a to z, the ends of pieces to new lines, tabs to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


class _Open(dict):
    """A shard that is being filled: words to numbers from 1 on, codes with 0 between pieces. A code below 0 is a word before a cut piece,
    already counted."""

    def __init__(self) -> None:
        self.codes = array("i")
        self.words = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n

    def add(self, piece: list[bytes], before: list[bytes]) -> None:
        if before:
            self.codes.extend([-self[w] for w in before])
        self.codes.extend(map(self.__getitem__, piece))
        self.codes.append(0)
        self.words += len(piece)


def _packed(codes: np.ndarray) -> bytes:
    return len(codes).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(codes, np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * 4, codec="zstd", asbytes=True), np.int32)


def _shards(docs: DataFrame, depth: int, shard: int) -> DataFrame:
    """(shard, lang, words, counts, codes). A task has two shards' words open at most, of all its languages together."""

    def f(batches):
        held: dict[str, _Open] = {}
        task, seq = TaskContext.get().partitionId(), 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal seq
            x = held.pop(lang)
            codes = np.frombuffer(x.codes, np.int32)
            seq += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([task << 32 | seq], pa.int64()), "lang": pa.array([lang]), "words": pa.array([list(x)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                "counts": pa.array([np.bincount(codes[codes > 0], minlength=len(x) + 1)[1:]], pa.list_(pa.int64())), "codes": pa.array([_packed(codes)], pa.binary()),
            })

        def full():
            """Closes languages that fill a shard, and the largest ones while all together fill two."""
            size = {lang: x.words for lang, x in held.items()}
            for lang in sorted(size, key=size.get, reverse=True):
                if size[lang] < shard and sum(x.words for x in held.values()) < 2 * shard:
                    break
                yield closed(lang)

        since = 0
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for line in text.as_py().translate(_TABLE).split(b"\n"):
                    piece = line.split()
                    for at in range(0, len(piece), shard):
                        if lang not in held:
                            held[lang] = _Open()
                        held[lang].add(piece[at : at + shard], piece[max(0, at - depth + 1) : at])
                        since += min(shard, len(piece) - at)
                        if since > shard // 8:
                            yield from full()
                            since = 0
        for lang in list(held):
            yield closed(lang)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return written(mapped(rows, f, "shard long, lang string, words array<string>, counts array<long>, codes binary"), "shards")


class Automaton:
    """The generalised suffix automaton of a shard for substrings of up to ``depth`` words, but for its transitions.

    context: a row for each end position, its words backwards (0: none). States are numbered by the depth of their shortest string and then in order; ``count`` is the size of the
    endpos set, strings of ``shortest`` to ``longest`` words end there, ``link`` is the state of the next shorter suffix (-1: the empty string), ``at`` one of the
    end positions, as a row of ``context``.
    """

    def __init__(self, context: np.ndarray) -> None:
        n, depth = context.shape
        packed = [context[:, k].astype(np.int64) << 32 | (context[:, k + 1] if k + 1 < depth else 0) for k in range(0, depth, 2)]
        self.context = context = context[np.lexsort(packed[::-1])]
        del packed
        new = np.zeros(n, bool)
        new[:1] = True
        state, size = np.full(n, -1, np.int32), np.full(n, -1, np.int32)  # of each position's string of one word less
        count, shortest, link, at = [], [], [], []
        longest = np.zeros(0, np.int64)
        for k in range(depth):
            new[1:] |= context[1:, k] != context[:-1, k]
            starts = np.flatnonzero(new)
            now = np.diff(np.append(starts, n))
            some = context[starts, k] > 0  # else the context is shorter
            starts, now = starts[some], now[some]
            if not len(starts):
                break
            same = now == size[starts]  # the shorter string ends at the same positions: one state
            longest[state[starts[same]]] = k + 1
            fresh = starts[~same]
            ids = np.where(same, state[starts], len(longest) + np.cumsum(~same) - 1)
            count.append(now[~same])
            link.append(state[fresh])
            at.append(fresh)
            shortest.append(np.full(len(fresh), k + 1))
            longest = np.append(longest, shortest[-1])
            where = np.repeat(starts - np.cumsum(now) + now, now) + np.arange(int(now.sum()))
            state, size = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
            state[where], size[where] = np.repeat(ids, now), np.repeat(now, now)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.count, self.shortest, self.link, self.at, self.longest = cat(count), cat(shortest), cat(link), cat(at), longest

    def strings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The different substrings of a length, words in reading order, and their counts."""
        s = np.flatnonzero((self.shortest <= length) & (length <= self.longest))
        return self.context[self.at[s], :length][:, ::-1], self.count[s]


def _contexts(codes: np.ndarray, depth: int, passes=None) -> np.ndarray:
    """The words that end at each position, backwards; a context begins at a mark, and after a pair that can't be frequent."""
    word = np.abs(codes).astype(np.int64)
    pair = np.zeros(len(word) + 1, bool)  # of a word and the one before it
    pair[1 : len(word)] = (word[:-1] > 0) & (word[1:] > 0)
    if passes is not None:
        at = np.flatnonzero(pair)
        pair[at] = passes(word[at - 1], word[at])
    out = np.zeros((len(word), depth), np.int32)
    out[:, 0] = word
    alive = np.flatnonzero(codes > 0)
    for k in range(1, depth):
        alive = alive[(alive >= k) & pair[alive - k + 1]]
        out[alive, k] = word[alive - k]
    return out[codes > 0]


def _spread(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(a << 32 | b) & np.uint64(bits - 1)).astype(np.int64)


def _table(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of pairs (column ids): at least 8 bits a pair up to FILTER bytes. Tasks make its 64-bit words, Spark joins them."""
    n, bits = pairs.count(), 64
    while bits < min(8 * n, FILTER * 8):
        bits *= 2

    def f(batches):
        for b in batches:
            ids = b.column(0).flatten().to_numpy().astype(np.int64)
            h = _spread(ids[::2], ids[1::2], bits)
            yield pa.RecordBatch.from_pydict({"i": h >> 6, "w": (np.uint64(1) << (h & 63).astype(np.uint64)).view(np.int64)})

    words = mapped(pairs.select("ids"), f, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w"))
    out = np.zeros(bits // 64, np.int64)
    for part in _streamed(words):
        out[part["i"].to_numpy()] = part["w"].to_numpy()
    return out.view(np.uint64), bits


def _streamed(rows: DataFrame):
    """rows as Arrow batches, a task's at a time: the driver's JVM never holds more of them, where toArrow() holds all."""

    def f(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32)
    for row in written(mapped(rows.repartition(parts), f, "blob binary"), "streamed").toLocalIterator():
        yield from pa.ipc.open_stream(row["blob"])


def phrases(docs: DataFrame, least: int = 100, percent: int = 100, depth: int = 5, shard: int = SHARD, broadcast_bytes: int = KNOWN) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase of 2 to ``depth`` words that occurs ``least`` times or more in its language and isn't subsumed.

    A null text is empty and a null lang ``und``; a doc_id isn't needed, so repeated rows count each, and other columns are left alone. A text is cut into pieces in
    memory; a piece of over ``shard`` words is cut further, each part with the words before it. Scores are of the lowest cut, the first of equal ones,
    in 38-digit decimals.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = _shards(docs, depth, shard)
    counted = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    counted = written(counted, "words")
    tidy(spark)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    known = dense(counted.where(F.col("f") >= least).select("lang", "word", "f"), "id").withColumn("id", (F.col("id") + 1).cast("int"))
    coded = _coded(shards, known, broadcast_bytes)
    delete(shards)
    tidy(spark)
    pairs = _frequent(coded, 2, 2, least)
    tidy(spark)
    found = pairs
    if depth > 2:
        table, bits = _table(pairs)
        sent = spark.sparkContext.broadcast(table)  # FILTER bytes at most

        def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = _spread(a, b, bits)
            return sent.value[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1) == 1

        found = pairs.unionByName(_frequent(coded, 3, depth, least, passes))
        sent.destroy()
    delete(coded)
    tidy(spark)
    return _scored(found, known, totals, percent)


def _coded(shards: DataFrame, known: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Each shard's codes as the numbers of its words, 0 for words that aren't known. The known words are sent to the workers if they take broadcast_bytes at most (they are
    counted first); more are joined with the shards' dictionaries."""
    spark = shards.sparkSession

    def numbered(codes: bytes, ids: np.ndarray) -> bytes:
        """ids: by code; the first is of marks."""
        c = _unpacked(codes)
        c = np.sign(c) * ids[np.abs(c)]
        return _packed(c[(c != 0) | np.append(True, c[:-1] != 0)] if len(c) else c)  # one mark between runs

    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    if size["bytes"] + 16 * size["n"] <= broadcast_bytes:
        parts: dict[str, list[pa.RecordBatch]] = {}
        for part in _streamed(known.select("lang", "word", "id")):
            for lang in pc.unique(part["lang"]).to_pylist():
                parts.setdefault(lang, []).append(part.filter(pc.equal(part["lang"], lang)).select(["word", "id"]))
        sent = spark.sparkContext.broadcast({lang: pa.Table.from_batches(parts.pop(lang)).combine_chunks() for lang in list(parts)})

        def found(batches):
            for b in batches:
                for lang, words, codes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    ids = np.zeros(len(words) + 1, np.int32)
                    if lang in sent.value:
                        at = pc.index_in(words.values, sent.value[lang]["word"]).to_numpy(zero_copy_only=False)
                        ok = ~np.isnan(at.astype(float))
                        ids[1:][ok] = sent.value[lang]["id"].to_numpy()[at[ok].astype(int)]
                    yield pa.RecordBatch.from_pydict({"codes": pa.array([numbered(codes.as_py(), ids)], pa.binary())})

        out = written(mapped(shards.select("lang", "words", "codes"), found, "codes binary"), "codes")
        sent.destroy()
        return out
    each = shards.select("shard", "lang", F.posexplode("words").alias("pos", "word"))
    maps = each.join(_shuffled(known.select("lang", "word", "id")), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("pos", "id")).alias("map"))  # a shard's words at most

    def joined(batches):
        for b in batches:
            for size, codes, pairs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids = np.zeros(size.as_py() + 1, np.int32)
                if pairs.is_valid:
                    ids[pairs.values.field(0).to_numpy() + 1] = pairs.values.field(1).to_numpy()
                yield pa.RecordBatch.from_pydict({"codes": pa.array([numbered(codes.as_py(), ids)], pa.binary())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = shards.select("shard", F.size("words").alias("size"), "codes").repartition(n, "shard").join(_shuffled(maps), "shard", "left").drop("shard")
    return written(mapped(both, joined, "codes binary"), "codes")


def _frequent(coded: DataFrame, shortest: int, longest: int, least: int, passes=None) -> DataFrame:
    """(ids, f) of the phrases of these lengths that occur so often, from each shard's automaton."""
    keys = [f"k{i}" for i in range((longest + 1) // 2)]

    def f(batches):
        for b in batches:
            for codes in b.column(0):
                context = _contexts(_unpacked(codes.as_py()), longest, passes)
                automaton = Automaton(context[context[:, shortest - 1] > 0])
                for k in range(shortest, longest + 1):
                    words, n = automaton.strings(k)
                    for lo in range(0, len(n), 1 << 18):
                        w = np.zeros((min(1 << 18, len(n) - lo), 2 * len(keys)), np.int64)
                        w[:, :k] = words[lo : lo + len(w)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(w[:, i] << 32 | w[:, i + 1]) for i in range(0, w.shape[1], 2)), pa.array(n[lo : lo + len(w)])], names=[*keys, "f"])

    rows = mapped(coded, f, ", ".join(f"{k} long" for k in keys) + ", f long").groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    halves = [x.cast("int") for k in keys for x in (F.shiftright(k, 32), F.col(k).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return written(rows.select(F.array_remove(F.array(*halves), 0).alias("ids"), "f"), "phrases")


def _shuffled(side: DataFrame) -> DataFrame:
    """For joins with a table of phrases or words: these grow with the input, and Parquet packs them so well that Spark would send ten times the size it expects
    through the driver."""
    return side.hint("merge")


def _scored(found: DataFrame, known: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """Phrases with their lowest cut and text, without subsumed ones."""
    size = F.size("ids")
    longer = found.where(size > 2)
    links = longer.select(F.slice("ids", F.lit(2), size).alias("ids"), "f").unionByName(longer.select(F.slice("ids", F.lit(1), size - 1).alias("ids"), "f"))
    kept = found.join(_shuffled(links.groupBy("ids").agg(F.max("f").alias("g"))), "ids", "left").where(F.col("g").isNull() | (100 * F.col("g") < percent * F.col("f")))
    kept = written(kept.select("ids", F.col("f").alias("a")), "kept")
    parts = found.unionByName(known.select(F.array("id").alias("ids"), "f"))
    cut = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(_shuffled(parts.select(F.col("ids").alias(side), F.col("f").alias(name))), side).drop(side)
    words = kept.select("ids", F.posexplode("ids").alias("pos", "id")).join(_shuffled(known.select("id", "lang", "word")), "id")
    words = words.groupBy("ids").agg(F.any_value("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    words = words.select("ids", "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    few = totals.count() <= _LANGS
    words = words.join(F.broadcast(totals) if few else totals, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else F.lit(c).cast("decimal(38,0)")
    score = F.call_function("div", big(1000) * big("a") * big("n"), big("l") * big("r"))
    cut = cut.join(_shuffled(words.select("ids", "n")), "ids").withColumn("score", score)
    best = cut.groupBy("ids").agg(F.any_value("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.join(_shuffled(words), "ids").select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def top(found: DataFrame, most: int = 2000, parts: int = 64) -> DataFrame:
    """Each language's first phrases by score, then count, then text, with their rank: first of each of some parts of a language, then of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
