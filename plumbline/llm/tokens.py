"""Token-id output: documents to blocks of entropy-coded token ids, in ascending doc_id order, and back.

A data set is a folder with two Parquet tables that Spark's committer writes (so a lost executor leaves no torn file):
``frequencies`` (one row: bits, the frequency of each id) is shared by all blocks, and ``blocks`` (part, block, first_doc, n_docs,
start, n_tokens, payload) holds one block of whole documents a row; payload is the binary format of ``rans.Coder``.
Blocks in order of (part, block) hold the documents in ascending doc_id order.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents_of, mapped, new_path, record, slices, written
from plumbline.llm.rans import Coder, Frequencies

END_ID = 2
BLOCK_TOKENS = 1 << 18
PART_TOKENS = 1 << 23
#: Chunks of text that a worker keeps with their ids, unless another number is asked for. Fewer cost time and change no result.
_CACHED = 800_000
_JOINED = 400
#: The normaliser and the pattern of the tokenizer that cut() is made for. Files that differ encode whole texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def can_be_cut(tokenizer) -> bool:
    """Whether a text's ids are those of its chunks, by what the tokenizer's file says."""
    d = json.loads(tokenizer.to_str())
    split = ((d["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return (
        (d["normalizer"] or {}).get("normalizers") == NORMALIZER and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and d["model"].get("end_of_word_suffix") == "</w>" and not d["model"].get("dropout") and not d["truncation"] and not d["padding"]
        and all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
    )


class ChunkIds(dict):
    """The numbers of chunks of text already seen by this worker, and the ids of each.

    Looking up a new chunk gives it the next number; its ids are found before they are used. When there are more than
    ``cached`` chunks, those met since the last time stay and the others go.
    """

    def __init__(self, path: str, width: str, cached: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.width, self.cached = Tokenizer.from_file(path), width, cached or _CACHED
        self.whole = not can_be_cut(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.new: list[str] = []
        self._forget()

    def _forget(self) -> None:
        """Keeps half of the numbers at most: the chunks that were used last."""
        if len(self):
            used = np.partition(self.used[: len(self)], len(self) // 2)[len(self) // 2]
            stay = np.flatnonzero(self.used[: len(self)] > used)
            ids = self.gather(stay)
            size, names = self.size[stay], list(self)
            self.clear()
            for i, k in enumerate(stay.tolist()):
                dict.__setitem__(self, names[k], i)
        else:
            ids, size = np.zeros(0, self.width), np.zeros(0, np.int64)
        self.flat, self.end = ids, len(ids)
        self.size = np.concatenate([size, np.zeros(self.cached, np.int64)])
        self.start = np.cumsum(self.size) - self.size
        self.used, self.clock = np.zeros(len(self.size), np.int64), 0

    def __missing__(self, chunk: str) -> int:
        n = len(self)
        self[chunk] = n
        self.new.append(chunk)
        return n

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks, one after another."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self) > self.cached:
            self._forget()
        chunks = [cut(t) for t in texts]
        n = np.array([len(c) for c in chunks])
        numbers = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, n.sum())
        self._learn()
        self.clock += 1
        self.used[numbers] = self.clock
        flat = self.gather(numbers)
        ends = np.cumsum(self.size[numbers])[np.cumsum(n) - 1] * flat.itemsize
        raw = flat.tobytes()
        return [raw[x:y] for x, y in itertools.pairwise([0, *ends.tolist()])]

    def _learn(self) -> None:
        """Finds the ids of the new chunks. Words, which end in one id that ends a word, are encoded many at a time."""
        first, found = len(self) - len(self.new), [b""] * len(self.new)
        words = [i for i, c in enumerate(self.new) if c.isalpha()]
        odd = [i for i, c in enumerate(self.new) if c and not c.isalpha()]
        parts = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join([self.new[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # letters to Python but not to the tokenizer
                odd += part
                continue
            raw, at = ids.astype(self.width).tobytes(), (ends * np.dtype(self.width).itemsize).tolist()
            for i, x, y in zip(part, [0, *at[:-1]], at, strict=True):
                found[i] = raw[x:y]
        for k in range(0, len(odd), 20_000):
            part = odd[k : k + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([self.new[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, self.width).tobytes()
        more = np.frombuffer(b"".join(found), self.width)
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        if len(self) > len(self.size):
            wide = np.zeros(2 * len(self), np.int64)
            self.size, self.start, self.used = (np.concatenate([x, wide]) for x in (self.size, self.start, self.used))
        if self.end + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2 + len(more), self.width)])
        self.flat[self.end : self.end + len(more)] = more
        self.size[first : len(self)] = size
        self.start[first : len(self)] = self.end + np.cumsum(size) - size
        self.end += len(more)
        self.new = []


#: Of this Python worker, by path, width and size.
_IDS: dict[tuple[str, str, int | None], ChunkIds] = {}
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))  # not the apostrophe, which can begin a piece of letters


def cut(text: bytes) -> list[str]:
    """A text in chunks whose ids, one after another, are the text's ids.

    The tokenizer lower-cases and splits into runs of letters, digits and marks, which hold no white space. So a text can be
    cut at spaces and newlines; A-Z can be lower-cased first if no characters would then combine in another way; and it
    can be cut between an ASCII letter or digit and an ASCII mark, which makes far fewer different chunks.
    """
    if b"<|" not in text:
        low = text.lower()
        if text.isascii() or (unicodedata.is_normalized("NFC", text.decode("utf-8", "replace")) and unicodedata.is_normalized("NFC", low.decode("utf-8", "replace"))):
            x = np.frombuffer(low, np.uint8)
            if len(x) > 1:
                letter, mark = _ALNUM[x], _MARK[x]
                at = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
                low = np.insert(x, at, 32).tobytes() if len(at) else low
            text = low
    return text.decode("utf-8", "replace").replace("\n", " ").split(" ")


def encode_texts(texts: list[bytes], path: str, width: str = "<u4", cached: int | None = None) -> list[bytes]:
    """The ids of each UTF-8 text as little-endian integers."""
    if (path, width, cached) not in _IDS:
        _IDS[path, width, cached] = ChunkIds(path, width, cached)
    return _IDS[path, width, cached].encode(texts) if texts else []


def vocabulary_size(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, cached: int | None = None) -> tuple[DataFrame, str]:
    """doc_id and ids (binary), the end id last, and the width of an id: 16 bits, or 32 for a vocabulary of over 65,536."""
    width = "<u2" if vocabulary_size(path, end_id) <= 1 << 16 else "<u4"

    def f(batches):
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [x + end for x in encode_texts([x or b"" for x in b.column("text").to_pylist()], path, width, cached)]
                yield record(doc_id=b.column("doc_id"), ids=pa.array(ids, pa.binary()))

    return documents_of(docs).transform(mapped, f, "doc_id long, ids binary"), width


def _counts(width: str, vocabulary: int):
    def f(batches):
        _IDS.clear()  # the texts are encoded by now, and this worker lives on
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in slices(batch, "ids"):
                counts += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), width), minlength=vocabulary)
        used = np.nonzero(counts)[0]
        yield record(id=used.astype(np.int64), n=counts[used])

    return f


def _blocks(width: str, frequencies: Frequencies, block_tokens: int):
    def f(batches):
        coder, part, block, start = Coder(frequencies), TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def row():
            payload = coder.encode(np.concatenate(ids), np.array(docs, np.int64), np.array([len(x) for x in ids], np.int64))
            return record(part=[part], block=[block], first_doc=[docs[0]], n_docs=[len(docs)], start=[start], n_tokens=[held], payload=[payload])

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                a = np.frombuffer(x.as_buffer(), width)
                if held and held + len(a) > block_tokens:
                    yield row()
                    block, start, docs, ids, held = block + 1, start + held, [], [], 0
                docs.append(d)
                ids.append(a)
                held += len(a)
        if held:
            yield row()

    return f


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, cached: int | None = None) -> None:
    """Writes docs as a data set. Null and empty texts are the end id alone; rows that repeat a doc_id are all kept, next
    to each other; rows without a doc_id are left out; an empty table gives no blocks."""
    spark = docs.sparkSession
    ids, width = encoded(docs, path, end_id, cached)
    ids = written(ids, "ids")
    vocabulary = vocabulary_size(path, end_id)
    counts = np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").transform(mapped, _counts(width, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]  # a row per id of the vocabulary at most
    frequencies = Frequencies.of_counts(counts)
    spark.createDataFrame([(frequencies.bits, frequencies.freq.tolist())], "bits int, freq array<int>").coalesce(1).write.parquet(f"{folder}/frequencies")
    parts = max(1, -(-int(counts.sum()) // PART_TOKENS))
    dealt = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.transform(mapped, _blocks(width, frequencies, block_tokens), "part long, block long, first_doc long, n_docs long, start long, n_tokens long, payload binary").write.parquet(f"{folder}/blocks")


def load_frequencies(spark: SparkSession, folder: str) -> Frequencies:
    row = spark.read.parquet(f"{folder}/frequencies").first()
    return Frequencies(row["bits"], np.array(row["freq"], np.int64))


def _documents(frequencies: Frequencies, with_ids: bool):
    def f(batches):
        coder = Coder(frequencies)
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = coder.decode(batch.column("payload")[i].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths.astype(np.int64)
                raw = ids.astype("<u4").tobytes()
                cols = dict(part=np.full(len(ends), batch.column("part")[i].as_py(), np.int64), at=starts + batch.column("start")[i].as_py(), doc_id=doc_ids, n_tokens=ends - starts)
                each = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols["ids_crc32"] = np.array([zlib.crc32(x) for x in each], np.int64)
                if with_ids:
                    cols["ids"] = pa.array(each, pa.binary())
                yield record(**cols)

    return f


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """From a data set's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ids (binary:
    little-endian 32-bit integers) if asked for. Blocks are decoded in parallel, each by itself."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file of PART_TOKENS tokens or so
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = blocks.select("part", "start", "payload").transform(mapped, _documents(load_frequencies(spark, folder), with_ids), "part long, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, cached: int | None = None) -> DataFrame:
    """Writes docs to a new folder beside the checkpoints and returns what the files hold: nulls, empty texts, repeated rows and empty
    tables as write() says. The files go with the driver; write() keeps them where they are put."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, folder, path, end_id, cached=cached)
    return read(docs.sparkSession, folder)
