"""A trie of conversation prefixes, by prefix-doubling naming.

Each different turn (role, text) gets a dense number, then each different pair of neighbouring turns, of neighbouring pairs, and so on: after
log2(longest) join rounds every aligned block of 2^j turns has a name of its own length. A prefix of d turns is d's binary decomposition into such blocks,
the largest first, so its name is a list of at most log2(longest) + 1 numbers: from the longest blocks down, each prefix of q blocks is the
prefix of 2q half blocks, and with the next half block that of 2q + 1. Prefixes of equal length and name are one node. Every round's keys are
(conversation, block), a row each, so neither a long conversation nor a common one meets in one task; the joins on names have hot keys
on one side only, which Spark splits.

Sums over subtrees double too: after round j a node holds the sum of its descendants within 2^j levels, added to the ancestor 2^j levels up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, ship, written
from plumbline.llm.naming import dense, named

_TEXT = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, bytes): a conversation's turns in order (null first; then by role and the text's md5), numbered from 0, the name of (role, text)
    and the text's UTF-8 bytes. Null roles and texts are empty; rows without a conv_id are left out; rows that repeat a turn count each.

    Rows are numbered within ranges of (conv_id, turn), and only the last conversation of a range goes on in the next, so a conversation of any
    length is spread. Rows of one conversation and turn meet in one task."""
    ship(conversations.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    names = dense(rows.groupBy("role", "text").agg(F.md5("text").alias("tie"), F.octet_length("text").cast("long").alias("bytes")))
    rows = rows.join(names, ["role", "text"]).drop("text")
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), "role", "tie"]
    part = written(rows.repartitionByRange(blocks, "conv_id", F.col("turn").asc_nulls_first()).withColumn("_p", F.spark_partition_id()), "turns")
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy("_p", "conv_id").orderBy(*order)))
    size = part.groupBy("conv_id", "_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each conversation of each range
    before = size.select("conv_id", "_p", (F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_p")) - F.col("_n")).alias("_b")).where("_b > 0")
    part = part.join(before, ["conv_id", "_p"], "left")
    return written(part.select("conv_id", (F.coalesce("_b", F.lit(0)) + F.col("_r") - 1).alias("pos"), "name", "bytes"), "places")


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c with the first h turns of conversation c - c % group (all if it has fewer, none if it is absent) before its
    own turns after its first h; h is the CRC32 of c in decimal modulo ``most``. No more than ``most`` turns are copied for each conversation."""
    rows = turns(conversations)
    ids = written(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "ids")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    goal = ids.select(F.col("conv_id").alias("_to"), (F.col("conv_id") - F.col("conv_id") % group).alias("conv_id"), h.alias("_h"))
    first = written(rows.where(F.col("pos") < most).join(goal, "conv_id").where("pos < _h").select(F.col("_to").alias("conv_id"), "pos", "name", "bytes"), "copied")
    n = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_m"))
    own = rows.withColumn("_h", h).where("pos >= _h").join(n, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.coalesce("_m", F.lit(0))).alias("pos"), "name", "bytes")
    return written(first.unionByName(own), "rebuilt"), ids


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """(conv_id, k, name) for each level j: block k holds turns k * 2^j up to (k + 1) * 2^j."""
    longest = rows.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0] + 1
    out = [rows.select("conv_id", F.col("pos").alias("k"), "name")]
    while (1 << len(out)) <= longest:
        half = [F.max(F.when(F.col("k") % 2 == i, F.col("name"))).alias(c) for i, c in enumerate("ab")]
        pairs = out[-1].groupBy("conv_id", F.floor(F.col("k") / 2).alias("k")).agg(*half).where("a is not null and b is not null")
        out.append(written(named(pairs, ["a", "b"]), "blocks"))
    return out


def prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, key) for each prefix of each conversation, the empty one included; two prefixes are equal if depth and key are."""
    out = ids.select("conv_id", F.lit(0).cast("long").alias("q"), F.array().cast("array<long>").alias("key"))
    for level in reversed(_blocks(rows)):
        twice = out.select("conv_id", (F.col("q") * 2).alias("q"), "key")
        longer = level.where("k % 2 = 0").select("conv_id", F.col("k").alias("q"), "name").join(twice, ["conv_id", "q"])
        out = twice.unionByName(longer.select("conv_id", F.col("q") + 1, F.array_append("key", F.col("name")).alias("key")).toDF("conv_id", "q", "key"))
        out = written(out, "prefixes")
    return out.withColumnRenamed("q", "depth")


def _lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of the ascending ids, joined by commas. Ids become pieces of text within ranges of (node, conv_id); a
    node's pieces then pass through one hash in order, a piece at a time, since SHA-256 can't be merged."""
    blocks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        at, first, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for node, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (node != at or size > _TEXT):
                    out.append((at, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    at, first = node, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=["node", "first", "part"])
        if held:
            yield pa.RecordBatch.from_pydict({"node": [at], "first": [first], "part": [",".join(held)]})

    def hashed(batches):
        at, sha = None, None
        for b in batches:
            out = []
            for node, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        out.append((at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_pydict({"node": [at], "ends_sha256": [sha.hexdigest()]})

    cut = ends.select("node", "conv_id").repartitionByRange(blocks, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    text = mapped(cut, pieces, "node long, first long, part string")
    return mapped(text.repartition(blocks, "node").sortWithinPartitions("node", "first"), hashed, "node long, ends_sha256 string")


def _summed(tree: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """(node, values...): each value over a node's subtree. tree: node, up (null at the root) and the values."""
    now = tree.select("node", "up", *values)
    for j in range(max(deepest, 1).bit_length()):
        if j:  # from here up leads 2^j levels on
            above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"))
            now = now.join(above, "up", "left").select("node", F.col("_up").alias("up"), *values)
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        now = written(now.join(below, "node", "left").select("node", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "sums")
    return now.drop("up")


def nodes(made: tuple[DataFrame, DataFrame]) -> DataFrame:
    """made: turns and ids. A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Without conversations there is no node; one without turns is a member of the root alone."""
    rows, ids = made
    paths = prefixes(rows, ids)
    kinds = dense(paths.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "node")
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("_key"))
    last = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes")
    above = kinds.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("_key"), F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    kinds = kinds.join(up, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left").join(above, ["depth", "_key"], "left").drop("_key")
    tree = written(kinds.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).drop("bytes"), "nodes")
    children = tree.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = written(tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    deepest = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    leaf: Column = (F.col("n_children") == 0).cast("long")
    sums = _summed(tree.withColumn("n_leaves", leaf), deepest, ["n_leaves", "saved_tokens"])
    whole = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"))
    whole = ids.join(whole, "conv_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    ends = whole.join(paths, ["conv_id", "depth"]).join(tree.select("depth", "key", "node"), ["depth", "key"])
    out = tree.drop("saved_tokens").join(sums, "node").join(_lists(ends), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
