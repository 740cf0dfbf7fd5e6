"""URL filters: a blocked Bloom filter of listed canonical URLs lets possible hits through to an exact hash join.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or one of its subdomains and whose path starts with the rule's; of
the rules that fit, the longest (host and path together, then host) decides. A URL that no rule fits isn't listed and is allowed.

The filter holds each rule's host and each (host, path), as 64-bit hashes: a hash names a block of 256 bits and one bit in each of its eight
words. Blocks are aggregated by Spark (``bit_or`` by block), so no task sees the list. A URL's keys are made in two steps: its host and the hosts
above it, as many labels as a rule has at most; then, for hosts that pass, the starts of its path that are as long as some rule's path. What passes both
steps is joined with the rules by its text, which takes false positives out, so the filter's size changes costs and never a verdict.

The filter is sent to the workers if its blocks take FILTER_BYTES at most (they are counted first); a larger one is joined by block in a
shuffle. Rules are broadcast if they are RULE_ROWS at most, else joined by (host, path); Spark splits that join's hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, ship, written

FILTER_BYTES = 64 << 20
RULE_ROWS = 20_000
#: A rule's path may have so many characters, and its host so many labels; longer ones are an error (names on the internet have 127 labels at most).
LONGEST, LABELS = 65_536, 1_024
_KEYS_A_BLOCK = 16


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _above(name: Column, labels: Column) -> Column:
    """The last labels of a host."""
    return F.call_function("substring_index", name, F.lit("."), -labels)


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def _bits(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A hash's block and its bit in each of the block's eight words."""
    g = F.xxhash64(h, F.lit(1))
    return F.pmod(h, F.lit(blocks)), [F.shiftright(g, 5 * i).bitwiseAND(F.lit(31)) for i in range(8)]


class UrlFilter:
    """The rules, cleaned and written, their filter, and what keys URLs need.

    rules: host, path, verdict (allow or block). Hosts are lower-cased; rows with a null are left out; of equal rules block counts. Other columns
    are left alone. Without rules everything is allowed.
    """

    def __init__(self, rules: DataFrame, filter_bytes: int = FILTER_BYTES, rule_rows: int = RULE_ROWS) -> None:
        spark = rules.sparkSession
        ship(spark)
        lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        rows = rules.select(lower.alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna()
        self.rules = written(rows.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "rules")
        sizes = self.rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(_labels(F.col("rule_host"))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.length("rule_path")), F.lit(0)).alias("longest")).first()
        if sizes["longest"] > LONGEST or sizes["labels"] > LABELS:
            raise ValueError(f"a rule's path has {LONGEST} characters at most and its host {LABELS} labels")
        self.n, self.labels = sizes["n"], sizes["labels"]
        self.lengths = sorted(r[0] for r in self.rules.select(F.length("rule_path")).distinct().collect())  # LONGEST at most
        self.blocks = 2 * self.n // _KEYS_A_BLOCK + 1
        keys = self.rules.select(F.explode(F.array(F.xxhash64("rule_host"), F.xxhash64("rule_host", "rule_path"))).alias("h"))
        block, bits = _bits(F.col("h"), self.blocks)
        ors = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))).alias(f"w{i}") for i, b in enumerate(bits)]
        self.table = written(keys.withColumn("block", block).groupBy("block").agg(*ors), "filter")
        self.small = self.blocks * 32 <= filter_bytes
        self.near = self.n <= rule_rows
        self._sent = None

    def _words(self) -> np.ndarray:
        """The filter as eight words a block, bounded by filter_bytes."""
        found = self.table.toArrow()
        words = np.zeros((self.blocks, 8), np.uint32)
        for i in range(8):
            words[found["block"].to_numpy(), i] = found[f"w{i}"].to_numpy().astype(np.uint32)
        return words

    def possible(self, rows: DataFrame, keys: str, row: str = "row") -> DataFrame:
        """rows with those structs of the array ``keys`` (with a hash ``h``) that the filter lets through; others are surely not listed. ``row``:
        a column that differs in each row."""
        if self.small:
            if self._sent is None:
                self._sent = rows.sparkSession.sparkContext.broadcast(self._words())
            sent, blocks = self._sent, self.blocks
            block = F.transform(keys, lambda k: F.pmod(k["h"], F.lit(blocks)))
            bits = F.transform(keys, lambda k: F.xxhash64(k["h"], F.lit(1)))

            def through(batches):
                for b in batches:
                    lists, a, x = (b.column(b.schema.get_field_index(c)) for c in (keys, "_block", "_bits"))
                    a, x = a.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                    ok = np.ones(len(a), bool)
                    for i in range(8):
                        ok &= (sent.value[a, i] >> ((x >> np.uint64(5 * i)) & np.uint64(31)).astype(np.uint32)) & 1 == 1
                    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                    offsets = np.concatenate([[0], np.cumsum(ok)])[ends].astype(np.int32)
                    kept = pa.ListArray.from_arrays(pa.array(offsets), lists.flatten().filter(pa.array(ok)))
                    yield pa.RecordBatch.from_arrays([kept if c == keys else b.column(i) for i, c in enumerate(b.schema.names[:-2])], names=b.schema.names[:-2])

            return mapped(rows.withColumn("_block", block).withColumn("_bits", bits), through, rows.schema)
        each = rows.select(row, F.explode(keys).alias("_k"))
        block, bits = _bits(F.col("_k.h"), self.blocks)
        hit = [F.call_function("shiftright", F.col(f"w{i}"), F.col("_bits")[i].cast("int")).bitwiseAND(F.lit(1)) == 1 for i in range(8)]
        ok = each.withColumn("block", block).withColumn("_bits", F.array(*bits)).join(self.table, "block")
        for h in hit:
            ok = ok.where(h)
        found = ok.groupBy(row).agg(F.array_sort(F.collect_list("_k")).alias("_kept"))  # a row's own keys
        none = F.slice(keys, 1, 0)
        return rows.join(found, row, "left").withColumn(keys, F.coalesce("_kept", none)).drop("_kept")

    def judged(self, urls: DataFrame, key: str, url: str = "url") -> DataFrame:
        """(key, host, path, rule, verdict), a row for each row. A null URL, or one without ``://``, has an empty host and path and is allowed;
        rows that repeat a key are judged each; a null key stays null. Very long URLs cost no more than the longest rule."""
        rows = urls.select(F.col(key).alias("_key"), host(F.coalesce(url, F.lit(""))).alias("host"), path(F.coalesce(url, F.lit(""))).alias("path"))
        if not self.n:
            return rows.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = rows if self.small else written(rows, "urls")  # joined again by row
        upto = F.sequence(F.lit(1), F.least(F.lit(self.labels), _labels(F.col("host"))))
        rows = rows.withColumn("hosts", F.transform(upto, lambda k: F.struct(k.alias("labels"), F.xxhash64(_above(F.col("host"), k)).alias("h"))))
        rows = self.possible(rows, "hosts")
        starts = F.filter(F.array(*map(F.lit, self.lengths)), lambda n: n <= F.length("path"))
        of = lambda a: F.transform(starts, lambda n: F.struct(a["labels"].alias("labels"), n.alias("start"), F.xxhash64(_above(F.col("host"), a["labels"]), F.substring("path", F.lit(1), n)).alias("h")))
        rows = self.possible(rows.withColumn("keys", F.flatten(F.transform("hosts", of))).drop("hosts"), "keys")
        rows = written(rows, "possible")  # numbers of rows are settled here
        some = rows.where(F.size("keys") > 0).select("row", "_key", "host", "path", F.explode("keys").alias("k")).drop("keys")
        some = some.withColumn("rule_host", _above(F.col("host"), F.col("k.labels"))).withColumn("rule_path", F.substring("path", F.lit(1), F.col("k.start")))
        exact = some.join(F.broadcast(self.rules) if self.near else self.rules, ["rule_host", "rule_path"], "left")
        fits = F.when(F.col("verdict").isNotNull(), F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
        best = exact.groupBy("row").agg(F.any_value("_key").alias("_key"), F.any_value("host").alias("host"), F.any_value("path").alias("path"), F.max(fits).alias("b"))
        columns = [F.col("_key").alias(key), "host", "path"]
        hit = best.select(*columns, F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))
        rest = rows.where(F.size("keys") == 0).select(*columns, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
        return hit.unionByName(rest)
