"""Connected components of a link table, distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, record, written

CHUNK = 1 << 19


class Forest:
    """Union-find over a chunk of links; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, a):
        up = self.up
        top = a
        while (x := up.get(top, top)) != top:
            top = x
        while (x := up.get(a, a)) != top:
            up[a] = top
            a = x
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's links as stars: no more rows than it has nodes, with the same components."""
    forest, seen = Forest(), 0

    def stars():
        nodes = np.fromiter(forest.up, np.int64, len(forest.up))
        return record(u=nodes, v=np.fromiter((forest.root(x) for x in nodes.tolist()), np.int64, len(nodes)))

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(u, v)
        seen += b.num_rows
        if seen > CHUNK:
            yield stars()
            forest, seen = Forest(), 0
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """links: columns u and v (long). Returns (node, root) for each node other than its component's smallest,
    which is the root. Nulls and self-links are ignored; repeated and reversed links count once.

    Rounds of large-star and small-star until nothing changes; every round is a written table. Minima are
    aggregated before the shuffle, and the joins are plain equi-joins whose hot nodes Spark can split.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(links.transform(mapped, _thinned, "u long, v long").where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or (now["n"], now["x"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now["n"], now["x"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
