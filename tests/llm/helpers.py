"""Small tables with all that can be odd, and plain versions of the operators."""

import hashlib
import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeimnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 70)
    line = "This is a line that many documents hold, as they do."
    out = [
        (1, None, "en", "b", 0), (2, "", "en", "b", 0), (3, "   \n\t ", None, None, 5), (4, base, "en", "a", 9), (5, base, "en", "a", 9),
        (6, base + " and a word more", "en", "a", 9), (7, prose(3, 60) + " " + passage + " " + prose(4, 40), "de", "a", 9), (8, prose(5, 80) + " " + passage, "de", "c", 9),
        (9, f"{line}\n{prose(6, 8)}", "fr", "c", 9), (10, f"{line}\n{line.upper()}\n", "fr", "c", 9), (11, f"  {line}\t\nÉté où ça", "fr", None, 9),
        (12, "ab " * 400, "en", "a", 9), (13, "x", "en", "a", 9), (14, "é" * 300 + base.upper(), "es", "a", 9), (15, prose(7, 3000), "es", "a", 9),
        (16, "aaaaaaaa" * 100, "es", "c", 9), (17, "ab " * 300, None, "c", 9), (18, "<|endoftext|> it's, they'll! 3.5% $$$ «ok»", "en", "a", 9),
    ]
    return out


def table(spark, data=None, extra: bool = False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if extra:  # names that the operators use inside
        for c in ("h", "g", "n", "s", "run", "shard", "size", "flags", "k1", "rank", "leaf", "term", "pos", "ws", "score", "held_out", "_id"):
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


class Union(dict):
    def root(self, a):
        while self.get(a, a) != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        if a != b:
            self[b] = a
