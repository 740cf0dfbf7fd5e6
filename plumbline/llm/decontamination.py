"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index holds, for chosen terms, the postings (term, doc_id, pos) of all training documents. A test item is cut into
windows of ``window`` words (an item of fewer words is one window). For each window the lists of its rarest terms, by their count in
the whole training corpus, are intersected from the rarest on, each adjusted by the term's offset in the window;
only the postings of terms that are among the ``lists`` rarest of some window are stored. Places that all lists share are
then compared with the document's words, so matches are exact. ``proximity`` finds the windows' words near each other in any order.

Terms and windows of the benchmark are joined by broadcast up to BROADCAST bytes, which are counted first, and by shuffle beyond. A
window travels as a number; the items that hold it are joined to the documents with a match at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

WINDOW = 10
LISTS = 3
BROADCAST = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased (other letters stay), then the runs of ASCII letters and digits and of all other characters from U+0080 on.
    Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _APART), "")


def _small(df: DataFrame) -> DataFrame:
    """df for a broadcast if its bytes, as they are counted, allow it."""
    texts = [F.col(f.name) for f in df.schema if f.dataType.simpleString() in ("string", "array<string>")]
    chars = F.octet_length(F.concat_ws("", *texts)) if texts else F.lit(0)
    words_in = sum((F.size(f.name) for f in df.schema if f.dataType.simpleString() == "array<string>"), F.lit(0))
    size = df.agg(F.sum(chars + 24 * words_in + F.lit(32 + 24 * len(df.columns))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST else df


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items: item_id, text. The different windows: wid, ws (their words), items (sorted ids of the items with it, as strings).
    Rows without an item_id or without words have none."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where("item_id is not null and size(ws) > 0")
    rows = written(rows, "items")
    starts = F.explode_outer(F.expr(f"sequence(1, greatest(size(ws) - {window} + 1, 1))"))
    cut = rows.select("item_id", "ws", starts.alias("at")).select("item_id", F.slice("ws", F.col("at"), window).alias("ws"))
    kinds = cut.groupBy("ws").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return written(kinds.withColumn("wid", F.monotonically_increasing_id()), "windows")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (term, doc_id, pos) of the terms in all documents."""
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws")).where("doc_id is not null").select("doc_id", F.posexplode_outer("ws").alias("pos", "term"))
    return spread.join(_small(terms.select("term")), "term", "left_semi").select("term", "doc_id", "pos")


class Index:
    """The windows of a benchmark and the postings of their rarest terms in docs."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> None:
        self.docs, self.windows = docs, windows_of(items, window)
        offsets = self.windows.select("wid", F.posexplode("ws").alias("off", "term"))
        terms = written(offsets.select("term").distinct(), "terms")
        spread = docs.where("doc_id is not null").select(F.explode_outer(words(F.col("text"))).alias("term"))
        counts = spread.join(_small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
        self.counts = written(counts, "counts")
        # a window with a word that no document has can't occur
        order = Window.partitionBy("wid").orderBy("tf", "off")
        known = offsets.join(_small(self.counts), "term", "left").withColumn("r", F.row_number().over(order)).withColumn("dead", F.max(F.col("tf").isNull()).over(Window.partitionBy("wid")))
        self.lists = written(known.where(~F.col("dead") & (F.col("r") <= lists)).select("wid", "term", "off", "r"), "lists")
        self.postings = written(postings(docs, self.lists.select("term").distinct()), "postings")
        self.depth = lists

    def candidates(self) -> DataFrame:
        """(wid, doc_id, start): where the lists of a window's rarest terms meet."""
        at = self.postings.join(_small(self.lists.where("r = 1").drop("r")), "term").select("wid", "doc_id", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0").distinct()
        for r in range(2, self.depth + 1):
            nth = self.lists.where(F.col("r") == r).select("wid", "term", "off")
            want = at.join(_small(nth), "wid", "left").withColumn("pos", F.col("start") + F.col("off"))
            # a window of fewer words than lists has no more to meet
            more = want.where("term is not null").join(self.postings.withColumnRenamed("term", "_t"), (F.col("term") == F.col("_t")) & (want["doc_id"] == self.postings["doc_id"]) & (want["pos"] == self.postings["pos"]), "left_semi")
            at = more.select("wid", "doc_id", "start").union(want.where("term is null").select("wid", "doc_id", "start"))
            at = written(at, "places")
        return at

    def matches(self) -> DataFrame:
        """One row per row of docs: rid (its number), doc_id, its words counted, and the exact matches as an array of (start, n, wid): the
        place, the number of words and the window."""
        found = self.candidates().join(_small(self.windows.select("wid", "ws")), "wid").groupBy("doc_id").agg(F.collect_set(F.struct("start", "ws", "wid")).alias("places"))
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null").join(found, "doc_id", "left")
        rows = rows.select("doc_id", "places", words(F.col("text")).alias("ws"))
        true = F.filter("places", lambda p: F.slice(F.col("ws"), p["start"] + 1, F.size(p["ws"])) == p["ws"])
        hits = F.transform(true, lambda p: F.struct(p["start"].alias("start"), F.size(p["ws"]).alias("n"), p["wid"].alias("wid")))
        none = F.array().cast("array<struct<start:int,n:int,wid:bigint>>")
        rows = rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.coalesce(F.array_sort(hits), none).alias("hits"))
        return written(rows.withColumn("rid", F.monotonically_increasing_id()), "hits")

    def items_of(self, matches: DataFrame) -> DataFrame:
        """(rid, item_ids): the sorted ids, as strings, of the items whose windows a row of matches() holds; only rows with any."""
        owners = self.windows.select("wid", F.explode("items").alias("item_id"))
        held = matches.where(F.size("hits") > 0).select("rid", F.explode(F.array_distinct(F.col("hits.wid"))).alias("wid"))
        return held.join(owners, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    def proximity(self, slop: int) -> DataFrame:
        """(wid, doc_id, at): the windows all of whose words stand, in any order, within len + slop words of the rarest at ``at``,
        from lists of all the windows' terms."""
        wanted = self.windows.select("wid", F.size("ws").alias("len"), F.explode(F.array_distinct("ws")).alias("term"))
        rare = self.lists.where("r = 1").select("wid", F.col("term").alias("rarest"))
        every = written(postings(self.docs, wanted.select("term").distinct()), "postings")
        centre = every.join(_small(rare), F.col("term") == F.col("rarest")).select("wid", "doc_id", F.col("pos").alias("at")).distinct()
        need = wanted.groupBy("wid").agg(F.count(F.lit(1)).alias("need"))
        near = centre.join(_small(wanted), "wid").join(every, ["term", "doc_id"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("len") + slop)
        # spans that begin at each place: the words within reach of it
        first = near.select("wid", "doc_id", "at", "len", F.col("pos").alias("begin")).distinct()
        inside = first.join(near.select("wid", "doc_id", "at", "term", "pos"), ["wid", "doc_id", "at"]).where((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + F.col("len") + slop))
        got = inside.groupBy("wid", "doc_id", "at", "begin").agg(F.count_distinct("term").alias("have"))
        return got.join(_small(need), "wid").where("have = need").select("wid", "doc_id", "at").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside a match), n_items, item_ids (sorted strings), contaminated.

    Null and empty texts have no words. Rows that repeat a doc_id are judged each by its own text. Rows without a doc_id
    are left out; an empty benchmark matches nothing.
    """
    index = Index(docs, items, window)
    rows = index.matches()
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a["n"] + F.greatest(h["start"] + h["n"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], h["start"] + h["n"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    rows = rows.select("rid", "doc_id", "n_words", covered.alias("n_hit")).join(index.items_of(rows), "rid", "left").select("doc_id", "n_words", "n_hit", ids.alias("item_ids"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a match, all columns kept. Rows without a doc_id stay."""
    bad = written(Index(docs, items, window).matches().where(F.size("hits") > 0).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_id"], "left_anti")
