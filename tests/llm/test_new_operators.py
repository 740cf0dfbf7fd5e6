"""Phrase collocations, the conversation trie and URL filters against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocations, conversation_trie, url_filter
from plumbline.llm.naming import dense, named
from tests.llm.helpers import empty, table


def test_dense_names(spark):
    got = named(spark.createDataFrame([(i % 7, "x", i) for i in range(50)], "a int, b string, c int").repartition(5), ["a", "b"]).collect()
    assert {r["name"] for r in got} == set(range(7)) and len({(r["name"], r["c"] % 7) for r in got}) == 7
    assert dense(spark.range(0)).count() == 0


# collocations


def counted(docs):
    """Phrases of up to five words and their counts, and words, by language."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def collocations_by_hand(docs, least, most=2000, percent=100):
    f, n = counted(docs)
    out = []
    for lang, count in f.items():
        good = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], c)
        found = []
        for p, a in good.items():
            if 100 * inside.get(p, 0) >= percent * a:
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def chatter(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "to", "Be", "é", "𝄞x", "\u00a0y", "\x00"] + [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", ",", ".", "\t", "\n", "!?"]) for _ in range(rng.randint(0, 60)))
        out.append((i, text + " New York city hall is old." * rng.randint(0, 2), rng.choice(["en", "en", "fr", None]), "s", 1))
    return out


@pytest.mark.parametrize(("shard", "percent", "sent"), [(1 << 20, 100, 0), (37, 100, 1 << 20), (37, 60, 0)])
def test_collocations(spark, shard, percent, sent):
    data = chatter(1, 120) + [(500, None, "en", "s", 1), (501, "", None, "s", 1), (502, "one word " * 90, "de", "s", 1), (502, "one word " * 90, "de", "s", 1), (None, "a b", "en", "s", 1)]
    got = collocations.top(collocations.phrases(table(spark, data, extra=True), least=5, percent=percent, shard=shard, broadcast_bytes=sent), 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations_by_hand([(d[1], d[2]) for d in data], 5, 40, percent)


def test_collocations_of_pieces_longer_than_a_shard(spark):
    data = [(1, "a b c d e f g " * 40 + "x", "en", "s", 1), (2, "a b c " * 30, "en", "s", 1)]
    for shard in (7, 11, 64):
        got = collocations.top(collocations.phrases(table(spark, data), least=10, shard=shard)).collect()
        assert sorted(map(tuple, got)) == collocations_by_hand([(d[1], d[2]) for d in data], 10)


def test_collocations_of_odd_tables(spark):
    assert collocations.top(collocations.phrases(empty(spark))).count() == 0
    assert collocations.top(collocations.phrases(table(spark))).where("lang = 'none'").count() == 0
    got = collocations.phrases(table(spark), least=3, depth=2).collect()
    assert {r["phrase"] for r in got} >= {"ab ab"} and all(len(r["phrase"].split(" ")) == 2 for r in got)


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000_000
    found = spark.createDataFrame([([1, 2], big)], "ids array<int>, f long")
    known = spark.createDataFrame([(1, "en", "a", big + 7), (2, "en", "b", big)], "id int, lang string, word string, f long")
    totals = spark.createDataFrame([("en", 9 * big + 11)], "lang string, n long")
    got = collocations._scored(found, known, totals, 100).first()
    assert got["score"] == 1000 * big * (9 * big + 11) // ((big + 7) * big)


def test_phrases_do_not_pass_the_driver_whole(spark):
    """Tables that grow with the input are joined by shuffle, however small Spark thinks them; what workers are sent reaches the driver a task at a time."""
    found = spark.createDataFrame([([1, 2], 200), ([2, 1], 150), ([1, 2, 1], 120)], "ids array<int>, f long")
    known = spark.createDataFrame([(1, "en", "a", 900), (2, "en", "b", 800)], "id int, lang string, word string, f long")
    got = collocations._scored(found, known, spark.createDataFrame([("en", 5000)], "lang string, n long"), 100)
    assert sorted(r["phrase"] for r in got.collect()) == ["a b", "a b a", "b a"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("strategy=merge"), plan.count("strategy=broadcast"), plan.count("Join ")) == (6, 2, 8)  # that with the totals is in the plan twice
    parts = list(collocations._streamed(spark.range(5000)))
    assert len(parts) >= 30 and sorted(x for p in parts for x in p["id"].to_pylist()) == list(range(5000))


def test_automaton_is_one():
    """States are the classes of equal end positions; a suffix link leads to the longest suffix of another class."""
    rng = np.random.default_rng(3)
    codes = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 30)), 0) for _ in range(20)]).astype(np.int32)
    ends = defaultdict(set)
    for i, c in enumerate(codes.tolist()):
        for k in range(1, 6):
            piece = tuple(codes[max(0, i - k + 1) : i + 1].tolist())
            if len(piece) == k and 0 not in piece:
                ends[piece].add(i)
    a = collocations.Automaton(collocations._contexts(codes, 5))
    state = {}
    for s in range(len(a.count)):
        whole = tuple(a.context[a.at[s], : a.longest[s]][::-1].tolist())
        for k in range(a.shortest[s], a.longest[s] + 1):
            state[whole[-k:]] = s
            assert len(ends[whole[-k:]]) == a.count[s]
    assert set(state) == set(ends)
    for p, s in state.items():
        for k in range(1, len(p)):
            assert (state[p[-k:]] == s) == (ends[p[-k:]] == ends[p])
        if len(p) == a.shortest[s]:
            assert a.link[s] == (state[p[1:]] if len(p) > 1 else -1)
    for k in range(1, 6):
        words, n = a.strings(k)
        assert {tuple(w): c for w, c in zip(words.tolist(), n.tolist(), strict=True)} == {p: len(e) for p, e in ends.items() if len(p) == k}


# conversations


def trie_by_hand(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = int(c - np.fmod(c, 5))
        built[c] = own.get(donor, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def talk(seed, n, longest=9):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        opening = rng.randint(0, 3)
        for turn in range(rng.randint(1, longest)):
            out.append((c, turn, ("user", "assistant")[turn % 2], f"é{opening} {turn}" if rng.random() < 0.8 else f"other {rng.randint(0, 3)}"))
    return out


def tried(spark, data, parts=3):
    df = spark.createDataFrame(data, TURNS).repartition(parts)
    for c in ("pos", "name", "key", "node", "depth", "bytes", "h"):
        df = df.withColumn(c, F.lit("x"))
    got = conversation_trie.nodes(conversation_trie.rebuilt(df))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_conversation_trie(spark):
    data = talk(5, 40) + [(50, None, None, None), (50, None, "a", None), (50, 3, None, "z"), (-3, 1, "user", "é0 0"), (-5, 0, "user", "é0 0"), (None, 1, "user", "lost"), (51, 0, "user", ""), (51, 0, "user", ""), (7, 0, "user", "é0 0")]
    data += [(10**15 + k, t, "user", f"é0 {t}") for k in range(6) for t in range(3)]
    assert tried(spark, data) == trie_by_hand(data)


def test_conversation_trie_of_one_long_conversation_and_many_copies(spark):
    data = [(3, t, "user", f"t{t % 5}") for t in range(300)] + [(5 * c, t, "user", f"t{t}") for c in range(2, 200) for t in range(3)] + [(8, 0, "user", "x" * 2_000_000)]
    assert tried(spark, data) == trie_by_hand(data)


def test_conversation_trie_of_odd_tables(spark):
    assert tried(spark, []) == []
    assert tried(spark, [(None, 0, "user", "x")]) == []
    one = tried(spark, [(4, 0, "user", "x")])  # its only turn is replaced by those of an absent conversation
    assert one == trie_by_hand([(4, 0, "user", "x")])


def test_pieces_of_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_TEXT", 64)
    ends = spark.range(5000).select((F.col("id") % 3).alias("node"), F.col("id").alias("conv_id")).repartition(7)
    want = {k: hashlib.sha256(",".join(str(i) for i in range(5000) if i % 3 == k).encode()).hexdigest() for k in range(3)}
    assert {r["node"]: r["ends_sha256"] for r in conversation_trie._lists(ends).collect()} == want


# URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("EXAMPLE.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.com", "", "block"), ("a.example.com", "", "allow"), (None, "/", "block"), ("x.de", None, "block"), ("example.com", "/de/", "block")]


def judged_by_hand(url, rules=tuple(RULES)):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if h is not None and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h.lower() + p, v))
    return host, path, best and best[2], best[3] if best else "allow"


def urls(seed, n):
    rng = random.Random(seed)
    hosts = ["net", "example.net", "b.Example.NET", "example.com", "a.example.com", "c.a.example.com", "xexample.com", "org", "fr.org", "net.", ".net", "", "é.net", "a..net", "net:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/ü?q=/fr/", "/fr/#x", "?/en/", "#", "/a://b", "\n/en/", "/EN/"]
    return [(i, rng.choice(["http://", "HTTPS://", "://", "", "x:/"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"filter_bytes": 0}, {"filter_bytes": 0, "rule_rows": 0}, {"rule_rows": 0}])
def test_url_filter(spark, how):
    data = urls(2, 300) + [(1, None), (1, "http://net/"), (1, "http://net/"), (None, "http://net/"), (9, "http://" + "a." * 5000 + "net/" + "y" * 200_000)]
    df = spark.createDataFrame(data, "page_id long, url string").repartition(3)
    for c in ("host", "path", "keys", "row", "verdict", "rule", "h", "block"):
        df = df.withColumn(c, F.lit(1))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string").withColumn("block", F.lit(0))
    got = url_filter.UrlFilter(rules, **how).judged(df, "page_id")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(tuple(r) for r in got.collect()) == Counter((k, *judged_by_hand(u)) for k, u in data)


def test_url_filter_of_odd_tables(spark):
    none = url_filter.UrlFilter(spark.createDataFrame([], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in none.judged(pages, "page_id").collect()] == [(1, "a.net", "/x", None, "allow")]
    some = url_filter.UrlFilter(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert some.judged(pages.limit(0), "page_id").count() == 0
    with pytest.raises(ValueError):
        url_filter.UrlFilter(spark.createDataFrame([("a", "/" * 70_000, "block")], "host string, path string, verdict string"))


def test_filter_lets_few_others_through(spark):
    rules = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    f = url_filter.UrlFilter(rules)
    keys = spark.range(40_000).select("id", F.array(F.struct(F.xxhash64(F.concat(F.lit("h"), "id", F.lit(".org"))).alias("h"))).alias("keys"))
    got = f.possible(keys, "keys", "id").where(F.size("keys") > 0)
    assert got.where("id < 20000").count() == 20_000 and got.where("id >= 20000").count() < 200
