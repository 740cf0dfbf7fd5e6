"""Line, substring, passage and MinHash dedup, and decontamination, against plain versions."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontamination, line_dedup, minhash, passages, substring_dedup
from plumbline.llm.line_dedup import CuckooFilter, LineIndex
from tests.llm.helpers import Union, empty, prose, rows, sha, table

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_hand(data):
    docs = [(d, (t or "").split("\n")) for d, t, *_ in data]
    where = {}
    for d, ls in docs:
        for x in ls:
            k = x.strip(SPACE).translate(LOW)
            if len(k) >= 20:
                where.setdefault(k, set()).add(d)
    out = []
    for d, ls in docs:
        kept = [x for x in ls if not (len(where.get(k := x.strip(SPACE).translate(LOW), ())) >= 3 and d != max(where[k]))]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out)


def test_lines(spark):
    got = line_dedup.dedup_lines(table(spark, extra=True)).drop("kept").collect()
    assert sorted(map(tuple, got)) == lines_by_hand(rows())
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_repeated_rows_count_once(spark):
    line = "a line of more than twenty characters"
    data = [(1, line, None, None, 0), (1, line, None, None, 0), (2, line, None, None, 0)]
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(table(spark, data)).collect()} == {0}


def test_lines_insert_and_delete(spark):
    data = rows()
    index = LineIndex.build(table(spark, data[:9]))
    index = index.insert(table(spark, data[9:]))
    got = index.apply(table(spark, data)).drop("kept").collect()
    assert sorted(map(tuple, got)) == lines_by_hand(data)
    index = index.delete(spark.createDataFrame([(11,)], "doc_id long"))
    left = [r for r in data if r[0] != 11]
    assert sorted(map(tuple, index.apply(table(spark, left)).drop("kept").collect())) == lines_by_hand(left)


def test_lines_inserted_beyond_the_first_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "PLACE", 50)
    lines = [prose(300 + i, 8) for i in range(60)]
    data = [(k, "\n".join(lines[k % 7 :: 2]), None, None, 0) for k in range(20)]
    index = LineIndex.build(table(spark, data[:3]))
    assert index.shards <= 2
    index = index.insert(table(spark, data[3:]))
    assert index.shards == 3
    assert sorted(map(tuple, index.apply(table(spark, data)).drop("kept").collect())) == lines_by_hand(data)
    index = index.delete(spark.createDataFrame([(k,) for k in range(3, 20)], "doc_id long"))
    assert sorted(map(tuple, index.apply(table(spark, data[:3])).drop("kept").collect())) == lines_by_hand(data[:3])


def test_lines_updated_again_and_again(spark):
    """Insertions, deletions and insertions of deleted documents, in any order, give what a new index gives."""
    import random

    rng = random.Random(8)
    lines = [prose(500 + i, 6) for i in range(25)]
    there = {k: "\n".join(rng.sample(lines, 4)) for k in range(12)}
    frame = lambda d: table(spark, [(k, x, None, None, 0) for k, x in sorted(d.items())])
    index = LineIndex.build(frame(there))
    for turn in range(4):
        gone = rng.sample(sorted(there), 4)
        index = index.delete(spark.createDataFrame([(k,) for k in [*gone, 999, None]], "doc_id long"))
        back = {k: there.pop(k) for k in gone}
        more = {100 * turn + k: "\n".join(rng.sample(lines, 5)) for k in range(20, 23)} | {gone[0]: back[gone[0]], gone[1]: lines[turn]}
        index = index.insert(frame(more))
        there |= more
        if turn == 2:
            index = index.compact()
            assert len(index.postings) == len(index.counts) == len(index.filters) == 1 and index.gone is None
        assert sorted(map(tuple, index.apply(frame(there)).drop("kept").collect())) == lines_by_hand([(k, x) for k, x in there.items()])
    same = index.insert(frame(there))  # all there already
    assert sorted(map(tuple, same.apply(frame(there)).drop("kept").collect())) == lines_by_hand([(k, x) for k, x in there.items()])
    assert index.insert(empty(spark)).apply(frame(there)).count() == len(there)


def shuffled_rows(spark, f):
    """What f gives, and how many rows its stages wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = f()
    return out, total() - before


def test_an_update_shuffles_the_touched_keys_only(spark):
    common = [prose(700 + i, 6) for i in range(3)]
    data = [(k, "\n".join([*common, *(prose(10_000 + 40 * k + i, 5) for i in range(40))]), None, None, 0) for k in range(500)]
    index = LineIndex.build(table(spark, data))
    n = index.postings[0].count()
    one = table(spark, [(9000, "\n".join([*common, prose(5, 6)]), None, None, 0)])
    grown, rows = shuffled_rows(spark, lambda: index.insert(one))
    assert n > 20_000 and rows < 400
    left, rows = shuffled_rows(spark, lambda: grown.delete(spark.createDataFrame([(9000,)], "doc_id long")))
    assert rows < 2500  # the postings of three lines whose last document goes
    counts = {(r["k1"], r["k2"]): (r["n_docs"], r["last_doc"]) for r in LineIndex._newest(left.counts, ["k1", "k2"]).where("n_docs > 1").collect()}
    assert sorted(counts.values()) == [(500, 499)] * 3


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    f = CuckooFilter.build(keys[:10_000])
    assert f.holds(keys[:10_000]).all() and f.holds(keys[10_000:]).mean() < 0.002
    f.delete(keys[:5000])
    assert f.holds(keys[5000:10_000]).all() and f.holds(keys[:5000]).mean() < 0.01
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.insert(keys[:100])
    assert f.holds(keys[:100]).all()
    twice = CuckooFilter.sized(64)
    twice.insert(np.array([5, 5, 5, 9]))
    twice.delete(np.array([5, 5]))
    assert twice.holds(np.array([5, 9])).all() and (twice.slots != 0).sum() == 2
    twice.delete(np.array([5]))
    assert twice.holds(np.array([5, 9])).tolist() == [False, True]


def substrings_by_hand(texts, n):
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - n + 1):
            seen.setdefault(t[k : k + n], []).append((i, k))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + n] = b"\x01" * n
    return gone


def summed(texts, n):
    out = []
    for t, g in zip(texts, substrings_by_hand(texts, n), strict=True):
        out.append((len(t), sum(g), len(re.findall(b"\x01+", bytes(g))), sha(bytes(c for c, x in zip(t, g, strict=True) if not x))))
    return out


def test_substrings(spark):
    data = rows() + [(20 + i, prose(60 + i, 20) + prose(50, 90)[i * 7 :], None, None, 0) for i in range(6)]
    got = substring_dedup.dedup_substrings(table(spark, data, extra=True)).collect()
    want = [(d, *x) for (d, *_), x in zip(data, summed([(r[1] or "").encode() for r in data], 200), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize(("hot", "entries"), [(2, 1 << 20), (20_000, 0), (2, 0)])
def test_substrings_of_hot_groups(spark, monkeypatch, hot, entries):
    """Groups that are hot by their contexts, or marked by runs that hold more than four of them, or neither."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "ENTRIES", entries)
    common = prose(70, 25)  # in different company each time
    data = rows() + [(20 + i, f"{prose(80 + i % 9, 12)} {common} {prose(90 + i % 4, 30)}", None, None, 0) for i in range(30)]
    got = substring_dedup.dedup_substrings(table(spark, data)).collect()
    want = [(d, *x) for (d, *_), x in zip(data, summed([(r[1] or "").encode() for r in data], 200), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pieces_parse_like_the_whole():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 101, n).astype("u1")) for n in (0, 5, 900, 20_000)] + [b"a" * 3000]
    whole, pieces = (substring_dedup.triggers(texts, 200, n) for n in (1 << 20, 700))
    for c in ("doc", "at", "most", "least", "alone", "keys"):
        assert (getattr(whole, c) == getattr(pieces, c)).all()


def test_substrings_of_repeated_rows(spark):
    data = [(1, prose(1, 100), None, None, 0), (1, prose(1, 100), None, None, 0), (1, prose(9, 100), None, None, 0)]
    got = sorted(r["n_removed"] for r in substring_dedup.dedup_substrings(table(spark, data)).collect())
    assert got[0] == 0 and got[1] == got[2] == len(prose(1, 100))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab", min_size=60, max_size=400), min_size=1, max_size=6), st.integers(64, 90))
def test_equal_splits_find_all_strings(texts, n):
    """All triggers in one group and none settled: the two suffix arrays alone must find every repeated string."""
    raw = [t.encode() for t in texts]
    p = substring_dedup.Parse(raw, n)
    use = ~p.alone
    at, most, least = p.at[use], p.most[use], p.least[use]
    x = p.x.tobytes()
    found = substring_dedup.equal_splits(np.zeros(len(at), np.int64), [x[a - m : a] for a, m in zip(at, most, strict=True)], [x[a : a + n - k] for a, k in zip(at, least, strict=True)], most, least, n)
    strings = {}
    for b, e in zip(p.begin, p.end, strict=True):
        for k in range(b, e - n + 1):
            strings.setdefault(x[k : k + n], []).append(k)
    for a, m, k, row in zip(at, most, least, found, strict=True):
        for j in range(k, m + 1):
            s = x[a - j : a - j + n]
            covered = sum(1 for q in strings[s] if any(t - mm <= q <= t - kk for t, mm, kk in zip(at, most, least, strict=True)))
            assert row[j] == (covered > 1)


def test_passages(spark):
    got = {r["doc_id"]: r for r in passages.documents_with_passages(table(spark, extra=True)).collect()}
    assert {4, 5, 6, 7, 8} <= set(got)
    assert got[5]["class_id"] == 4 and got[6]["class_id"] == 4 and got[8]["class_id"] == 7
    assert got[7]["n_shared_words"] == 70 and got[8]["passages"] == [(80, 150)]
    assert not {1, 2, 3, 9, 13, 15} & set(got)
    assert passages.documents_with_passages(empty(spark)).count() == 0


def test_passages_are_fuzzy(spark):
    w = prose(21, 200).split()
    edited = [*w[:60], "changed", *w[61:120], "one", "two", *w[120:150], *w[151:]]
    data = [(1, prose(22, 90) + " " + " ".join(w), None, None, 0), (2, " ".join(edited) + " " + prose(23, 90), None, None, 0), (3, prose(24, 300), None, None, 0)]
    got = passages.shared_passages(table(spark, data)).collect()
    assert len(got) == 1 and (got[0]["a"], got[0]["b"], got[0]["sa"], got[0]["sb"]) == (1, 2, 90, 0) and got[0]["same"] == 198


def chain_score(c, sa, sb, size, cost):
    return sum(size[i] for i in c) - sum(cost * (sa[j] - sa[i] - size[i] + sb[j] - sb[i] - size[i]) for i, j in zip(c, c[1:]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 6)), min_size=1, max_size=7, unique_by=lambda x: x[:2]))
def test_best_chain(segments):
    sa, sb, size = map(list, zip(*segments, strict=True))
    best = 0
    for mask in range(1, 1 << len(sa)):
        c = sorted((i for i in range(len(sa)) if mask >> i & 1), key=lambda i: sa[i])
        if all(sa[i] < sa[j] and sb[i] < sb[j] for i, j in zip(c, c[1:])):
            best = max(best, chain_score(c, sa, sb, size, 0.2))
    got = passages.chains(sa, sb, size, 0.2)
    assert sorted(i for c in got for i in c) == list(range(len(sa)))
    assert abs(chain_score(got[0], sa, sb, size, 0.2) - best) < 1e-9


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_common_subsequence(x, y):
    t = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1, j + 1] = t[i, j] + 1 if a == b else max(t[i, j + 1], t[i + 1, j])
    assert passages.common_subsequence(np.array(x, int), np.array(y, int)) == t[-1, -1]


def test_word_hashes(monkeypatch):
    texts = [b"", b"  ", b"A b\x0ba  B\xc3\x89 \xc3\xa9", b"x" * 50 + b" y " + b"x" * 50 + b"  " + b"X" * 50, "é\u00a0ß\u2003z".encode()]
    words = [t.lower().split() for t in texts]
    for piece in (1 << 18, 16, 3):
        monkeypatch.setattr(minhash, "PIECE", piece)
        got = [minhash.word_hashes(t).tolist() for t in texts]
        assert [len(g) for g in got] == [len(w) for w in words]
        name = {}
        assert all(name.setdefault(w, h) == h for ws, hs in zip(words, got, strict=True) for w, h in zip(ws, hs, strict=True))
        assert len(set(name.values())) == len(name)


def near_by_hand(data, k, percent):
    sets = {}
    for d, t, *_ in data:
        w = (t or "").translate(LOW).encode().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    u = Union()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u.join(a, b)
    return sorted((d, len(sets[d]), u.root(d), u.root(d) == d) for d in ids)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_documents(spark, k, percent):
    base = prose(31, 150).split()
    data = rows()
    for i in range(30):  # a group in which only some pairs are links
        w = list(base)
        for j in range(i % 7):
            w[(i * 11 + j * 23) % 150] = f"new{i}{j}"
        data.append((100 + i, " ".join(w), None, None, 0))
    got = minhash.near_documents(table(spark, data, extra=True), k, percent).collect()
    assert sorted(map(tuple, got)) == near_by_hand(data, k, percent)
    assert minhash.near_documents(empty(spark)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Two texts at a similarity below the threshold stay apart, whatever else one of the ids holds; any text of an id links it."""
    base = prose(41, 100).split()
    other = [*base[:60], *prose(42, 40).split()]
    close = [*base[:97], "x", *base[98:]]
    far = prose(43, 80)
    data = [(7, " ".join(base)), (9, " ".join(other)), (7, "some words"), (7, far), (11, " ".join(close)), (12, far + " end"), (13, "some words"), (13, "some words")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_documents(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(7, 98, 7), (7, 1, 7), (7, 78, 7), (9, 98, 9), (11, 98, 7), (12, 79, 7), (13, 1, 7)}


def test_blocks_of_a_bucket_with_a_stray_member(spark, monkeypatch):
    """Members of the largest component are dealt once; every pair of different components still meets in one task."""
    from plumbline.llm import buckets

    rows = spark.createDataFrame([(0, 5, i, 1 if i < 40 else i) for i in range(47)], "band long, key long, doc_id long, comp long")
    got = buckets.open_blocks(rows, ["band", "key"], "doc_id", [], block=4).collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r["lo"], r["hi"]), []).append(r)
    met = {}
    for (lo, hi), members in tasks.items():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if a["comp"] != b["comp"] and (a["own"] != b["own"] or lo == hi):
                    met[frozenset((a["doc_id"], b["doc_id"]))] = met.get(frozenset((a["doc_id"], b["doc_id"])), 0) + 1
    assert set(met.values()) == {1} and len(met) == 40 * 7 + 21
    assert sum(r["doc_id"] < 40 for r in got) == 40 * 2


def test_one_of_each(spark):
    data = rows() + [(4, rows()[3][1], "en", "a", 9), (None, "no id", None, None, 0)]
    got = minhash.one_of_each(table(spark, data, extra=True))
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and ids.count(None) == 1 and {1, 2, 3} <= set(ids)
    assert got.columns == table(spark, extra=True).columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = np.sort(s[:1800]), np.sort(s[200:])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 0.8) < 0.15
    assert (minhash.common_counts([a, b], [a]).ravel() == [1800, 1600]).all()


def windows_by_hand(data, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW)) if i is not None else []
        for k in range(max(1, len(w) - n + 1) if w else 0):
            cut.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t, *_ in data:
        w = word.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for m in {len(x) for x in cut}:
            for k in range(len(w) - m + 1):
                if (own := cut.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out)


def test_contamination(spark):
    items = [(1, prose(2, 70)), (2, "Été où ÇA"), (12, "ab ab ab"), (3, None), (4, "..."), (None, "x"), (5, prose(99, 30)), (6, " ".join(prose(2, 70).split()[20:35]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(table(spark, extra=True), bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["item_ids"]), r["contaminated"]) for r in got) == windows_by_hand(rows(), items)
    none = bench.limit(0)
    assert decontamination.contamination(table(spark), none).where("contaminated").count() == 0
    assert decontamination.contamination(empty(spark), bench).count() == 0
    stay = decontamination.without_contaminated(table(spark, extra=True), bench)
    assert sorted(r["doc_id"] for r in stay.collect()) == [x[0] for x in windows_by_hand(rows(), items) if not x[-1]]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x a y b"), (2, "a a a b"), (3, "a " + "z " * 20 + "b c")], "doc_id long, text string")
    index = decontamination.Index(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert {r["doc_id"] for r in index.proximity(2).collect()} == {1}
    assert index.proximity(0).count() == 0


def test_passages_of_lines_that_stand_together(spark):
    """Two common lines of 30 words, each in many documents after and before other words, are a passage only where they meet."""
    one, two = prose(31, 30), prose(32, 30)
    data = [(k, f"{prose(100 + k, 40)} {line} {prose(200 + k, 40)}", None, None, 0) for k, line in enumerate([one, two] * 20)]
    data += [(k, f"{prose(100 + k, 40)} {one} {two} {prose(200 + k, 40)}", None, None, 0) for k in (50, 60)]
    got = passages.documents_with_passages(table(spark, data)).collect()
    assert [(r["doc_id"], r["class_id"], r["passages"]) for r in sorted(got)] == [(50, 50, [(40, 100)]), (60, 50, [(40, 100)])]


@pytest.mark.parametrize("holders", [2, 20])
def test_fuzzy_passages_of_seeds_that_others_hold_first(spark, holders):
    """All seeds of a passage stand in other documents before and between the two that share it, ten words in each."""
    w = prose(71, 60).split()
    other = [f"changed{k}" if k % 10 == 9 else x for k, x in enumerate(w)]
    pieces = [" ".join(w[k : k + 10]) for k in range(0, 51, 5)]
    data = [(at + 20 * k + n, f"{prose(1000 + at + 20 * k + n, 40)} {piece} {prose(9000 + at + 20 * k + n, 40)}", None, None, 0) for at in (0, 1000) for k, piece in enumerate(pieces) for n in range(holders)]
    data += [(k, f"{prose(300 + k, 70)} {' '.join(x)} {prose(600 + k, 70)}", None, None, 0) for k, x in ((900, w), (2000, other))]
    got = {r["doc_id"]: r for r in passages.documents_with_passages(table(spark, data).coalesce(1).sortWithinPartitions("doc_id")).collect()}
    assert set(got) == {900, 2000} and {r["class_id"] for r in got.values()} == {900}
    assert all(s <= 75 and e >= 125 for r in got.values() for s, e in r["passages"])


@pytest.mark.parametrize("block", [3, 4, 1000])
def test_holders_meet_each_with_each(monkeypatch, block):
    """Whether in one task or block by block, but for those that passages of one class cover."""
    import pyarrow as pa

    monkeypatch.setattr(passages, "BLOCK", block)
    rng = np.random.default_rng(block)
    h, d = np.repeat(np.array([5, 9, 12], np.uint64), [60, 40, 40]), np.concatenate([rng.integers(0, 30, 60), np.arange(40), np.arange(40)])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    p, n = np.arange(len(h)) * 50, np.full(len(h), 17)
    covered = d % 3 == 0
    entry = (d, 2 * p + covered, n, np.where(covered, d // 10 - d, 0))
    batch = pa.RecordBatch.from_pydict({"part": [k for k, _ in passages._dealt_entries(1, h, *entry)], "blob": [v for _, v in passages._dealt_entries(1, h, *entry)]})
    out = list(passages._paired(1)([batch]))
    more = [pa.RecordBatch.from_pylist([r], schema=b.schema) for b in out for r in b.to_pylist() if r["other"] is not None]
    blobs = [r["blob"] for b in [*out, *passages._crossed(1)(more)] for r in b.to_pylist() if r.get("other") is None]
    got = {(x, y) for v in blobs for x, y in zip(*(c.tolist() for c in passages._unpack(v, 5, False)[:2]))}
    sets = [sorted(set(d[h == k].tolist())) for k in (5, 9, 12)]
    assert got == {(x, y) for one in sets for x in one for y in one if x < y and not (x % 3 == 0 == y % 3 and x // 10 == y // 10)}
    assert bool(more) == (block < 1000)


def test_holders_of_a_common_line_meet_near_it_only(spark, monkeypatch):
    """Holders of a line that stands in many documents make no pairs by it alone, and the passages about it are found all the same, whichever words
    are changed, left out and put in."""
    line, w = prose(91, 14), prose(92, 60).split()
    one = [*w[:15], *line.split(), *w[15:]]
    other = [x if k % 7 != 3 or 12 < k < 31 else f"changed{k}" for k, x in enumerate(one) if k != 8]
    data = [(k, f"{prose(1000 + k, 70)} {line} {prose(2000 + k, 70)}", None, None, 0) for k in range(1, 60)]
    data += [(k, f"{prose(300 + k, 70)} {' '.join(x)} {prose(600 + k, 70)}", None, None, 0) for k, x in ((900, one), (990, other))]
    df = table(spark, data)
    made = []
    verified = passages._verified
    monkeypatch.setattr(passages, "_verified", lambda base, found, *more: made.append(found.count()) or verified(base, found, *more))
    got = []
    for block in (1024, 8):
        monkeypatch.setattr(passages, "BLOCK", block)
        got.append(sorted(passages.documents_with_passages(df).collect()))
    assert got[0] == got[1] and [r["doc_id"] for r in got[0]] == [900, 990] and {r["class_id"] for r in got[0]} == {900}
    assert max(made[1], made[3]) <= 10  # of 1,830 pairs


def test_words_said_over_and_over_meet_in_few_places():
    """Of a pair of seeds that one document holds 5,000 times in a row, and another once, one in 16 words and both ends meet."""
    d, p = np.array([1] * 5000 + [2]), np.array([2 * k for k in range(5000)] + [14])
    entry = (d, p, np.full(5001, 7), np.zeros(5001, np.int64))
    a, b, p, q, n = passages._met_segments(entry, np.array([0, 5000]), np.array([5000, 1]), np.array([0]), np.array([1]))
    assert len(a) <= 2 * 5000 // 16 + 8 and {0, 4999} <= set(p.tolist()) and np.diff(np.unique(p - q)).max() <= 17


def test_bytes_of_words_refuse_no_passage():
    rng = np.random.default_rng(5)
    wide, said = passages.SHORT + 2 * passages.REACH, []
    for trial in range(300):
        x, y = rng.integers(1, 255, (2, wide)).astype(np.uint8)
        n, lead = int(rng.integers(50, 110)), int(rng.integers(0, 60))
        part = x[lead : lead + n].copy()
        part[rng.choice(n, int(rng.integers(0, n // 4)), replace=False)] = 0
        part = np.delete(part, rng.choice(n, int(rng.integers(0, 8)), replace=False))
        y[lead : lead + len(part)] = np.where(part == 0, rng.integers(1, 255, len(part)), part)
        i, j = passages.matched(x, y, -passages.SLACK, passages.SLACK)
        if passages.stretches(i, j, 50, 0.8):
            said.append(all(passages.can_hold(s[None], t[None], np.zeros(1, np.int64), np.zeros(1, np.int64), 50, 0.8)[0] for s, t in ((x, y), (y, x))))
    assert len(said) > 100 and all(said)
    x, y = rng.integers(1, 255, (2, 100, wide)).astype(np.uint8)
    y[:, 60:74] = x[:, 60:74]
    assert not passages.can_hold(x, y, np.zeros(100, np.int64), np.zeros(100, np.int64), 50, 0.8).any()


@pytest.mark.parametrize("n,changed", [(60, 3), (60, 6), (60, 8), (100, 10), (100, 15), (100, 20)])
def test_fuzzy_passages_are_chained(n, changed):
    rng, got = np.random.default_rng(n + changed), 0
    for _ in range(20):
        w = rng.integers(1, 1 << 62, n + 200).astype(np.uint64)
        copy = w[50 : 50 + n].copy()
        copy[1 + rng.choice(n - 2, changed, replace=False)] = rng.integers(1, 1 << 62, changed).astype(np.uint64)
        x, y = w[: 100 + n], np.concatenate([w[100 + n : 150 + n], copy, w[150 + n :]])
        d, p, h = passages.seeds([x, y])
        i, j, _ = passages.links(h, d, p)
        got += bool(len(i) and passages.found_chains(*passages._segments(d, p, i, j, passages.K)))
    assert got >= 19


def plain_passage(x, y, least, identity):
    """Whether any stretches of ``least`` words or more have the identity, by every one of x and y that starts and ends in step."""
    return any(passages.common_subsequence(x[i : i + n], y[j : j + n]) >= identity * n for n in (least, least + 5, least + 10) for i in range(len(x) - n + 1) for j in range(max(0, i - 2), min(len(y) - n, i + 2) + 1))


@pytest.mark.parametrize("n,changed", [(50, 2), (60, 3), (60, 6), (60, 8), (60, 12), (100, 5), (100, 10), (100, 15), (100, 20)])
def test_fuzzy_passages_are_found_and_kept(n, changed):
    """Seeds, chains and alignment on passages with words replaced at random, of identities 0.8 to 0.96."""
    rng, got = np.random.default_rng(n + changed), 0
    for _ in range(20):
        w = rng.integers(1, 1 << 62, n + 200).astype(np.uint64)
        copy = w[50 : 50 + n].copy()
        copy[1 + rng.choice(n - 2, changed, replace=False)] = rng.integers(1, 1 << 62, changed).astype(np.uint64)
        x, y = w[: 100 + n], np.concatenate([w[100 + n : 150 + n], copy, w[150 + n :]])
        assert plain_passage(x[50 : 50 + n], copy, 50, 0.8)
        d, p, h = passages.seeds([x, y])
        i, j, _ = passages.links(h, d, p)
        found = passages.found_chains(*passages._segments(d, p, i, j, passages.K)) if len(i) else []
        got += any(passages.align(x, sa, ea, y, sb, eb, low, high, 50, 0.8) for _, _, sa, ea, sb, eb, low, high in found)
    assert got >= 19


def test_anchored_alignment_is_as_long_as_the_whole():
    rng = np.random.default_rng(8)
    for k in range(60):
        x = rng.integers(0, 400, rng.integers(30, 200)).astype("<u4")
        y = x.copy()
        y[rng.choice(len(y), rng.integers(0, len(y) // 6), replace=False)] = 1000 + k
        lead = rng.integers(0, 9)
        y = np.concatenate([rng.integers(0, 400, lead).astype("<u4"), y, rng.integers(0, 400, 12).astype("<u4")])
        i, j = passages.anchored(x, y, -int(lead), 0)
        assert (x[i] == y[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
        assert len(i) >= len(passages.matched(x, y, -int(lead) - passages.SLACK, -int(lead) + passages.SLACK)[0]) - 1


def test_passages_beside_other_matches():
    """A fuzzy passage that chaining joins to a common line some words on is kept when the whole chain fails."""
    rng = np.random.default_rng(5)
    w = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    copy = w[:60].copy()
    copy[[5, 14, 23, 32, 41, 50]] = rng.integers(1, 1 << 62, 6).astype(np.uint64)
    x = np.concatenate([w[:60], w[100:120], w[60:80]])
    y = np.concatenate([copy, w[120:140], w[60:80]])
    got = passages.align(x, 0, 100, y, 0, 100, 0, 0, 50, 0.95) + passages.align(x, 0, 100, y, 0, 100, 0, 0, 50, 0.88)
    assert got == [(0, 60, 0, 60, 54)]


def test_every_document_has_a_row(spark):
    got = {r["doc_id"]: r for r in passages.all_documents(table(spark)).collect()}
    assert set(got) == set(range(1, 19)) and got[8]["class_id"] == 7
    assert got[1]["class_id"] == 1 and (got[3]["n_passages"], got[3]["n_shared_words"], got[3]["passages"]) == (0, 0, [])


def test_flags_of_repeated_rows_are_merged():
    import zlib

    import pyarrow as pa

    settled, sample = ([substring_dedup.OPEN, 0, x] for x in (substring_dedup.SETTLED, substring_dedup.SAMPLE))
    for each in ((settled, sample), (sample, settled)):
        rows = pa.RecordBatch.from_pydict({"d": [1, 1, 2], "h": [5, 5, 5], "flags": [zlib.compress(bytes(f)) for f in (*each, settled)]})
        got = [(r["d"], list(zlib.decompress(r["flags"]))) for b in substring_dedup._strongest([rows]) for r in b.to_pylist()]
        assert got == [(1, sample), (2, settled)]


def test_repeated_rows_beside_another_context(spark):
    shared = prose(61, 60)
    text = f"{prose(62, 60)} {shared} {prose(63, 60)}"
    data = [(1, text, None, None, 0)] * 2 + [(2, f"{prose(64, 60)} {shared} {prose(65, 60)}", None, None, 0)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(table(spark, data), 200).collect()}
    assert got[1]["n_removed"] == len(text) and got[2]["n_removed"] >= len(shared)


def test_segments_of_very_many_pairs():
    """Groups are kept apart however many there are."""
    n = 9_000_000
    a = np.arange(n)
    got = passages.joined(a, a + 1, np.full(n, 7), np.full(n, 3), np.full(n, 5), 0)
    assert (got[4] == 5).all() and len(got[0]) == n
    with pytest.raises(OverflowError):
        passages.joined(np.arange(4), np.arange(4), np.full(4, 1 << 60), np.zeros(4, np.int64), np.full(4, 5), 0)


def test_a_document_that_all_others_share_with_is_cut_in_rows(spark, monkeypatch):
    """A passage in every document: the first holder's stretches are dealt to rows of bounded size, and each document finds its passage."""
    common = prose(77, 60)
    data = [(i, f"{prose(1000 + i, 30)} {common} {prose(3000 + i, 20)}", "en", "s", 0) for i in range(150)]
    df = table(spark, data)
    want = {tuple(r) for r in passages.all_documents(df).select("doc_id", "class_id", "n_passages", "n_shared_words").collect()}
    assert want == {(i, 0, 1, 60) for i in range(150)}
    monkeypatch.setattr(passages, "STRETCHES", 10)
    sizes = []
    original = passages._wanted
    monkeypatch.setattr(passages, "_wanted", lambda sides: sizes.append(original(sides)) or sizes[0])
    got = {tuple(r) for r in passages.all_documents(df).select("doc_id", "class_id", "n_passages", "n_shared_words").collect()}
    assert got == want
    most = sizes[0].groupBy("doc_id").agg({"*": "count"}).agg({"count(1)": "max"}).first()[0]
    longest = max(len(r["want"]) for r in sizes[0].collect())
    assert most >= 5 and longest <= 40


def test_ranges_are_merged(spark):
    import random

    rng = random.Random(3)
    data = [(d, s, s + rng.randint(1, 900)) for d in range(3) for s in (rng.randrange(40_000) for _ in range(60))]
    df = spark.createDataFrame(data, "doc_id long, s long, e long")
    got = {(r["doc_id"], r["s"], r["e"]) for r in passages._merged(df, "doc_id").collect()}
    want = set()
    for d in range(3):
        runs = []
        for s, e in sorted((s, e) for x, s, e in data if x == d):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        want |= {(d, s, e) for s, e in runs}
    assert got == want


def test_alignments_that_hold_no_passage_end_early():
    """Where too few words of every long stretch stand in the other text nothing is aligned; what is found stays the same."""
    rng = np.random.default_rng(1)
    found = ended = 0
    for t in range(300):
        y = rng.integers(0, 30 if t % 2 else 3000, 170).astype(np.uint32)
        x = y.copy()
        x[rng.integers(0, 170, int(rng.integers(0, 120)))] = 7
        x = np.delete(x, rng.integers(0, 170, 4 * (t % 3)))
        whole, early = passages.matched(x, y, -8, 8, 40), passages.matched(x, y, -8, 8, 40, 0.8)
        assert passages.stretches(*early, 50, 0.8) == passages.stretches(*whole, 50, 0.8)
        found += bool(passages.stretches(*whole, 50, 0.8))
        ended += len(whole[0]) > 0 and not len(early[0])
    assert found > 50 and ended > 20
