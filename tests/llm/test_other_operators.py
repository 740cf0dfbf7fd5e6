"""Embeddings, mixing, token output, toxicity, language id, the pipeline and the entry module."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import common, embedding_dedup, langid, mixing, tokens, toxicity
from plumbline.llm.components import components
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.rans import Coder, Frequencies
from tests.llm.helpers import Union, empty, prose, rows, table
from tests.llm.test_text_operators import near_by_hand, windows_by_hand


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (7, 7)]
    u = Union()
    for a, b in links:
        if a is not None:
            u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: u.root(x) for ab in links for x in ab if x is not None and u.root(x) != x}


def test_written_tables_can_be_deleted(spark):
    common.delete_written(spark)
    df = common.written(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and common.delete_written(spark) == 1
    assert common.delete_written(spark) == 0


def vectors():
    rng = np.random.default_rng(5)
    out = []
    for label in (0, 1):
        for c in range(12):
            centre = rng.normal(size=24)
            out += [(centre + rng.normal(size=24) * s, label) for s in (0.0, 0.0, 0.1, 0.25, 0.35, 0.45)]
    out = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(out)]
    k = len(out)
    return out + [(k, None, 1), (k + 1, [], 1), (k + 2, [0.0] * 24, 1), (k + 3, [1.0, None], 1), (k + 4, [float("nan")] * 24, 1), (k + 5, out[0][1], None), (k + 6, [1.0, 2.0], 1), (k + 7, [1.0, 2.0], 1)]


def links_by_hand(data, cosine=0.93):
    u, n = Union(), [0] * len(data)
    ok = [(p, np.array(v, np.float32).astype(float), k) for p, (_, v, k) in enumerate(data) if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for x, (p, a, k) in enumerate(ok):
        for q, b, m in ok[x + 1 :]:
            if k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                u.join(p, q)
                n[p] += 1
                n[q] += 1
    least = {}
    for p, (i, *_) in enumerate(data):
        least[u.root(p)] = min(i, least.get(u.root(p), i))
    return sorted((i, n[p], least[u.root(p)], least[u.root(p)] == i) for p, (i, *_) in enumerate(data))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors(spark):
    data = vectors() + [(0, vectors()[9][1], 0), (3, vectors()[3][1], 0), (500, vectors()[80][1], 1)]  # ids that repeat
    df = spark.createDataFrame(data, VECTORS)
    for c in ("n", "grp", "node", "k1", "key", "tab", "v", "u", "root", "component_id"):
        df = df.withColumn(c, embedding_dedup.F.lit("x"))
    assert sorted(map(tuple, embedding_dedup.near_vectors(df.repartition(3)).collect())) == links_by_hand(data)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def planted(dim, groups, seed):
    """Pairs and triples of vectors about the threshold, among random ones."""
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for cos in (1.0, 0.97, 0.94, 0.931, 0.929, 0.9)[: 2 + g % 5]:
            o = rng.normal(size=dim)
            o -= (o @ c) * c
            out.append(c * cos + o / np.linalg.norm(o) * np.sqrt(1 - cos * cos))
    return [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(out)]


@pytest.mark.parametrize(("dim", "bucket", "block", "halves"), [(64, 0.05, 4096, 2), (64, 512, 16, 1), (200, 1e-4, 8, 3)])
def test_vectors_of_longer_codes_and_several_blocks(spark, monkeypatch, dim, bucket, block, halves):
    data = planted(dim, 60, dim)
    assert embedding_dedup.code_length(len(data), dim, bucket) == halves
    monkeypatch.setattr(embedding_dedup.block_pairs, "__defaults__", (block, None))
    got = sorted(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(data, VECTORS), bucket=bucket).collect()))
    assert got == links_by_hand(data)


@pytest.mark.parametrize("halves", [1, 2, 3, 4])
@pytest.mark.parametrize("dim", [8, 64, 768])
def test_pairs_at_the_threshold_meet(halves, dim):
    rng = np.random.default_rng(halves * 1000 + dim)
    a, o = rng.normal(size=(300, dim)), rng.normal(size=(300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    x, y = (embedding_dedup.axes(v, 4 + 2 * halves, halves) for v in (a, b))
    there, back = embedding_dedup.meets(x, y)
    assert (there | back).any(axis=1).mean() >= 0.99
    c, d = embedding_dedup.codes(x), embedding_dedup.codes(y)
    assert ((d == c[:, :, :1]).any(axis=2) == there).all()
    s, t = embedding_dedup.sketches(a), embedding_dedup.sketches(b)
    assert (np.bitwise_count(s ^ t).sum(axis=1) <= embedding_dedup.most_apart(0.93)).all()


def test_hadamard_is_orthonormal():
    m = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(m @ m.T, np.eye(16))


def test_mix(spark):
    rng = random.Random(6)
    data = rows() + [(100 + i, prose(i, rng.randint(1, 60)), None, rng.choice(["a", "b", "c", "é", None]), 0) for i in range(300)]
    df = table(spark, data, extra=True)
    got = mixing.mix(df).collect()
    again = mixing.mix(table(spark, list(reversed(data)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    size = {d: len((t or "").encode().split()) for d, t, *_ in data}
    by = {}
    for d, _, _, s, _ in data:
        by[s] = by.get(s, 0) + size[d]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    w, capped, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(), sum(by.values())
    while True:
        level = (total - sum(3 * by[s] for s in capped)) / sum(w[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and level * w[s] > 3 * by[s]}
        if not new:
            break
        capped |= new
    for r in got:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and r["taken"] <= 3 * r["size"] and r["taken"] == r["n_copies"] * r["size"]
        assert r["target"] == pytest.approx(3 * by[s] if s in capped else level * w[s])
    for s in names:
        longest = max(size[d] for d, _, _, x, _ in data if x == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - next(r["target"] for r in got if r["source"] == s)) <= longest
    assert mixing.mix(empty(spark)).count() == 0
    copies = {r["doc_id"]: r["n_copies"] for r in got}
    assert sorted(r["doc_id"] for r in mixing.mixed(df).collect()) == sorted(d for d, k in copies.items() for _ in range(k))


def test_pivotal_keeps_expectations():
    ids, p, size = list(range(12)), [0.1, 0.5, 0.9, 0.3, 0.7, 0.25, 0.6, 0.4, 0.2, 0.8, 0.35, 0.9], [90, 70, 50, 44, 40, 31, 20, 18, 12, 9, 5, 1]
    total = np.zeros(12)
    want = sum(a * b for a, b in zip(p, size, strict=True))
    for seed in range(3000):
        out, mass = mixing.pivotal(ids, p, size, seed)
        total += [mass if x < 0 else x for x in out]
        assert sum((mass if x < 0 else x) * s for x, s in zip(out, size, strict=True)) == pytest.approx(want)
    assert np.abs(total / 3000 - p).max() < 0.04


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=300), max_size=8), st.integers(1, 64), st.integers(1, 8))
def test_rans_round_trip(docs, lanes, every):
    ids = np.array([x for d in docs for x in d], np.int64)
    coder = Coder(Frequencies.of_counts(np.bincount(ids, minlength=41)))
    block = coder.encode(ids, np.arange(len(docs)), np.array([len(d) for d in docs]), lanes, every)
    d, n, back = coder.decode(block)
    assert (back == ids).all() and n.tolist() == [len(x) for x in docs]
    points = int.from_bytes(block[12:16], "little")
    assert np.concatenate([np.zeros(0, np.uint32), *(coder.decode(block, k, k + 1)[2] for k in range(points))]).tolist() == ids.tolist()
    if len(block) > 40:
        bad = bytearray(block)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    data = rows() + [(4, "again", None, None, 0), (30, "don't (stop)... naïve é ΑΣ Σ! ½ it's'", None, None, 0)]
    monkeypatch.setattr(tokens, "_CACHED", 300)
    t = Tokenizer.from_file(tokenizer_path())
    folder = str(tmp_path / "out")
    tokens.write(table(spark, data, extra=True), folder, tokenizer_path(), block_tokens=500)
    got = sorted(tokens.read(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted((d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, *_ in data)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted(d for d, *_ in data)
    at = 0
    for r in got:
        assert r["start"] == at and 4 * r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert tokens.round_trip(empty(spark), tokenizer_path()).count() == 0


def test_chunk_cache_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "_CACHED", 200)
    c, t = tokens.ChunkIds(tokenizer_path(), "<u4"), Tokenizer.from_file(tokenizer_path())
    for k in range(12):
        texts = [prose(k, 80), prose(k + 100, 40), ""]
        assert c.encode([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


INSULTS = ("zorbnik", "quaddlehead", "vexwit")


def labelled(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        w = prose(seed * 10_000 + i, 60).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(INSULTS)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    data = labelled(400, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (902, "x " * 3), (903, prose(77, 30) + " zorb.nik quaddle_head ve*xwit z o r b n i k")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(docs, labels).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert got[903]["predicted"] == 1 and got[900]["score"] == got[901]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    none = toxicity.judged(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.judged(empty(spark), labels).count() == 0
    stay = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert stay == {d for d, r in got.items() if not r["predicted"]}


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["zorbnik", "zor.bnik", "zorxbnik", "plaintext"], ["zorbnik"]).ravel()
    assert k[0] == pytest.approx(1) and k[1] > 0.5 and k[2] > 0.5 and k[3] < 0.1


def test_folded_table_is_the_machine():
    marks = ["abcd", "bcde", "xyz"]
    alpha = np.array([0.5, -1.0, 2.0])
    table_ = np.zeros(1 << toxicity.BITS)
    for a, m in zip(alpha, marks, strict=True):
        _, k, v, n = toxicity.subsequences([m])
        np.add.at(table_, k, a * v / n[0])
    words = ["abcde", "xxyz", "q"]
    assert np.allclose(toxicity.table_scores(words, table_, 0.25), toxicity.kernel(words, marks) @ alpha + 0.25)


def test_languages(spark):
    def text(lang, i):
        rng = random.Random(f"{lang}{i}")
        syllables = {"aa": ["ka", "no", "mi", "ta"], "bb": ["schl", "eich", "ung", "ver"], "cc": ["où", "é", "ç", "eau"]}[lang]
        return " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))

    data = [(i, text(lang, i), lang, None, 0) for i, lang in enumerate(["aa", "bb", "cc"] * 60)] + [(900, None, "aa", None, 0), (901, "12 34 !", None, None, 0), (902, "", "bb", None, 0), (903, text("cc", 1), None, None, 0), (904, "漢字𠀀", None, None, 0)]
    got = {r["doc_id"]: r for r in langid.identify(table(spark, data, extra=True)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in data[:180])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[903]["lang_pred"] == "cc"
    assert got[904]["lang_pred"] in ("aa", "bb", "cc") and got[904]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty(spark)).count() == 0


def test_pipeline_and_entry(spark):
    import __spark_entry__
    import corpus_pipeline

    q = __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "decontamination", "mixing", "tokens"]
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in q if k.startswith("op")} and "pipeline" in q
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage, kept = docs, []
    for _, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, stage, d)
        assert stage.columns == docs.columns
        kept.append([tuple(r) for r in stage.select("doc_id", "text").collect()])
    clean, unlike, apart, mix_ = kept
    score = {r["doc_id"]: r["predicted"] for r in toxicity.judged(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert sorted(i for i, _ in clean) == sorted(i for i, y in score.items() if not y)
    assert sorted(i for i, _ in unlike) == [r[0] for r in near_by_hand(clean, 5, 80) if r[3]]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(i for i, _ in apart) == [r[0] for r in windows_by_hand(unlike, items) if not r[5]]
    assert {i for i, _ in mix_} <= {i for i, _ in apart} and max(Counter(i for i, _ in mix_).values()) <= 3
    want = sorted(r["doc_id"] for r in stage.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()) == want


def test_long_texts_are_counted_like_short_ones():
    texts = ["", "a", "Été où ça, 漢字𠀀 " * 40, "x" * 200, "12 ,"]
    whole, has = langid.counts(texts)
    for piece in (1, 7, 64):
        got, some = langid.counts(texts, piece)
        assert (got == whole).all() and (some == has).all()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    assert tokens.can_be_cut(Tokenizer.from_file(tokenizer_path()))
    with open(tokenizer_path()) as f:
        other = json.load(f)
    other["normalizer"] = None  # letters keep their case, and white space is not one space
    (tmp_path / "t.json").write_text(json.dumps(other))
    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not tokens.can_be_cut(t)
    texts = ["Hello World, don't", "", "a  b"]
    assert tokens.encode_texts([x.encode() for x in texts], str(tmp_path / "t.json")) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_nearest_centroid_by_hand():
    """Predictions are the language of the centroid with the largest cosine, the first of equal ones."""
    rng = np.random.default_rng(4)
    c = rng.random((5, langid.DIM)).astype(np.float32)
    c[3] = c[1]
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    m = langid.Model(["aa", "bb", "cc"], c, np.array([0, 0, 1, 1, 2]), np.ones(langid.DIM, np.float32), np.zeros(5))
    texts = [prose(k, 30) for k in range(20)] + ["", "7 !"]
    lang, score, rejected = m.predict(texts)
    tf, has = langid.counts(texts)
    for t, name, s in zip(tf, lang, score, strict=True):
        v = np.log1p(t)
        cos = [float(v @ x / np.linalg.norm(v)) if v.any() else 0.0 for x in c]
        best = max(range(5), key=lambda k: (round(cos[k], 5), -k))
        assert name == (["aa", "aa", "bb", "bb", "cc"][best] if v.any() else "und") and abs(s - cos[best]) < 1e-4
    assert rejected.tolist()[-2:] == [True, True] and has.tolist()[-2:] == [False, False]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents, no labels and no benchmark; and nulls, repeated rows and clashing names."""
    import corpus_pipeline

    d = str(tmp_path)
    empty(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    odd = rows() + [rows()[3], (4, "another text", "en", "a", 9), (None, "no id", None, None, 0)]
    stage = table(spark, odd, extra=True)
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, d)
    got = [r["doc_id"] for r in stage.collect()]
    assert got.count(None) == 1 and got.count(4) == 1 and {1, 2, 3} <= set(got) and 5 not in got
    mixed = corpus_pipeline.mix_sources(spark, stage, d)
    assert mixed.columns == stage.columns and None not in {r["doc_id"] for r in mixed.collect()}
    assert corpus_pipeline.write_tokens(spark, mixed, d).count() == mixed.count()


def test_a_query_can_be_the_first_of_its_session(tmp_path):
    """From another folder, workers have the package only if it was sent to them."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["op2_embedding_dedup"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 500" in out.stdout, out.stderr[-2000:]


def test_training_does_not_depend_on_the_order_of_texts():
    data = sorted(labelled(150, 4))
    a = toxicity.train([t for _, t, _ in data], [y for *_, y in data])
    bags = toxicity.Bags()
    for i, t, y in reversed(data):
        bags.add((i,), t, y)
    b = toxicity.train_bags(bags)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias and np.array_equal(a.curve, b.curve)
    marks = toxicity.train(["...", "?!", "a word"], [0, 0, 1])  # no word in clean texts
    assert marks.table is None and marks.prior == pytest.approx(1 / 3)
    assert toxicity.train([], []).prior == 0


def test_too_many_languages_for_a_sample_are_an_error(spark):
    data = [(i, f"some words of language {i}", f"l{i}", "s", 0) for i in range(30)]
    assert len(langid.fit(table(spark, data), sample=240).langs) <= 30
    with pytest.raises(ValueError, match="larger sample"):
        langid.fit(table(spark, data), sample=239)
