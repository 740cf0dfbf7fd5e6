"""Text, readout, statistics, requests, sampling, checks, sources and plug-ins."""

import hashlib
import itertools
import json
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import readout as R
from plumbline.functions import text as T
from plumbline.operators import plugins, qc, requests, rewriting, sampling, similarity, stats
from plumbline.plans import gate
from plumbline.sources import jsonl, package
from plumbline.sources.config import Config


def values(spark, data, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_lexicon(spark):
    texts = [("Riskier, SAFEST and volatile: boldly.",), ("A moderate, calm life.",), ("asterisk; unsafe; éboldé riské",), ("",)]
    got = values(spark, texts, "t string", T.lexicon_hits(F.col("t"), Config().banned))
    assert got == [["Riskier", "SAFEST", "volatile", "boldly"], [], ["riské"], []]


def test_tokens_split_at_all_white_space(spark):
    assert values(spark, [("a b c \t d\n",), ("",)], "t string", T.token_count(F.col("t"))) == [4, 0]


def test_shingles(spark):
    got = values(spark, [("a b c d e f",), ("a b",), ("",)], "t string", T.shingles(T.tokens(F.col("t"))))
    assert [sorted(x) for x in got] == [["a b c d e", "b c d e f"], ["a b"], [""]]


def test_templates_are_md5_mod_24(spark):
    ids = [(f"p{i:05d}",) for i in range(500)]
    for (k,), got in zip(ids, values(spark, ids, "k string", T.template_id(42, F.col("k"))), strict=True):
        n = int(hashlib.md5(f"42|{k}".encode()).hexdigest(), 16) % 24
        assert got == f"tmpl_{n // 4:02d}_{n % 4}"


def test_tenure(spark):
    rows = spark.createDataFrame([("a", "p", "I have been investing for over two decades now."), ("b", "q", "I have been investing for over two decades now."), ("c", "p", "I invested for a while; I won't need it for several decades."), ("d", "x", "been an investor since twenty years")], "vignette_id string, profile_id string, text string")
    people = spark.createDataFrame([("p", 23), ("q", 70), ("r", None)], "profile_id string, age int")
    got = qc.tenure(rows, people).collect()
    assert [(r["vignette_id"], r["age"], r["snippet"]) for r in got] == [("a", 23, "I have been investing for over two decades now.")]


def test_user_message(spark):
    m = values(spark, [(None,), ("  Do it. ",)], "i string", T.user_message(F.lit(" Frame. "), F.lit("Story"), F.array(F.lit("x"), F.lit("y")), F.col("i")))
    tail = "Frame.\nThe client writes:\nStory\nTo choose from:\n[A] x\n[B] y\n" + T.ANSWER
    assert m == [tail, "Do it.\n" + tail]


def test_implicit_phrasings_hold_no_stem():
    from plumbline.operators import narrative as N

    said = [x for _, implicit in N.LEVELS.values() for x in implicit] + [x for bands in N.BANDS.values() for _, _, _, implicit in bands for x in implicit]
    said += [x for t in N.WORTH.values() for x in t] + [*N.OPENINGS, *N.PASTIMES]
    stems = re.compile(r"\b(?:" + "|".join(Config().banned) + ")", re.I)
    assert [x for x in said if stems.search(x)] == []
    assert all(len(set(x)) == len(x) >= 2 for pair in N.LEVELS.values() for x in pair)
    assert all(sorted(o) == list(range(9)) for o in N.ORDERINGS) and len(set(N.ORDERINGS)) == 4


def test_rotations():
    r = R.rotations(4)
    assert all(sorted(p[s] for p in r) == [0, 1, 2, 3] for s in range(4)) and len(R.rotations(4, 2)) == 2


def test_rotation_column(spark):
    assert [list(x) for x in spark.range(1).select(R.rotations_column(4, 3)).first()[0]] == R.rotations(4, 3)


def results_of(spark, pick):
    """Logits by which the model picks a slot, given the permutation."""
    rows = [("v", "baseline", perm, [50.0 if k == pick(perm) else 0.0 for k in range(4)] + [0.0] * 3) for perm in R.rotations(4)]
    df = spark.createDataFrame(rows, "vignette_id string, condition string, perm array<int>, logits array<double>")
    return gate.results(df, Config()).first()


def test_preference_is_found(spark):
    r = results_of(spark, lambda perm: perm.index(2))
    assert r["p_alloc"] == pytest.approx([0, 0, 1, 0]) and r["aggressiveness"] == pytest.approx(0.7) and not r["hedged"]


def test_position_bias_cancels(spark):
    r = results_of(spark, lambda perm: 0)
    assert r["p_alloc"] == pytest.approx([0.25] * 4) and r["aggressiveness"] == pytest.approx(0.55)


@pytest.mark.parametrize(("mass", "frac", "want"), [(0.3, 1.0, True), (0.9, 0.2, True), (0.9, 1.0, False), (0.5, 0.5, False)])
def test_hedged(spark, mass, frac, want):
    assert spark.range(1).select(R.hedged(F.lit(mass), F.lit(frac))).first()[0] is want


def test_units(spark):
    df = spark.createDataFrame([("a", "t", True), ("b", "t", False)], "vignette_id string, text string, contradictory boolean")
    got = gate.scoring_units(df, Config()).groupBy("vignette_id", "condition").count().collect()
    assert sorted(map(tuple, got)) == [("a", "baseline", 4), ("a", "instruction", 4), ("b", "baseline", 4)]


def gate_rows(spark, rows):
    return spark.createDataFrame(rows, "vignette_id string, pair_id string, vignette_type string, tier string, risk_score double, condition string, aggressiveness double, hedged boolean")


def test_gate_passes_and_hedging_fails(spark):
    rows = [(f"v{i}", None, "implicit", "moderate", float(i), "baseline", i / 100 + (i % 3) * 0.01, False) for i in range(100)]
    r = gate.gate_report(gate_rows(spark, rows), Config(), 40)
    assert r["gate"]["PASS"] and r["spearman"]["implicit"]["rho"] > 0.9 and r["spearman"]["implicit"]["ci"][0] <= r["spearman"]["implicit"]["rho"]
    r = gate.gate_report(gate_rows(spark, [(*x[:7], i % 2 == 0) for i, x in enumerate(rows)]), Config(), 40)
    assert r["hedge_rate"] == 0.5 and not r["gate"]["PASS"]


def test_gate_leaves_pairs_out_and_finds_deltas(spark):
    twins = [(f"v{i}", None, "implicit", "moderate", float(i), "baseline", i / 50, False) for i in range(50)]
    pairs = [(f"w{i}", f"p{i}", "implicit", "moderate", float(i), "baseline", -i / 50, False) for i in range(50)]
    r = gate.gate_report(gate_rows(spark, twins + pairs), Config(), 20)
    assert r["n_twins"] == 50 and r["n_baseline"] == 100 and r["spearman"]["overall"]["rho"] > 0.9
    two = [(f"v{i}", None, "implicit", "moderate", 50.0, c, x, False) for i in range(20) for c, x in (("baseline", 0.5), ("instruction", 0.4))]
    r = gate.gate_report(gate_rows(spark, two), Config(), 20)
    assert r["two_condition"]["n_pairs"] == 20 and r["two_condition"]["mean_delta"] == -0.1 and "implicit" not in r["spearman"] and not r["gate"]["PASS"]


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8], [2, 1, 4, 4, 5, 3, 3, 8, 8, 9, 7]
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0)] + [("flat", 1.0, float(i)) for i in range(12)], "g string, x double, y double")
    got = stats.spearman(df, "x", "y", "g").collect()
    assert [r["g"] for r in got] == ["g"] and got[0]["rho"] == pytest.approx(want)


def test_wilcoxon_exact_and_normal():
    for n, w in ((5, 3), (8, 11), (10, 0)):
        ways = sum(min(s, n * (n + 1) // 2 - s) <= w for s in (sum(k for k, b in enumerate(bits, 1) if b) for bits in itertools.product((0, 1), repeat=n)))
        assert stats.wilcoxon_p_value(n, w, n * (n + 1) / 2 - w, 0) == pytest.approx(min(1, ways / 2**n), rel=1e-9)
    assert math.isnan(stats.wilcoxon_p_value(0, 0, 0, 0))
    assert stats.wilcoxon_p_value(60, 915, 915, 6) == pytest.approx(1.0)


def test_paired_deltas_drop_the_unmatched(spark):
    df = spark.createDataFrame([("a", "baseline", 1.0), ("a", "baseline", 2.0), ("a", "instruction", 5.0), ("b", "instruction", 1.0), ("c", "baseline", 1.0)], "k string, c string, v double")
    assert [tuple(r) for r in stats.paired_deltas(df, "k", "c", "v").collect()] == [("a", 3.0)]
    assert stats.delta_summary(stats.paired_deltas(df, "k", "c", "v")).count() == 0


def test_requests(spark):
    cfg = Config()
    jobs = spark.createDataFrame([("old", "explicit"), ("new", "implicit"), ("new", "implicit"), ("new", "explicit")], "text string, mode string")
    cid = lambda mode, text: hashlib.sha1(f"openai|gpt-4o-mini|{mode}|{text}".encode()).hexdigest()
    cache = spark.createDataFrame([(cid("explicit", "old"), "done", "m")], "cache_id string, text string, model string")
    lines, sidecar = requests.build_batch(jobs, cache, cfg, "sys")
    assert {r["custom_id"] for r in lines.collect()} == {cid("implicit", "new"), cid("explicit", "new")} and sidecar.count() == 2
    assert {r["cached_text"] for r in requests.hits(requests.with_ids(jobs, cfg), cache).collect()} == {"done", None}
    answer = lambda i, code, said: json.dumps({"custom_id": i, "response": {"status_code": code, "body": {"choices": [{"message": {"content": said}}]}}})
    got = [answer(cid("implicit", "new"), 200, "very risky"), answer(cid("explicit", "new"), 200, " fine "), answer("unknown", 200, "x")]
    responses = spark.createDataFrame([(x,) for x in got], "l string").select(F.from_json("l", jsonl.RESPONSE).alias("r")).select("r.*")
    rows = requests.collected(responses, sidecar, cfg)
    assert {(r["text"], r["model"]) for r in rows.collect()} == {("new", "template-only"), ("fine", "gpt-4o-mini")}
    assert tuple(requests.summary(rows).first()) == (2, 1, 0)
    failed = responses.limit(1).select("custom_id", F.lit(None).cast(responses.schema["response"].dataType).alias("response"))
    assert requests.summary(requests.collected(failed, sidecar, cfg)).first()["errors"] == 1
    with pytest.raises(ValueError, match="openai"):
        requests.build_batch(jobs, cache, Config(backend="gemini"), "sys")


def test_similar_texts(spark):
    a = " ".join(f"w{i}" for i in range(40))
    data = [(1, a), (2, a), (3, a + " more"), (4, "short"), (5, "short"), (6, " ".join(f"v{i}" for i in range(40))), (7, "")]
    df = spark.createDataFrame(data, "k int, t string")
    assert {r["k"] for r in similarity.duplicated(df, "k", "t").where("is_dup").collect()} == {1, 2, 3, 4, 5}
    assert {r["k"] for r in similarity.minhash_duplicated(df, "k", "t").where("is_dup").collect()} >= {1, 2, 4, 5}
    pairs = {(r["a"], r["b"]): r["jaccard"] for r in similarity.similar_pairs(df, "k", "t").collect()}
    assert set(pairs) == {(1, 2), (1, 3), (2, 3), (4, 5)} and pairs[1, 3] == pytest.approx(36 / 37)


def test_sampling(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"), (F.col("id") == 999).alias("flag"))
    got = sampling.stratified_sample(df, "s", "id", 100, 1)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {0: 33, 1: 33, 2: 33}
    assert sampling.stratified_sample(df, "s", "id", 100, 1, flag="flag").where("flag").count() == 1
    assert sampling.stratified_sample(df.limit(0), "s", "id", 100, 1).count() == 0
    assert [r["batch"] for r in sampling.fixed_batches(df, "id", 300).orderBy("id").collect()] == [i // 300 for i in range(1000)]
    assert sampling.shuffled_limit(df, "id", 7, 1).count() == 7


def test_checks(spark):
    even = spark.createDataFrame([(t,) for t in "aabbcc"], "t string")
    assert qc.balance(even, "t", 3, 0.02).first()[0] and not qc.balance(even.limit(5), "t", 3, 0.02).first()[0] and qc.balance(even.limit(0), "t", 3, 0.02).first()[0]
    assert even.limit(0).agg(qc.mean_or_zero(F.length("t"))).first()[0] == 0.0
    assert qc.length_match(even, "t", F.length("t"), 0.1).first()["matched"]


def test_report(spark, tmp_path):
    rows = [("v1", "p1", None, "conservative", "implicit", "I am risk averse and calm"), ("v2", "p1", None, "moderate", "explicit", "nothing"), ("v3", "p2", "pair_1", "aggressive", "implicit", "x y z")]
    df = spark.createDataFrame(rows, "vignette_id string, profile_id string, pair_id string, tier string, vignette_type string, text string")
    r = qc.report(df, spark.createDataFrame([("p1", 25)], "profile_id string, age int"), Config())
    assert r["counts"] == {"explicit": 1, "implicit": 1, "pairs": 1} and r["banned_leaks"]["count"] == 1 and r["hard_fail"] and r["age_experience_coherence"]["pass"]
    jsonl.write_report(spark, r, str(tmp_path / "a" / "r.json"))
    assert json.loads((tmp_path / "a" / "r.json").read_text())["banned_leaks"]["examples"][0]["hits"] == ["risk"]
    assert jsonl.report_name("data/vignettes_edge") == "qc_report_edge.json" and jsonl.report_name("data/vignettes/") == "qc_report.json"


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", None, "moderate", 1.0, "explicit", "t", False, "m", [], "x"), ("b", "p", "pair", "moderate", 1.0, "implicit", "t", False, "m", ["risk"], "y")], jsonl.VIGNETTE)
    jsonl.write_buckets(df, str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / "explicit.jsonl").glob("part-*"))
    assert '"pair_id":null' in text
    back = jsonl.read_union(spark, str(tmp_path))
    assert sorted((r["vignette_id"], r["source"], r["source_order"]) for r in back.collect()) == [("a", "explicit", 0), ("b", "pairs", 2)]
    assert jsonl.read(spark, str(tmp_path / "none"), jsonl.PROFILE, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        jsonl.read(spark, str(tmp_path / "none"), jsonl.PROFILE).count()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nrubric:\n  fields:\n    a: {weight: 1.0, range: [0, 4], invert: true}\n  tier_cutoffs: {conservative_max: 10, moderate_max: 20}\ngate: {spearman_rho_min: 0.9}\n")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert c.seed == 7 and c.rubric.fields[0].invert and c.rubric.moderate_max == 20 and c.rho_min == 0.9 and c.n_pairs == 1200


def test_plugins(spark):
    jobs = spark.createDataFrame([("a safe thing", "implicit"), ("b", "explicit")], "text string, mode string")
    got = {r["text"]: (r["final_text"], r["model"]) for r in rewriting.rewritten(jobs, Config(), lambda p: p.split("\n")[0].upper()).collect()}
    assert got == {"a safe thing": ("a safe thing", "template-only"), "b": ("B", "gpt-4o-mini")}
    assert {r["model"] for r in rewriting.rewritten(jobs, Config()).collect()} == {"template-only"}
    calls = []

    def twice(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return p

    assert rewriting.called(twice, "x", wait=0) == "x" and len(calls) == 3
    with pytest.raises(OSError):
        rewriting.called(lambda p: (_ for _ in ()).throw(OSError()), "x", wait=0)
    rows = spark.createDataFrame([(f"v{i}", "t", "moderate") for i in range(4)], "vignette_id string, text string, tier string")
    assert tuple(plugins.round_trip(rows, Config(), lambda t: " Moderate.").first()) == (4, 1.0)
    units = spark.createDataFrame([("q",), ("rr",)], "user_msg string")
    assert plugins.prompt_scores(units, plugins.stub_scorer, 1).select(F.size("logits")).first()[0] == 7


def test_token_counts_and_batches(spark):
    df = spark.createDataFrame([("a bc d",), (None,)], "t string")
    assert [r[0] for r in df.select(plugins.token_counts(F.col("t"), len)).collect()] == [6, None]
    assert [r[0] for r in df.select(plugins.token_counts(F.coalesce("t", F.lit("")))).collect()] == [3, 0]

    class Service:
        states = ["validating", "in_progress", "completed"]

        def status(self, batch_id):
            return self.states.pop(0)

    assert plugins.awaited(Service(), "b", interval=0) == "completed"


def test_batches_of_whole_texts_are_bounded_by_bytes(spark):
    package.ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8388608b"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    text = F.when(F.col("id") == 150, F.repeat(F.lit("x"), 20_000_000)).otherwise(F.repeat(F.lit("x"), 100_000))
    got = spark.range(0, 300, 1, 1).select(text.alias("text")).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 300
    assert all(r["bytes"] <= (8 << 20) + 200_000 for r in got if r["bytes"] < 20_000_000)  # only the long text's batch is larger
    assert sum(r["bytes"] >= 20_000_000 for r in got) == 1 and max(r["bytes"] for r in got) < 29_000_000


def test_a_common_shingle_is_split_into_cells(spark):
    """All texts share a shingle that each of them must join by; tasks compare blocks of it, and every pair is found."""
    n = 3000
    sets = spark.range(n).select(F.col("id").alias("rep"), F.array(F.lit(7), 1000 + F.col("id"), 1000 + F.col("id") - F.col("id") % 2, 90000 + F.floor(F.col("id") / 6)).cast("array<long>").alias("s"))
    sets = sets.select("rep", F.array_sort(F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))).alias("s"))
    want = {}
    rows = {r["rep"]: set(r["s"]) for r in sets.collect()}
    for a in rows:
        for b in range(a + 1, min(n, a + 6)):
            j = len(rows[a] & rows[b]) / len(rows[a] | rows[b])
            if j >= 0.4:
                want[a, b] = j
    for block in (2048, 128):
        got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.class_links(sets, 0.4, block).collect()}
        assert got == pytest.approx(want)
    marked = similarity._marked(sets).withColumn("h", F.lit(1)).drop("s")
    pairs = similarity.met_pairs(marked, "h", 0.4, block=128)
    assert pairs.count() < 200_000  # of 4.5 million: the bitmaps stop the others within the join
    assert {tuple(r) for r in pairs.collect()} >= set(want)


def test_cells_are_bounded(spark):
    """100,000 rows under one value: no cell has more than two blocks of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(100_000).select(F.col("id").alias("rep"), (F.col("id") % 60_000 + 10).cast("int").alias("n"), F.array(*[F.xxhash64("id", F.lit(i)) for i in range(4)]).alias("m"), F.lit(1).alias("h"))
        cells = []
        original, similarity.written = similarity.written, lambda df, name, *by: cells.append(df) or original(df, name, *by)
        try:
            pairs = similarity.met_pairs(rows, "h", 0.99, block=4096)
        finally:
            similarity.written = original
        most = cells[0].groupBy("h", "_lo", "_hi").count().agg(F.max("count")).first()[0]
        assert most < 2.2 * 4096 and cells[0].select("_lo", "_hi").distinct().count() == 25 * 26 // 2
        assert pairs.columns == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_banding_and_verified_minhash(spark):
    bands, rows = similarity.banding(0.7)
    assert bands * rows <= 128 and (1 - 0.7**rows) ** bands < 1e-3
    assert similarity.banding(0.9)[1] > rows and similarity.banding(0.7, misses=0.5)[1] > rows
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    data = []
    for i in range(300):
        base = rng.choice(words, 80).tolist()
        data.append((2 * i, " ".join(base)))
        for at in rng.integers(0, 80, i % 6):
            base[at] = "x"
        data.append((2 * i + 1, " ".join(base)))
    df = spark.createDataFrame([*data, (900, None), (901, ""), (902, None)], "k int, t string")
    exact = {r["k"] for r in similarity.duplicated(df, "k", "t").where("is_dup").collect()}
    got = {r["k"] for r in similarity.minhash_duplicated(df, "k", "t").where("is_dup").collect()}
    assert got <= exact and len(got) >= 0.95 * len(exact) and len(exact) > 200


def test_sets_are_stored_once_and_ordered_without_a_shuffle(spark, monkeypatch):
    """What near-duplicates shuffle grows as the input: classes are stored, prefixes and bands are made from them in the row, and bitmaps go with rows that meet only."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(rng.choice(words, 30).tolist() + ["a"] * 30)) for i in range(60)]
    data += [(100 + i, data[i][1].replace("w7 ", "y ")) for i in range(60)]
    _, reps = similarity.classes(spark.createDataFrame(data, "k int, t string"), "k", "t", 2)
    assert hasattr(reps, "_written")
    reps = reps.select("rep", "s").cache()
    seen, original = [], similarity.met_pairs
    monkeypatch.setattr(similarity, "met_pairs", lambda rows, *a, **k: seen.append(rows) or original(rows, *a, **k))
    exact = {(r["a"], r["b"]) for r in similarity.class_links(reps, 0.5).collect()}
    banded = {(r["a"], r["b"]) for r in similarity.minhash_links(reps, 0.5).collect()}
    assert all("Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and "m" not in rows.columns for rows in seen) and len(seen) == 2
    sets = {r["rep"]: set(r["s"]) for r in reps.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert exact == want and len(want) > 20 and banded <= want


def test_whole_sets_are_not_stored_and_keys_meet_in_rounds(spark, monkeypatch):
    """What is on disk at once is bounded by rounds: no table holds whole sets, keys meet some at a time, and sets are compared for some pairs at a time."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(80):
        base = rng.choice(words, 60 if i % 8 else 900).tolist()
        data.append((4 * i, " ".join(base)))
        for k in range(1, 4):
            for at in rng.integers(0, len(base), 1 + 2 * (i % 4)):
                base[int(at)] = f"x{i % 5}"
            data.append((4 * i + k, " ".join(base)))
    data += [(1000, data[0][1]), (1000, data[0][1]), (1001, None), (1002, ""), (None, data[4][1])]
    sets = {k: {tuple(t.split()[i : i + 2]) for i in range(max(1, len(t.split()) - 1))} for k, t in data if k is not None and k < 1000}
    want = {k for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) for k in (a, b)} | {0, 4, 1000, 1001, 1002}
    tables, original = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name, *by: tables.append((name, df.columns)) or original(df, name, *by))
    for name, value in (("KEYS", 2000), ("ROUNDS", 3), ("PAIRS", 10), ("SPARE", 0), ("CHECKS", 3)):
        monkeypatch.setattr(similarity, name, value)
    df = spark.createDataFrame(data, "k int, t string")
    got = similarity.duplicated(df, "k", "t", 0.9, 2)
    assert {r["k"] for r in got.where("is_dup").collect()} - {None} == want and got.count() == len(data)
    assert 60 < len(want) < 300 and all("s" not in columns for _, columns in tables)
    assert [name for name, _ in tables].count("cells") == 3 and [name for name, _ in tables].count("ids") > 2


def test_long_bitmaps_never_say_more_than_the_sets():
    """Of any two sizes: bitmaps of different lengths are folded to one; of long sets they tell most of what differs."""
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(-(1 << 63), 1 << 63, k)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (40, 30, 20), (900, 700, 500), (5000, 90, 60), (3000, 2600, 1500)):
        common = draw(both)
        held = [np.sort(np.concatenate([common, draw(k - both)])) for k in (n, m)]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(held, pa.list_(pa.int64()))], ["k", "s"])
        out = next(similarity._signed(lambda h, k: (h, k))([batch]))
        apart = similarity._apart(*out.column("w").to_pylist())
        assert apart <= n + m - 2 * both and (min(n, m) < 600 or apart > 0.5 * (n + m - 2 * both))
