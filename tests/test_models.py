"""Readout by token ids, hosted rewriters, calls at once, and the cache that is written while rewriting goes on."""

import sys
import time
import types

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import readout as R
from plumbline.operators import requests, rewriting, scoring
from plumbline.plans import gate
from plumbline.sources import jsonl
from plumbline.sources.cache import Cache
from plumbline.sources.config import Config


def one(spark, prompt, continued):
    df = spark.createDataFrame([(prompt, continued)], "p array<int>, c array<array<int>>")
    return df.select(R.letter_ids(F.col("p"), F.col("c"))).first()[0]


def test_letter_ids(spark):
    assert one(spark, [5, 6], [[5, 6, 9], [5, 8], [7, 6, 9, 4]]) == [9, 8, 7]
    assert one(spark, [], [[3], [4, 1]]) == [3, 4]
    assert one(spark, [5, 6], []) == []
    for bad in ([[5, 6], [5, 6, 9]], [[5], [5, 6, 9]], [[5, 6, 9], [5, 6, 9, 1]]):  # no token of its own, shorter, the same twice
        with pytest.raises(PySparkException, match="letter"):
            one(spark, [5, 6], bad)


def test_letter_ids_as_a_model_tells_them():
    class Joining:  # "(" and a letter are one token
        def ids(self, text):
            out = []
            for c in text:
                if out and out[-1] == ord("("):
                    out[-1] = 1000 + ord(c)
                else:
                    out.append(ord(c))
            return out

    assert scoring.told_by(Joining().ids, "x (", 3) == [1065, 1066, 1067]
    assert scoring.told_by(lambda t: [ord(c) for c in t], "x (", 2) == [65, 66]
    with pytest.raises(ValueError, match="own"):
        scoring.told_by(lambda t: [1], "x", 2)
    with pytest.raises(ValueError, match="one token"):
        scoring.told_by(lambda t: [0] * len(t), "x", 2)


@pytest.mark.parametrize("ids", [[0, 1, 2, 3], [7, 1, 30, 12]])
def test_readout_anywhere_in_the_vocabulary(spark, ids):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(20, 40)) * 5
    logits[3, ids[2]] = 99.0
    df = spark.createDataFrame([(i, x.tolist(), ids) for i, x in enumerate(logits)], "i int, x array<double>, ids array<int>")
    got = {r["i"]: r["r"] for r in df.select("i", R.letter_readout(F.col("x"), F.col("ids")).alias("r")).collect()}
    probs, total, top = scoring.read(logits, ids)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    for i in range(20):
        for a, b in ((got[i]["letter_probs"], got[i]["p_letters"]), (probs[i].tolist(), total[i])):
            assert a == pytest.approx((p[i, ids] / p[i, ids].sum()).tolist()) and b == pytest.approx(p[i, ids].sum())
        assert got[i]["argmax_is_letter"] == (int(logits[i].argmax()) in ids) == top[i]
    assert top[3]
    with pytest.raises(PySparkException):
        df.select(R.letter_readout(F.col("x"), F.lit([1, 40])).alias("r")).collect()


def test_scores_of_a_loaded_model(spark):
    config = Config()
    rows = spark.createDataFrame([(f"v{i}", f"text {i}", i % 3 == 0) for i in range(9)], "vignette_id string, text string, contradictory boolean")
    units = gate.scoring_units(rows, config).repartition(3)
    model = scoring.Model("plumbline.operators.scoring:CharacterModel", (("vocabulary", 300),))
    letters = scoring.sample_letters(units, model, 4, "vignette_id")
    assert letters == [65, 66, 67, 68]
    own = scoring.letter_scores(units, model, 4, batch_size=2)
    got = scoring.letter_scores(units, model, 4, letters, batch_size=5)
    key = lambda df: sorted((r["vignette_id"], r["condition"], r["perm_idx"], tuple(np.round(r["letter_probs"], 12)), round(r["p_letters"], 12), r["argmax_is_letter"]) for r in df.collect())
    assert key(own) == key(got)
    m = model.get()
    assert m is model.get() and m.vocabulary == 300
    row = got.first()
    want = scoring.read(m.logits([m.chat(row["user_msg"]) + "("]), letters)
    assert row["letter_probs"] == pytest.approx(want[0][0].tolist())
    assert gate.results(got, config).count() == 12
    assert scoring.letter_scores(units.limit(0), model, 4, letters).count() == 0 and scoring.sample_letters(units.limit(0), model, 4, "vignette_id") == []
    with pytest.raises(ValueError):
        scoring.Model("nothing").get()


def test_hosted_rewriters(monkeypatch):
    with pytest.raises(ValueError, match="unknown backend"):
        rewriting.HostedRewriter("other", "m")
    for k in ("OPENAI_API_KEY", "GEMINI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(k, raising=False)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY"):
        rewriting.HostedRewriter("openai", "m")("x")
    with pytest.raises(RuntimeError, match="GEMINI_API_KEY"):
        rewriting.HostedRewriter("gemini", "m")("x")
    asked = []

    class OpenAI:
        def __init__(self, api_key):
            message = types.SimpleNamespace(message=types.SimpleNamespace(content=f" {api_key} "))
            create = lambda **k: asked.append(k) or types.SimpleNamespace(choices=[message])
            self.chat = types.SimpleNamespace(completions=types.SimpleNamespace(create=create))

    monkeypatch.setenv("OPENAI_API_KEY", "key")
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=OpenAI))
    r = rewriting.HostedRewriter("openai", "m", 0.1)
    assert r("x") == "key" and asked[0]["temperature"] == 0.1 and asked[0]["messages"][1] == {"role": "user", "content": "x"}
    assert r.__getstate__()["_client"] is None and r.client() is r.client()


def test_calls_at_once_keep_their_order(spark):
    at = time.monotonic()
    got = list(rewriting.in_order(lambda x: time.sleep(0.02 if x % 2 else 0.05) or x, iter(range(40)), 8))
    assert got == list(range(40)) and time.monotonic() - at < 0.9  # one after another: 1.4 s
    began = []
    taken = rewriting.in_order(lambda x: began.append(x) or x, iter(range(100)), 2)
    assert next(taken) == 0 and len(began) <= 4  # no more than is under way or waits
    with pytest.raises(ZeroDivisionError):
        list(rewriting.in_order(lambda x: 1 / x, iter([1, 0, 2]), 2))
    pace, at = rewriting.Pace(50), time.monotonic()
    for _ in range(6):
        pace.wait()
    assert 0.09 < time.monotonic() - at < 0.5
    df = spark.createDataFrame([(i, f"t{i}", "explicit") for i in range(48)], "i int, text string, mode string").coalesce(1)
    slow = lambda p: time.sleep(0.1) or p.upper()
    rewriting.rewritten(df.limit(1), Config(), slow).collect()
    at = time.monotonic()
    rows = rewriting.rewritten(df, Config(max_workers=16), slow).collect()
    assert [(r["i"], r["final_text"]) for r in rows] == [(i, f"T{i}") for i in range(48)] and time.monotonic() - at < 2.5  # one after another: 4.8 s


class Counted:
    """Writes a file for each call, so that calls of all workers can be counted."""

    def __init__(self, folder, broken=()):
        self.folder, self.broken = str(folder), tuple(broken)

    def __call__(self, prompt):
        import uuid
        from pathlib import Path

        name = prompt.split("\n")[0]
        (Path(self.folder) / f"{name}-{uuid.uuid4().hex}").touch()
        if name in self.broken:
            raise OSError(f"no answer for {name}")
        return "a risky answer" if name.endswith("7") else name.upper()

    def calls(self):
        from collections import Counter
        from pathlib import Path

        return Counter(p.name.rsplit("-", 1)[0] for p in Path(self.folder).iterdir())


def test_rewriting_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    data = [(i, f"t{i % 20}", "implicit" if i % 20 == 17 else "explicit") for i in range(30)] + [(90, None, "implicit"), (91, "t0", None)]
    jobs = spark.createDataFrame(data, "i int, text string, mode string").repartition(3)
    cache, config = Cache(spark, str(tmp_path / "cache")), Config(max_workers=3, max_retries=2)
    assert cache.read().count() == 0 and cache.commits() == [] and cache.compact() == 0
    first = Counted(tmp_path / "calls", broken=["t3", "t4"])
    with pytest.raises(RuntimeError, match="2 of 21 .*no answer for t3"):
        rewriting.rewrite_through(jobs, cache, config, first, commit_size=4, wait=0)
    calls = first.calls()
    assert calls["t3"] == calls["t4"] == 4 and calls["t17"] == 2 and calls["t0"] == 2 and sum(calls.values()) == 4 + 4 + 2 + 2 + 16
    assert cache.read().count() == 19 and len(cache.commits()) >= 4
    again = rewriting.rewrite_through(jobs, cache, config, Counted(tmp_path / "calls"), commit_size=4, wait=0)
    assert sum(first.calls().values()) - sum(calls.values()) == 2  # those that failed, and neither the leak nor any other
    want = {i: (None if x is None else x if m == "implicit" else "a risky answer" if x.endswith("7") else x.upper()) for i, x, m in data}
    got = {r["i"]: r for r in again.collect()}
    assert {i: r["final_text"] for i, r in got.items()} == want
    assert got[17]["model"] == "template-only" and got[0]["model"] == config.model and again.columns == ["i", "text", "mode", "final_text", "model"]
    n = cache.compact()
    assert n > 4 and len(cache.commits()) == 1 and cache.read().count() == 21
    calls = sum(first.calls().values())
    assert rewriting.rewrite_through(jobs, cache, config, Counted(tmp_path / "calls"), wait=0).count() == 32 and sum(first.calls().values()) == calls


def test_a_commit_that_breaks_off_leaves_no_entries(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    cache.append(spark.createDataFrame([("a", "x", "m"), ("a", "w", "m")], "cache_id string, text string, model string"))
    bad = spark.range(4).select(F.col("id").cast("string").alias("cache_id"), F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("t").alias("text"), F.lit("m").alias("model"))
    with pytest.raises(PySparkException):
        cache.append(bad)
    (tmp_path / "cache" / "commit-open" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "cache" / "commit-open" / "_temporary" / "0" / "part-0.json").write_text('{"cache_id": "b", "text": "t", "model": "m"}')
    assert [tuple(r) for r in cache.read().collect()] == [("a", "w", "m")] and len(cache.commits()) == 1
    (tmp_path / "cache" / "old.json").write_text('{"cache_id": "c", "text": "t", "model": "m"}')  # without a commit's folder
    assert cache.read().count() == 2


def test_buckets_are_written_in_one_job(spark, tmp_path):
    fields = [f.split()[0] for f in jsonl.VIGNETTE.split(", ")]
    row = lambda i, pair, kind: tuple({"vignette_id": i, "pair_id": pair, "vignette_type": kind, "text": "t"}.get(f) for f in fields)
    df = spark.createDataFrame([row("a", None, "explicit"), row("b", "p", "implicit"), row("c", None, "other"), row("d", None, None)], jsonl.VIGNETTE)
    jsonl.write_buckets(df, str(tmp_path / "v"))
    assert sorted((r["vignette_id"], r["source"]) for r in jsonl.read_union(spark, str(tmp_path / "v")).collect()) == [("a", "explicit"), ("b", "pairs")]
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if not p.name.endswith(".crc")) == ["explicit.jsonl", "implicit.jsonl", "pairs.jsonl"]
    broken = df.withColumn("text", F.when(F.col("vignette_id") == "b", F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(PySparkException):
        jsonl.write_buckets(broken, str(tmp_path / "v"))
    assert [r["text"] for r in jsonl.read_union(spark, str(tmp_path / "v")).collect()] == ["t", "t"]
    jsonl.write_buckets(df.limit(0), str(tmp_path / "v"))
    assert jsonl.read_union(spark, str(tmp_path / "v")).count() == 0


def test_ids_of_a_cache_are_those_of_jobs(spark):
    jobs = spark.createDataFrame([("x", "explicit")], "text string, mode string")
    assert requests.with_ids(jobs, Config()).first()["cache_id"]
