"""The steps one after another, over a folder."""

import json
from pathlib import Path

from plumbline.plans.cli import main


def shouted(prompt):
    return "A NEW TEXT"


class Service:
    def submit(self, input_path):
        return input_path

    def status(self, batch_id):
        return "expired" if batch_id == "lost" else "completed"


class Half:
    """A batch that expires with one answer of its first request."""

    def submit(self, input_path):
        Half.lines = [x for f in sorted(Path(input_path).glob("part-*")) for x in f.read_text().splitlines()]
        Half.folder = Path(input_path).parent
        return "half"

    def status(self, batch_id):
        return "expired"

    def output(self, batch_id):
        answer = {"custom_id": json.loads(Half.lines[0])["custom_id"], "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "Half."}}]}}}
        (Half.folder / "half.jsonl").write_text(json.dumps(answer))
        return str(Half.folder / "half.jsonl")


def test_steps(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("data: {n_profiles: 12}\n")
    d = str(tmp_path)
    c = ["--config", f"{d}/c.yaml", "--profiles", f"{d}/profiles.jsonl", "--vignettes-dir", f"{d}/vignettes", "--cache", f"{d}/cache.jsonl", "--responses", f"{d}/results/answers.jsonl", "--results", f"{d}/s3.jsonl"]
    out = ["--out", f"{d}/results"]
    assert main(["profiles", *c]) == 0 and main(["edges", *c, "--out", f"{d}/edge.jsonl"]) == 0
    assert main(["submit", *c, *out, "--n-pairs", "2"]) == 0
    assert main(["collect", *c, *out]) == 1
    lines = [json.loads(x) for f in (tmp_path / "results" / "batch_input.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == len({x["custom_id"] for x in lines}) == 28
    answers = [{"custom_id": x["custom_id"], "response": {"status_code": 200, "body": {"choices": [{"message": {"content": f"Told anew, {i}."}}]}}} for i, x in enumerate(lines)]
    (tmp_path / "results" / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    assert main(["collect", *c, *out]) == 0
    assert main(["render", *c, "--n-pairs", "2"]) == 0
    rows = [json.loads(x) for f in (tmp_path / "vignettes" / "pairs.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert len(rows) == 4 and all(r["text"].startswith("Told anew") and r["paraphrase_model"] == "gpt-4o-mini" for r in rows)
    assert main(["render", *c, "--n-pairs", "3", "--rewriter", "tests.test_cli:shouted"]) == 0
    rows = [json.loads(x) for f in (tmp_path / "vignettes" / "pairs.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert len(rows) == 6 and sum(r["text"] == "A NEW TEXT" for r in rows) == 2 and sum(r["text"].startswith("Told anew") for r in rows) == 4
    assert main(["render", *c, "--n-pairs", "2"]) == 0
    assert main(["collect", *c, *out, "--n-pairs", "2", "--then-render"]) == 0
    assert main(["submit", *c, *out, "--n-pairs", "5", "--service", "tests.test_cli:Half"]) == 0
    assert (tmp_path / "results" / "batch_id.txt").read_text() == "half"
    late = ["--responses", f"{d}/late.jsonl"]
    assert main(["wait", *c, *out, *late, "--service", "tests.test_cli:Half", "--interval", "0"]) == 0 and main(["collect", *c, *out, *late]) == 0
    assert main(["wait", "--service", "tests.test_cli:Service", "--interval", "0"]) == 0 and main(["wait", "--service", "tests.test_cli:Service", "--interval", "0", "--batch", "lost"]) == 1
    assert main(["qc", *c, *out, "--classifier", "plumbline.operators.plugins:stub_classifier"]) == 0
    assert json.loads((tmp_path / "results" / "qc_report.json").read_text())["round_trip"]["n"] > 0
    assert main(["qc", *c, *out]) == 0 and (tmp_path / "results" / "qc_report.json").exists()
    assert main(["advise", *c, "--scorer", "plumbline.operators.plugins:stub_scorer"]) == 0
    assert main(["advise", *c, "--scorer", "plumbline.operators.scoring:CharacterModel", "--device", "cpu"]) == 0 and main(["gate", *c, *out]) == 0
    assert json.loads((tmp_path / "results" / "s3_gate.json").read_text())["n_baseline"] == 28
