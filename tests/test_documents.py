"""Documents and commands, from raw hunks to the report, with models that are plain functions."""

import json
import math
import sys

import pytest

from millrace.operators import judge as J
from millrace.operators import probes as P
from millrace.operators import runs as R
from millrace.operators import selection as SL
from millrace.plans import cli, documents
from millrace.plans import report as REP
from millrace.sources import sinks
from millrace.sources import tables as S

MODEL = """
import json

def base():
    return lambda prompts: ["```py\\nx = 1\\n```"] * len(prompts)

def tuned():
    def answer(prompts):
        if len(prompts) > 1:
            raise MemoryError
        code = prompts[0].split("```python\\n")[-1].split("\\n```")[0] if "```python" in prompts[0] else "YES"
        return ["```py\\n" + code.replace("old_name", "new_name") + "\\n```"]
    return answer

def judge(prompt):
    a, b = prompt.split("<A>")[1].split("</A>")[0], prompt.split("<B>")[1].split("</B>")[0]
    score = lambda t: 5 if "new_name" in t else 1
    won = "A" if score(a) > score(b) else "B" if score(b) > score(a) else "tie"
    return json.dumps({"score_a": score(a), "score_b": score(b), "winner": won, "reason": ""})

def tokens(text):
    return len(text.split())

def tracker():
    class Remote:
        def log(self, metrics): pass
        def log_summary(self, values):
            import json, os
            open(os.environ["REMOTE_FILE"], "w").write(json.dumps(values))
        def log_artifact(self, path, name, kind): pass
        def finish(self): pass
    return Remote()

def scorer(question, option):
    return (-1.0 if option.strip() == "right" else -5.0, 2)

def trainer(run, folder, resume=None):
    import pathlib
    steps = pathlib.Path(folder) / "checkpoints" / f"checkpoint-{10 * run.train.epochs}"
    steps.mkdir(parents=True, exist_ok=True)
    (pathlib.Path(folder) / "calls.txt").open("a").write(f"{run.train.epochs} {resume}\\n")
    lines = [{"_step": s, "_ts": float(s), "loss": 1.0 / s} for s in range(1, 9)] + [{"_step": s, "_ts": float(s), "eval_loss": 2.0 / s} for s in (4, 8)]
    pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
    (pathlib.Path(folder) / "metrics.jsonl").write_text("\\n".join(map(json.dumps, lines)))
    if run.name == "bad":
        raise RuntimeError("no memory")
"""


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "toy_models.py").write_text(MODEL)
    sys.path.insert(0, str(d))

    def hunk(i, split):
        return {"old": f" def f{i}():\n-    return old_name_{i}", "new": f" def f{i}():\n+    return new_name_{i}", "comment": f"please rename this to `new_name_{i}` here", "lang": "py", "repo": f"{split}-{i % 5}"}

    for split in ("train", "valid", "test"):
        n = {"train": 40, "valid": 12, "test": 12}[split]
        rows = [hunk(i + (0 if split == "train" else 100 if split == "valid" else 200), split) for i in range(n)]
        rows += [rows[0], {**rows[1], "comment": "lgtm"}]
        (d / f"{split}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    own = {"id": "h1", "repo": "own", "lang": "py", "comment": "rename old_name", "old_code": "a = old_name", "new_code": "a = new_name", "category": "naming", "probe": "names", "n_old_lines": 1}
    (d / "own.jsonl").write_text(json.dumps(own) + "\n")
    probes = {"multiple_choice": [{"id": "q1", "question": "?", "choices": ["wrong", "right"], "answer": 1, "domain": "logic"}], "instruction_following": [{"id": "i1", "prompt": "say yes", "check": "contains", "arg": "yes"}, {"id": "i2", "prompt": "say", "check": "json_key", "arg": "k"}]}
    (d / "probes.json").write_text(json.dumps(probes))
    return d


def run(spark, place, *args):
    return cli.main([str(a) for a in args], spark)


def test_everything_in_order(spark, place):
    data, art = place / "data", place / "artifacts"
    raw = [x for s in ("train", "valid", "test") for x in (f"--{s}", place / f"{s}.jsonl")]
    assert run(spark, place, "all", *raw, "--size", 40, "--base", "toy_models:base", "--tuned", "toy_models:tuned", "--judge", "toy_models:judge", "--probes", place / "probes.json", "--scorer", "toy_models:scorer",
               "--resamples", 200, "--artifacts", art, "--data", data, "--handwritten", place / "own.jsonl") == 0
    card = json.loads((data / "dataset_card.json").read_text())
    assert card["funnel"]["train"] == {"kept": 40, "comment_non_actionable": 1, "duplicate": 1}
    assert card["leakage"]["collisions"] == {"train": 1, "valid": 1, "test": 1} and card["leakage"]["overlaps"] == {"repo": [], "hash": []}
    bench = json.loads((data / "benchmark_card.json").read_text())
    assert (bench["n_handwritten"], bench["n_curated"], bench["probes"]) == (1, 5, ["names"]) or bench["n_curated"] > 0
    assert bench["curated_mean_hardness"] is not None and bench["n_total"] == bench["n_handwritten"] + bench["n_curated"]
    summary = json.loads((art / "eval" / "tuned__benchmark.summary.json").read_text())
    assert summary["metrics"]["exact_match"] == 1.0 and summary["n"] == bench["n_total"] and summary["metrics"]["bleu"] == pytest.approx(100) and summary["metrics"]["by_lang"]["py"]["n"] == summary["n"]
    comparison = json.loads((art / "eval" / "comparison.json").read_text())
    assert comparison["headline"]["tuned_exact_match"] == 1.0 and comparison["headline"]["verdict"].startswith("Tuned is better")
    assert len(comparison["paired_metrics"]) == 8 and comparison["n_wins"] == bench["n_total"] and comparison["coverage"]["in_base_only"] == 0
    judged = json.loads((art / "eval" / "judge.json").read_text())
    assert judged["summary"]["tuned_wins"] == bench["n_total"] and judged["summary"]["failures"] == 0
    retained = json.loads((art / "forgetting" / "tuned.retention.json").read_text())
    assert retained["mcq_retention_pct"] == 100.0 and "verdict" in retained
    text = (art / "report.md").read_text()
    assert text.count("\n## ") == 10 and "_not run_" in text and "duplicate" in text


def test_commands_one_by_one(spark, place, capsys):
    data = place / "data"
    assert (data / "train.jsonl").exists()
    for name in ("good", "bad", "other"):
        (place / f"{name}.yaml").write_text(json.dumps({"name": name, "data_dir": str(data), "output_root": str(place / "artifacts" / "runs"), "train": {"epochs": 3, "batch_size": 4}}))
    assert run(spark, place, "sweep", "--trainer", "toy_models:trainer") == 0
    args = cli.parser().parse_args(["train", str(place / "good.yaml"), "--trainer", "toy_models:trainer", "--set", "train.epochs=9"])
    assert args.run(spark, args) == 0
    done = json.loads((place / "artifacts" / "runs" / "good" / "train_summary.json").read_text())
    assert (done["best_eval_loss"], done["best_checkpoint_step"], done["early_stopped"], done["steps_per_epoch"]) == (0.25, 8, True, 10)
    assert done["eval_perplexity"] == round(math.exp(0.25), 4)
    args = cli.parser().parse_args(["sweep", "--trainer", "toy_models:trainer"])
    args.configs = [str(place / f"{n}.yaml") for n in ("good", "bad", "other")]
    assert args.run(spark, args) == 1  # one arm failed, the others ran
    assert (place / "artifacts" / "runs" / "other" / "train_summary.json").exists()
    assert run(spark, place, "report", "--artifacts", place / "artifacts", "--data", data, "--out", place / "r.md") == 0
    assert "| good |" in (place / "r.md").read_text()
    (place / "adapter").mkdir()
    (place / "adapter" / "w.safetensors").write_bytes(b"12345")
    assert run(spark, place, "export", place / "adapter", "--base-model", "m", "--out", place / "rel") == 0
    manifest = json.loads((place / "rel" / "manifest.json").read_text())
    assert manifest["base_model"] == "m" and manifest["lora"]["r"] is None and manifest["created_utc"][:2] == "20" and "training_messages" in manifest["prompt_contract"]
    (place / "adapter" / "adapter_config.json").write_text('{"r": 16, "lora_alpha": 32, "target_modules": ["q", "v"], "base_model_name_or_path": "named"}')
    assert run(spark, place, "export", place / "adapter", "--out", place / "rel2") == 0
    other = json.loads((place / "rel2" / "manifest.json").read_text())
    assert (other["base_model"], other["lora"]["r"], other["lora"]["alpha"], other["lora"]["target_modules"]) == ("named", 16, 32, ["q", "v"]) and other["adapter_size_mb"] == 0.0
    assert "vllm serve named --enable-lora --max-lora-rank 16" in (place / "rel2" / "serve.sh").read_text()
    assert manifest["bytes"] == 5 and list(manifest["files"]) == ["w.safetensors"] and "FROM m" in (place / "rel" / "Modelfile").read_text()
    (place / "log.jsonl").write_text("\n".join(json.dumps({"model": "base", "ts": float(i), "latency": 0.5, "tokens": 10}) for i in range(9)))
    assert run(spark, place, "serve", "--log", place / "log.jsonl") == 0 and "20.0" in capsys.readouterr().out
    with pytest.raises(PermissionError):
        run(spark, place, "evaluate", "--split", "test", "--tag", "x", "--model", "toy_models:base", "--data", data)
    with pytest.raises(ValueError, match="no judge provider"):
        run(spark, place, "judge", place / "artifacts/eval/base__benchmark.predictions.jsonl", place / "artifacts/eval/tuned__benchmark.predictions.jsonl", "--provider", "nobody")
    assert run(spark, place, "query", "trained_share", "/root/testdata/sf0.001") == 0


def test_lengths_are_those_that_the_trainer_sees(spark, place, capsys, monkeypatch):
    from millrace.functions import text as T

    data = place / "data"
    examples = [json.loads(x) for f in sorted((data / "train.jsonl").glob("part*")) for x in f.read_text().splitlines()]
    (place / "long.yaml").write_text(json.dumps({"name": "long", "data_dir": str(data), "output_root": str(place / "artifacts" / "runs2"), "tracker": "mlflow", "train": {"epochs": 2, "max_seq_length": 20}}))
    monkeypatch.setenv("REMOTE_FILE", str(place / "remote.json"))
    args = cli.parser().parse_args(["train", str(place / "long.yaml"), "--trainer", "toy_models:trainer", "--tokenizer", "toy_models:tokens", "--remote", "mlflow=toy_models:tracker"])
    assert args.run(spark, args) == 0
    said = capsys.readouterr().err
    done = json.loads((place / "artifacts" / "runs2" / "long" / "train_summary.json").read_text())
    lengths = sorted(len(f"{T.SYSTEM} A reviewer left this note on Python code: > {e['comment']} Snippet: ```python {e['old_code']} ``` Rewrite the snippet so that it does what the note asks. ```python {e['new_code']} ```".split()) for e in examples)
    n = len(lengths)
    assert (done["lengths"]["n"], done["lengths"]["seq_len_p50"], done["lengths"]["seq_len_max"], done["lengths"]["seq_len_truncated_pct"]) == (n, lengths[n // 2], lengths[-1], 100.0)
    assert "warning: 100.0 %" in said and str(done["lengths"]["suggested_limit"]) in said
    assert json.loads((place / "remote.json").read_text())["run_name"] == "long"


def test_a_run_goes_on_from_its_last_checkpoint(spark, place, capsys):
    folder = place / "artifacts" / "runs3" / "go"
    (place / "go.yaml").write_text(json.dumps({"name": "go", "data_dir": str(place / "data"), "output_root": str(place / "artifacts" / "runs3"), "train": {"epochs": 1}}))

    def train(*more):
        args = cli.parser().parse_args(["train", str(place / "go.yaml"), "--trainer", "toy_models:trainer", "--resume", *more])
        return args.run(spark, args)

    assert train() == 0 and "starts anew" in capsys.readouterr().out
    assert train("--set", "train.epochs=12") == 0 and train("--set", "train.epochs=12") == 0
    calls = (folder / "calls.txt").read_text().splitlines()
    assert calls[0] == "1 None" and calls[1].endswith("go/checkpoints/checkpoint-10") and calls[2].endswith("checkpoint-120")
    with pytest.raises(ValueError, match="learning_rate"):
        train("--set", "train.epochs=13", "train.learning_rate=0.5")
    with pytest.raises(ValueError, match="later"):
        train("--set", "train.epochs=3")


def test_no_question_is_asked_twice(spark, tmp_path):
    from pyspark.sql import functions as F

    asked = tmp_path / "asked.txt"

    def caller(prompt):
        with asked.open("a") as f:
            f.write(prompt + "\n")
        return f"{prompt}!{asked.stat().st_size}"  # no two answers are the same

    def count():
        return len(asked.read_text().splitlines()) if asked.exists() else 0

    rows = spark.createDataFrame([(i, f"q{i % 30}" if i else None) for i in range(90)], "id long, q string")
    store = str(tmp_path / "store")
    first = {r.id: r.answer for r in J.ask_once(rows, F.col("q"), caller, store, "m", commit=8).collect()}
    assert count() == 30 and first[0] is None and first[1] == first[31] and first[1].startswith("q1!")
    assert {r.id: r.answer for r in J.ask_once(rows, F.col("q"), caller, store, "m").collect()} == first and count() == 30
    more = rows.union(spark.createDataFrame([(99, "new")], rows.schema))
    assert {r.id: r.answer for r in J.ask_once(more, F.col("q"), caller, store, "m").collect()}.items() >= first.items() and count() == 31
    assert J.ask_once(rows, F.col("q"), caller, store, "other").count() == 90 and count() == 61
    assert J.ask_once(rows.limit(0), F.col("q"), caller, store).count() == 0


def test_a_replayed_batch_is_in_the_log_once(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "step int, loss double"
    assert sinks.read_batches(spark, log, schema).count() == 0
    batch = lambda *steps: spark.createDataFrame([(s, 1.0 / s) for s in steps], schema)
    assert sinks.append_once(batch(1, 2), log, 0) and sinks.append_once(batch(3), log, 1)
    assert not sinks.append_once(batch(1, 2), log, 0) and not sinks.append_once(batch(9), log, 1)
    assert sinks.append_once(batch(7), log, 1, "other")
    batch(5).write.json(f"{log}/_batch-000000000002-left")  # a driver that died before the commit
    assert sorted(r.step for r in sinks.read_batches(spark, log, schema).collect()) == [1, 2, 3, 7]

    source, write = str(tmp_path / "in"), sinks.once_log(str(tmp_path / "stream"))
    failed = []

    def fails_after_writing(rows, number):
        write(rows, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("lost after the commit")

    batch(1, 2, 3).coalesce(1).write.json(source)
    for sink in (fails_after_writing, fails_after_writing, write):
        query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            assert failed
    assert failed == [0] and sorted(r.step for r in sinks.read_batches(spark, str(tmp_path / "stream"), schema).collect()) == [1, 2, 3]


def test_only_what_is_stale_runs(spark, place, capsys, tmp_path):
    import time

    raw = [x for s in ("train", "valid", "test") for x in (f"--{s}", place / f"{s}.jsonl")]
    (place / "step.yaml").write_text(json.dumps({"name": "step", "data_dir": str(tmp_path / "data"), "output_root": str(tmp_path / "art" / "runs"), "train": {"epochs": 1}}))
    args = ["all", *raw, "--size", 40, "--base", "toy_models:base", "--tuned", "toy_models:tuned", "--resamples", 50, "--artifacts", tmp_path / "art", "--data", tmp_path / "data", "--handwritten", place / "own.jsonl",
            "--trainer", "toy_models:trainer", "--config", place / "step.yaml"]

    def ran(*more):
        capsys.readouterr()
        assert run(spark, place, *args, *more) == 0
        said = capsys.readouterr().out.splitlines()
        return [x.split(":")[0] for x in said if x.endswith(": running")], [x.split(":")[0] for x in said if x.endswith(": up to date")]

    assert ran("--only", "benchmark") == (["data", "benchmark"], [])
    assert ran() == (["train", "eval-base", "eval-tuned", "compare", "report"], ["data", "benchmark"])
    assert ran()[0] == []
    assert ran("--resamples", 60)[0] == ["compare", "report"]
    (tmp_path / "art" / "eval" / "comparison.json").unlink()
    assert ran("--resamples", 60)[0] == ["compare"]
    assert ran("--resamples", 60, "--seed", 14)[0] == ["data", "benchmark", "train", "eval-base", "eval-tuned", "compare", "report"]
    time.sleep(1.1)
    (place / "own.jsonl").write_text((place / "own.jsonl").read_text() + "\n")
    assert ran("--resamples", 60, "--seed", 14)[0] == ["benchmark", "eval-base", "eval-tuned", "compare", "report"]


def test_targets_in_order():
    from millrace.plans.targets import Target, in_order

    def target(name, *after):
        return Target(name, lambda: 0, [], after=list(after))

    steps = [target("c", "a", "b"), target("b", "a"), target("a"), target("d")]
    assert [t.name for t in in_order(steps, ["c"])] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no target"):
        in_order(steps, ["x"])
    with pytest.raises(ValueError, match="circle"):
        in_order([target("a", "b"), target("b", "a")], ["a"])


def test_a_leak_is_an_exit_code(spark, place, monkeypatch):
    raw = [x for s in ("train", "valid", "test") for x in (f"--{s}", place / f"{s}.jsonl")]
    monkeypatch.setattr(cli.S, "separate", lambda rows: rows.replace({"valid-0": "train-0"}, subset="repo"))
    assert run(spark, place, "build-data", *raw, "--size", 40, "--out", place / "leaky") == 1


def test_runs_without_a_common_example(spark):
    one = documents.attach_scores(spark.createDataFrame([("a", "p", "g", "o", "py")], "id string, prediction string, gold string, old_code string, lang string"))
    with pytest.raises(ValueError, match="in common"):
        documents.compare_runs(one, one.replace("a", "b", "id"))
    with pytest.raises(FileNotFoundError):
        documents.benchmark(spark.createDataFrame([], documents.EXAMPLE), spark.createDataFrame([], documents.EXAMPLE))


def test_logs_and_trackers(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "metrics.jsonl").write_text('{"_step": 2, "_ts": 5.0, "loss": 0.5}\n{"_step": 1, "_ts": 4.0, "eval_loss": null}\n{"_step": 3, "eval_loss": 0.25}\n')
    log = S.read_log(spark, f"{tmp_path}/*/metrics.jsonl", ["loss", "eval_loss"])
    assert [tuple(r) for r in R.history(log, "run", "step").collect()] == [("r1", "eval_loss", 3, 0.25), ("r1", "loss", 2, 0.5)]
    assert R.sweep(log.selectExpr("run", "loss"), "run", "loss") is None
    stopped = R.early_stop(log, "run", ["step"], "eval_loss").collect()
    assert [r.step for r in stopped] == [3]

    class Broken:
        def __getattr__(self, name):
            raise RuntimeError(name)

    local = sinks.LocalTracker(spark, str(tmp_path / "t"), {"a": 1})
    both = sinks.Trackers(Broken(), local)
    both.log(spark.createDataFrame([(1, 0.5)], "step int, loss double"))
    both.log_summary({"x": 1})
    both.log_artifact("p", "n", "k")
    both.finish()
    assert json.loads((tmp_path / "t" / "summary.json").read_text()) == {"x": 1} and spark.read.json(f"{tmp_path}/t/metrics").count() == 1
    assert sinks.choose_tracker("auto", {"MLFLOW_TRACKING_URI": "u"}) == "mlflow" and sinks.choose_tracker("auto", {}) == "local" and sinks.choose_tracker("wandb", {}) == "wandb"
    assert len(sinks.trackers("mlflow", local, {"mlflow": Broken().__getattr__ if False else lambda: 1 / 0}, {}).trackers) == 1
    assert sinks.tags({"n": "x" * 900}) == {"n": "x" * 500}
    assert sinks.numbers_only(spark.createDataFrame([(1, "a", 0.5)], "i int, s string, d double")).columns == ["i", "d"]


def test_small_helpers(spark, tmp_path):
    df = spark.createDataFrame([("a", (1, ("x",)))], "k string, s struct<i: int, t: struct<u: string>>")
    assert SL.flattened(df).columns == ["k", "s.i", "s.t.u"]
    runs = spark.createDataFrame([("base", 2), ("b", 3), ("a", 1), ("base", 1)], "tag string, at int")
    assert {(r.tag, r.at) for r in SL.base_and_first_other(runs, "tag", "at").collect()} == {("base", 1), ("a", 1)}
    rows = spark.range(100).selectExpr("id", "id < 99 as found")
    SL.require_coverage(rows, rows.found, "id")
    with pytest.raises(ValueError):
        SL.require_coverage(rows, ~rows.found, "id")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"i": 1}')
    got = S.read_artifacts(spark, f"{tmp_path}/*/x.json", "i int").collect()
    assert [r.i for r in got] == [1] and got[0].path.endswith("a/x.json")
    assert S.read_json(spark, str(tmp_path / "a" / "x.json")) == {"i": 1} and S.read_json(spark, str(tmp_path / "none")) is None
    assert REP.number(None) == "–" and REP.share(0.123) == "12.3%" and REP.environment(spark).count() == 1
    assert J.PROVIDERS is not None and P.load_probes(spark.createDataFrame([], P.PROBES))[0].count() == 0
    assert REP.table(spark.range(52)).endswith("_2 more rows are not shown._") and REP.table(spark.range(50)).endswith("| 49 |")
    empty = documents.rows(spark.range(0))
    assert empty == []
    with pytest.raises(ValueError):
        documents.rows(spark.range(2000))


def test_pool_as_large_as_the_target_comes_back_whole(spark):
    from pyspark.sql import functions as F

    from millrace.operators import splits

    df = spark.range(10).selectExpr("id", "id % 3 as c")
    assert {r.id for r in splits.round_robin_sample(df, ["c"], F.col("id"), F.col("id"), 10, 1).collect()} == set(range(10))
