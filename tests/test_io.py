"""Sources, sinks, configuration, streams, reports, and the entry module without the optional parts."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.operators import probes as P
from millrace.plans import config, report
from millrace.sources import sinks
from millrace.sources import tables as S
from millrace.streaming import queries as Q


def test_tolerant_lines_keep_order_and_skip_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1}\n\nbad\n{"i": 2}\n{"i": 3}\n')
    got = S.read_tolerant(spark, str(tmp_path / "a.jsonl"), "i int", limit=2).orderBy("_order").collect()
    assert [r.i for r in got] == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        S.read_strict(spark, str(tmp_path / "a.jsonl"), "i int").collect()
    assert S.read_strict(spark, str(tmp_path / "none"), "i int", missing_is_empty=True).count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_strict(spark, str(tmp_path / "none"), "i int")


def test_the_test_split_is_guarded(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"i": 1}\n')
    with pytest.raises(PermissionError):
        S.read_split(spark, {"test": str(tmp_path / "t.jsonl")}, "test", "i int")
    assert S.read_split(spark, {"test": str(tmp_path / "t.jsonl")}, "test", "i int", final=True).count() == 1


def test_checksums_and_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "x.txt").write_text("12345")
    big = os.urandom(3_000_000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "w.BIN").write_bytes(big)
    got = {r.file: r.sha256 for r in S.checksums(spark, str(tmp_path)).collect()}
    assert got == {"m.json": hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest(), "sub/w.BIN": hashlib.sha256(big).hexdigest()}
    (tmp_path / "sub" / "w.BIN").unlink()
    assert S.folder_size(spark, str(tmp_path)).first()[0] == 20
    assert S.read_document(spark, str(tmp_path / "m.json")).select("a.b").first()[0] == 1
    assert S.read_document(spark, str(tmp_path / "absent.json")) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "i int, s string")
    sinks.write_lines(df, str(tmp_path / "out"), ["i"])
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"i": 1, "s": "é"}, {"i": 2, "s": None}]
    assert json.loads(sinks.document(df.filter("i = 1"))) == {"i": 1, "s": "é"}
    seen = []

    def fails(batch, batch_id):
        raise ValueError

    sinks.fan_out(fails, lambda b, i: seen.append(b.count()))(df, 0)
    assert seen == [2]


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text(json.dumps({"name": "b", "train": {"epochs": 1, "batch_size": 8}}))
    (tmp_path / "child.yaml").write_text(json.dumps({"extends": "base.yaml", "train": {"epochs": 5}}))
    got = config.load(tmp_path / "child.yaml", ["train.learning_rate=1e-4", "name=other"])
    assert (got.train.epochs, got.train.batch_size, got.train.learning_rate, got.name) == (5, 8, 1e-4, "other")
    assert config.fingerprint(got) == config.fingerprint(config.load(tmp_path / "child.yaml", ["train.learning_rate=1e-4"]))
    assert config.fingerprint(got) != config.fingerprint(config.load(tmp_path / "child.yaml"))
    config.save(got, tmp_path / "saved" / "run.yaml")
    assert config.load(tmp_path / "saved" / "run.yaml") == got and (tmp_path / "saved" / "run.fingerprint").read_text().strip() == config.fingerprint(got)
    (tmp_path / "loop.yaml").write_text(json.dumps({"extends": "loop.yaml"}))
    for bad in ("loop.yaml",):
        with pytest.raises(ValueError):
            config.load(tmp_path / bad)
    with pytest.raises(ValueError):
        config.overrides(["novalue"])
    for settings in ({"train.nope": 1}, {"nope": 1}, {"train.epochs": "two"}, {"train.epochs": True}):
        with pytest.raises(ValueError):
            config.build(settings)
    (tmp_path / "orphan.yaml").write_text(json.dumps({"extends": "gone.yaml"}))
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "orphan.yaml")
    assert config.flattened({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}


def test_report(spark):
    text = report.report({"A": spark.createDataFrame([(1, None)], "n int, x double"), "B": None})
    assert "| 1 | – |" in text and report.NOT_RUN in text
    lit = F.lit
    said = spark.range(1).select(report.exact_match_sentence(lit(0.1), lit(0.02), lit(0.2), lit(0.01), lit(True)), report.exact_match_sentence(lit(0.1), lit(-0.02), lit(0.2), lit(0.3), lit(False))).first()
    assert said[0].startswith("Tuned is better: +10.0 points") and said[1].startswith("No difference shown")
    bands = [spark.range(1).select(P.retention_band(lit(w), lit(j))).first()[0] for w, j in ((98.0, 0.0), (92.0, 0.0), (50.0, 0.5))]
    assert bands[0].startswith("Kept") and bands[1].startswith("Slightly") and "50 points" in bands[2]


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = [(f"r{i % 2}", i, [1.0, 0.8, 0.79995, 0.9, 0.85, 0.7][i // 2 % 6]) for i in range(12)]
    df = spark.createDataFrame(rows, "run string, step int, loss double")
    df.filter("step < 6").coalesce(1).write.parquet(str(tmp_path / "s"))
    df.filter("step >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = Q.read_stream(spark, str(tmp_path / "s"), df.schema, maxFilesPerTrigger="1")
    got = Q.run_available(Q.stop_stream(stream, "run", "loss"), "update").groupBy("run").agg(F.max("stop").alias("s"), F.min("best").alias("b")).collect()
    assert all(r.s and r.b == 0.7 for r in got) and len(got) == 2
    assert Q.run_available(Q.first_of_each(stream.select("run"), "run"), "append").count() == 2


def test_entry_imports_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for item in ("millrace", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{item}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "millrace" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'funnel_reasons' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
