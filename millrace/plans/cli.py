"""Command line: data, benchmark, training, evaluation, comparison, judging, probes, release, serving figures and report.

Models are injected: an option of the form `module:function` names a factory.
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import os
import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curation as C
from millrace.operators import judge as J
from millrace.operators import probes as P
from millrace.operators import runs as R
from millrace.operators import splits as S
from millrace.plans import config, documents, registry
from millrace.plans.report import experiment_report
from millrace.plans.targets import Target, run_targets
from millrace.session import build_session
from millrace.sources import sinks
from millrace.sources.tables import paths_of, read_document, read_json, read_log, read_split, read_strict, read_tolerant, require

RAW = "old string, new string, comment string, lang string, repo string"


def named(where: str) -> Callable:
    """The function that `module:function` names; its module is pickled by value, so that executors need not have it."""
    name, colon, function = where.partition(":")
    if not colon:
        raise ValueError(f"a function is given as module:function, not {where!r}")
    module = importlib.import_module(name)
    register_pickle_by_value(module)
    return getattr(module, function)


def build_data(spark: SparkSession, args: argparse.Namespace) -> int:
    """train, valid and test files -> splits without leaks and their card; exit code 1 on a leak."""
    parts = []
    for i, (name, path) in enumerate((("train", args.train), ("valid", args.valid), ("test", args.test))):
        require(spark, path, f"raw {name} file")
        parts.append(read_tolerant(spark, path, RAW, args.limit).select("*", F.lit(name).alias("split"), F.lit(i).alias("_split_no")))
    raw = S.union_in_order(*parts).drop("_table").withColumn("repo", F.coalesce("repo", F.lit("unknown")))
    judged = C.with_reject_reason(raw)
    order = ["_split_no", "_order"]
    full = C.cascade_verdicts(judged, hash_keys=["hash"], repo_keys=["split", "repo"], comment_keys=["split", "comment_norm"], order=order, per_repo=args.per_repo, per_comment=args.per_comment)
    kept = full.filter("reject_reason is null")
    apart = S.separate(kept)
    columns = [F.substring("hash", 1, 16).alias("id"), "hash", "repo", "lang", "old_code", "new_code", F.col("_comment").alias("comment"), "category", "grounding", "n_old_lines", "n_changed_lines", F.col("split").alias("source_split")]
    for name, target in (("train", args.size), ("valid", args.size // 8), ("test", args.size // 8)):
        one = apart.filter(F.col("split") == name)
        sinks.write_lines(S.round_robin_sample(one, ["lang", "category"], F.col("grounding"), F.col("hash"), target, args.seed).select(*columns), f"{args.out}/{name}.jsonl", ["id"])
    splits = S.union_in_order(*[read_strict(spark, f"{args.out}/{n}.jsonl", documents.EXAMPLE + ", hash string").withColumn("split", F.lit(n)) for n in ("train", "valid", "test")])
    card = documents.dataset_card(full, S.drop_counts(kept), splits, {k: v for k, v in vars(args).items() if k != "run"})
    sinks.write_json(spark, f"{args.out}/dataset_card.json", card)
    try:
        S.assert_no_leak(splits, ["repo", "hash"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def build_benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    pool = read_strict(spark, args.pool, documents.EXAMPLE)
    own = read_strict(spark, args.handwritten, documents.EXAMPLE, missing_is_empty=True)
    documents.write_benchmark(spark, pool, own, args.out, args.n_curated, args.seed)
    return 0


#: Settings that a run which goes on may change: how far it goes.
TARGETS_OF_TRAINING = ("train.epochs",)


def last_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The folder checkpoint-N with the greatest N."""
    found = [(int(m[1]), p) for p in paths_of(spark, f"{folder}/checkpoints/checkpoint-*") if (m := re.search(r"checkpoint-(\d+)/?$", p))]
    return max(found)[1] if found else None


def checkpoint_to_resume(spark: SparkSession, run: config.RunConfig, folder: str) -> str | None:
    """Where a run goes on: its last checkpoint, if the settings that it began with are those of now but for how far it goes.

    None, with a word on it, if there is no checkpoint. Other settings, or a nearer end, are an error.
    """
    at = last_checkpoint(spark, folder)
    if at is None:
        print(f"no checkpoint below {folder}; the run starts anew")
        return None
    began = read_json(spark, f"{folder}/run_settings.json")
    if began is None:
        raise ValueError(f"{folder} has checkpoints but no run_settings.json to compare with")
    now = config.settings_of(run, beside=False)
    changed = sorted(k for k in set(began) | set(now) if began.get(k) != now.get(k) and k not in TARGETS_OF_TRAINING)
    if changed:
        raise ValueError(f"the run began with other settings ({', '.join(changed)}); it can't go on from {at}")
    if any(now[k] < began[k] for k in TARGETS_OF_TRAINING):
        raise ValueError("a run goes on to the same end or a later one")
    return at


def training_lengths(examples: DataFrame, tokenizer: Callable[[str], int] | None, limit: int) -> DataFrame:
    """length_report() of what the trainer sees: system and user turn and the answer, in tokens of an injected tokenizer, else of code."""
    lang = F.coalesce("lang", F.lit(""))
    turns = T.training_messages(T.SYSTEM, F.coalesce("old_code", F.lit("")), F.coalesce("comment", F.lit("")), F.coalesce("new_code", F.lit("")), lang)
    texts = examples.select(F.array_join(F.transform(turns, lambda m: m["content"]), "\n").alias("text"))
    if tokenizer is None:
        n = F.size(T.code_tokens(F.col("text"))).cast("long")
    else:

        @F.pandas_udf("long")
        def counted(batch: pd.Series) -> pd.Series:
            return batch.map(tokenizer)

        n = counted("text")
    return R.length_report(texts.withColumn("n", n), "n", limit)


def train(spark: SparkSession, args: argparse.Namespace) -> int:
    """Calls the injected trainer with the configuration; from the log it writes, history and summary are made.

    With --resume the trainer is also given `resume`, the run's last checkpoint.
    """
    run = config.load(args.config, args.set)
    folder = f"{run.output_root}/{run.name}"
    resume = checkpoint_to_resume(spark, run, folder) if getattr(args, "resume", False) else None
    sinks.write_json(spark, f"{folder}/run_settings.json", config.settings_of(run, beside=False))
    factories = {kind: named(where) for kind, _, where in (r.partition("=") for r in getattr(args, "remote", None) or [])}
    tracker = sinks.trackers(run.tracker, sinks.LocalTracker(spark, folder, config.settings_of(run)), factories, os.environ)
    examples = read_strict(spark, f"{run.data_dir}/train.jsonl", documents.EXAMPLE)
    tokenizer = named(args.tokenizer) if getattr(args, "tokenizer", "") else None
    lengths = documents.rows(training_lengths(examples, tokenizer, run.train.max_seq_length))
    if lengths and lengths[0]["warn"]:
        found = lengths[0]
        print(f"warning: {found['seq_len_truncated_pct']} % of the examples are longer than {run.train.max_seq_length} tokens and lose their end; {found['suggested_limit']} would keep 99 %", file=sys.stderr)
    trainer = named(args.trainer)
    trainer(run, folder, resume=resume) if resume else trainer(run, folder)
    log = read_log(spark, f"{folder}/metrics.jsonl", ["loss", "eval_loss"])
    sinks.write_lines(R.history(log, "run", "step"), f"{folder}/history.jsonl")
    summary = documents.train_summary(log, run.name, examples.count(), run.train.batch_size, run.train.epochs, run.train.eval_per_epoch)
    facts = {"lengths": lengths[0] if lengths else None, "fingerprint": config.fingerprint(run), "resumed_from": resume, "config": config.nested(config.settings_of(run))}
    sinks.write_json(spark, f"{folder}/train_summary.json", summary | facts)
    tracker.log_summary(summary)
    tracker.finish()
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    catalog = {n: f"{args.data}/{n}.jsonl" for n in ("train", "valid", "test", "benchmark")}
    examples = read_split(spark, catalog, args.split, documents.EXAMPLE + ", origin string", final=args.final)
    documents.evaluate(spark, examples, named(args.model), args.out, args.tag, args.split, args.batch_size)
    return 0


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    """Two prediction files example by example, as a JSON document; the verdict is printed."""
    base, tuned = (documents.read_predictions(spark, p) for p in (args.base, args.tuned))
    found = documents.compare_runs(base, tuned, args.resamples) | {"sources": {"base": args.base, "tuned": args.tuned}}
    sinks.write_json(spark, args.out, found)
    print(found["headline"]["verdict"])
    return 0


def judge(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.caller:
        J.PROVIDERS["given"] = lambda model: named(args.caller)
    caller = J.provider("given" if args.caller else args.provider, args.model)
    store = args.answers or f"{args.out}.answers"
    found = documents.judge_runs(*[documents.read_predictions(spark, p) for p in (args.base, args.tuned)], caller, args.limit, store, args.model or args.caller)
    sinks.write_json(spark, args.out, found)
    return 0


def forgetting(spark: SparkSession, args: argparse.Namespace) -> int:
    """Probes of one model as {tag}.forgetting.json; with a base document, what is left of it."""
    probes = read_document(spark, args.probes, P.PROBES)
    if probes is None:
        raise FileNotFoundError(f"no probes at {args.probes}")
    result = documents.forgetting_run(probes, named(args.scorer), named(args.model), args.tag)
    sinks.write_json(spark, f"{args.out}/{args.tag}.forgetting.json", result)
    base = read_json(spark, f"{args.out}/base.forgetting.json")
    if base and args.tag != "base":
        sinks.write_json(spark, f"{args.out}/{args.tag}.retention.json", documents.compare_forgetting(spark, base, result))
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    documents.release_manifest(spark, args.adapter, args.base_model, args.out)
    return 0


def serve(spark: SparkSession, args: argparse.Namespace) -> int:
    """The figures that a server shows, from its request log: the last 500 requests of each model."""
    log = read_tolerant(spark, args.log, "model string, ts double, latency double, tokens double").drop("_order")
    last = R.rolling(log.withColumn("_n", F.xxhash64("*")), "model", ["ts", "_n"], "latency", "tokens")
    last.groupBy("model").agg(F.max_by(F.struct(*R.STATS), F.struct("ts", "_n")).alias("w")).select("model", "w.*").orderBy("model").show(100, False)
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    at = args.artifacts
    trained = documents.load_documents(spark, paths_of(spark, f"{at}/runs/*/train_summary.json"))
    tag = getattr(args, "tag", "") or "*"
    retained = documents.load_documents(spark, paths_of(spark, f"{at}/forgetting/{tag}.retention.json"))
    if len(retained) > 1:
        raise ValueError("there are several retention documents; name the run with --tag")
    text = experiment_report(
        read_json(spark, f"{args.data}/dataset_card.json"), read_json(spark, f"{args.data}/benchmark_card.json"), read_json(spark, f"{at}/eval/comparison.json"),
        read_json(spark, f"{at}/eval/judge.json"), trained, retained[0] if retained else None,
    )
    sinks.write_text(spark, args.out, text)
    return 0


def sweep(spark: SparkSession, args: argparse.Namespace) -> int:
    """Trains every configuration; one that fails doesn't stop the others, but the exit code is then 1."""
    failed = []
    for path in args.configs:
        try:
            train(spark, argparse.Namespace(config=path, set=args.set, trainer=args.trainer))
        except Exception as e:
            print(f"{path}: {e}", file=sys.stderr)
            failed.append(path)
    done = documents.load_documents(spark, [p for c in args.configs if c not in failed for p in [f"{config.load(c, args.set).output_root}/{config.load(c, args.set).name}/train_summary.json"]])
    if done:
        runs = spark.createDataFrame([(d["run_name"], d["best_eval_loss"]) for d in done], "run string, loss double")
        R.leaderboard(runs, "run", "loss").orderBy("rank").show(100, False)
    return 1 if failed else 0


def evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    """Both models on the benchmark, comparison, judge (only if one is given), probes and report, in this order."""
    eval_dir = f"{args.artifacts}/eval"
    paths = {t: f"{eval_dir}/{t}__benchmark.predictions.jsonl" for t in ("base", "tuned")}
    for tag in ("base", "tuned"):
        evaluate(spark, argparse.Namespace(data=args.data, split="benchmark", final=False, model=getattr(args, tag), out=eval_dir, tag=tag, batch_size=8))
    compare(spark, argparse.Namespace(**paths, resamples=args.resamples, out=f"{eval_dir}/comparison.json"))
    if args.judge:
        judge(spark, argparse.Namespace(**paths, caller=args.judge, provider="", model="", limit=None, answers="", out=f"{eval_dir}/judge.json"))
    else:
        print("judge: skipped, none is given")
    if args.probes:
        for tag in ("base", "tuned"):
            forgetting(spark, argparse.Namespace(probes=args.probes, scorer=args.scorer, model=getattr(args, tag), tag=tag, out=f"{args.artifacts}/forgetting"))
    return report(spark, argparse.Namespace(artifacts=args.artifacts, data=args.data, tag="tuned", out=f"{args.artifacts}/report.md"))


def targets_of(spark: SparkSession, args: argparse.Namespace) -> list[Target]:
    """The steps from raw files to the report, with what each reads, writes and depends on."""
    space, data, art = argparse.Namespace, args.data, args.artifacts
    raw = {k: getattr(args, k) for k in ("limit", "size", "seed", "per_repo", "per_comment")}
    paths = {t: f"{art}/eval/{t}__benchmark.predictions.jsonl" for t in ("base", "tuned")}

    def given(where: str) -> list[str]:
        """The file of an injected function, so that a change of it is seen."""
        module = importlib.util.find_spec(where.partition(":")[0]) if where else None
        return [module.origin] if module and module.origin else []

    files = [args.train, args.valid, args.test]
    found = [
        Target("data", lambda: build_data(spark, space(train=args.train, valid=args.valid, test=args.test, out=data, **raw)), [f"{data}/{n}" for n in ("train.jsonl", "valid.jsonl", "test.jsonl", "dataset_card.json")], files, raw),
        Target("benchmark", lambda: build_benchmark(spark, space(pool=f"{data}/test.jsonl", handwritten=args.handwritten, out=data, n_curated=25, seed=7)), [f"{data}/benchmark.jsonl", f"{data}/benchmark_card.json"], [args.handwritten], {}, ["data"]),
    ]
    if args.trainer:
        run = config.load(args.config)
        step = space(config=args.config, set=[], trainer=args.trainer)
        found.append(Target("train", lambda step=step: train(spark, step), [f"{run.output_root}/{run.name}/train_summary.json"], given(args.trainer), {"run": config.settings_of(run), "trainer": args.trainer}, ["data"]))
    for tag in ("base", "tuned"):
        model = getattr(args, tag)
        step = space(data=data, split="benchmark", final=False, model=model, out=f"{art}/eval", tag=tag, batch_size=8)
        needs = ["benchmark", "train"] if tag == "tuned" and args.trainer else ["benchmark"]
        found.append(Target(f"eval-{tag}", lambda step=step: evaluate(spark, step), [paths[tag]], given(model), {"model": model}, needs))
        if args.probes:
            probe = space(probes=args.probes, scorer=args.scorer, model=model, tag=tag, out=f"{art}/forgetting")
            needs = [n for n in needs if n == "train"] + (["forgetting-base"] if tag == "tuned" else [])
            found.append(Target(f"forgetting-{tag}", lambda probe=probe: forgetting(spark, probe), [f"{art}/forgetting/{tag}.forgetting.json"], [args.probes, *given(model), *given(args.scorer)], {"model": model, "scorer": args.scorer}, needs))
    found.append(Target("compare", lambda: compare(spark, space(**paths, resamples=args.resamples, out=f"{art}/eval/comparison.json")), [f"{art}/eval/comparison.json"], [], {"resamples": args.resamples}, ["eval-base", "eval-tuned"]))
    if args.judge:
        step = space(**paths, caller=args.judge, provider="", model="", limit=None, answers="", out=f"{art}/eval/judge.json")
        found.append(Target("judge", lambda step=step: judge(spark, step), [f"{art}/eval/judge.json"], given(args.judge), {"judge": args.judge}, ["eval-base", "eval-tuned"]))
    last = space(artifacts=art, data=data, tag="tuned", out=f"{art}/report.md")
    found.append(Target("report", lambda: report(spark, last), [f"{art}/report.md"], [], {}, [t.name for t in found]))
    return found


def everything(spark: SparkSession, args: argparse.Namespace) -> int:
    """Data, training if a trainer is given, benchmark, evaluation and report: what is stale of the targets, or of those named by --only and all they need."""
    targets = targets_of(spark, args)
    return run_targets(spark, targets, args.only or [t.name for t in targets], f"{args.artifacts}/targets.json")


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    found: DataFrame = registry.queries()[args.name](spark, args.tables)
    found.show(args.rows, False)
    return 0


#: Options by command: name, and either a default or REQUIRED, or a type.
REQUIRED = object()
RAW_FILES = {"--train": REQUIRED, "--valid": REQUIRED, "--test": REQUIRED, "--limit": int, "--size": 2000, "--seed": 13, "--per-repo": 40, "--per-comment": 3}
MODELS = {"--base": REQUIRED, "--tuned": REQUIRED, "--judge": "", "--probes": "", "--scorer": "", "--resamples": 10_000, "--artifacts": "artifacts", "--data": "data"}
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], int], dict[str, object]]] = {
    "build-data": (build_data, RAW_FILES | {"--out": "data"}),
    "build-benchmark": (build_benchmark, {"--pool": "data/test.jsonl", "--handwritten": "handwritten.jsonl", "--out": "data", "--n-curated": 25, "--seed": 7}),
    "train": (train, {"config": REQUIRED, "--trainer": REQUIRED, "--set": list, "--resume": bool, "--tokenizer": "", "--remote": list}),
    "evaluate": (evaluate, {"--split": "benchmark", "--tag": REQUIRED, "--model": REQUIRED, "--data": "data", "--out": "artifacts/eval", "--batch-size": 8, "--final": bool}),
    "compare": (compare, {"base": REQUIRED, "tuned": REQUIRED, "--resamples": 10_000, "--out": "artifacts/eval/comparison.json"}),
    "judge": (judge, {"base": REQUIRED, "tuned": REQUIRED, "--provider": "", "--model": "", "--caller": "", "--limit": int, "--answers": "", "--out": "artifacts/eval/judge.json"}),
    "forgetting": (forgetting, {"--probes": REQUIRED, "--scorer": REQUIRED, "--model": REQUIRED, "--tag": REQUIRED, "--out": "artifacts/forgetting"}),
    "export": (export, {"adapter": REQUIRED, "--base-model": "", "--out": "artifacts/release"}),
    "serve": (serve, {"--log": REQUIRED}),
    "report": (report, {"--artifacts": "artifacts", "--data": "data", "--tag": "", "--out": "artifacts/report.md"}),
    "sweep": (sweep, {"configs": list, "--trainer": REQUIRED, "--set": list}),
    "evaluation": (evaluation, MODELS),
    "all": (everything, RAW_FILES | MODELS | {"--handwritten": "handwritten.jsonl", "--trainer": "", "--config": "", "--only": list}),
    "query": (query, {"name": REQUIRED, "tables": REQUIRED, "--rows": 20}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(required=True)
    for name, (run, options) in COMMANDS.items():
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option, value in options.items():
            if value is bool:
                p.add_argument(option, action="store_true")
            elif value is list:
                p.add_argument(option, nargs="*", default=[])
            elif not option.startswith("--"):
                p.add_argument(option)
            elif value is REQUIRED:
                p.add_argument(option, required=True)
            else:
                p.add_argument(option, type=value if isinstance(value, type) else type(value), default=None if isinstance(value, type) else value)
        p.set_defaults(run=run)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or build_session(), args)


if __name__ == "__main__":
    sys.exit(main())
