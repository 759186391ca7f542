"""Cards, summaries and comparisons: tables are aggregated by Spark, and what is small becomes a document."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.scores import attach_scores, with_scores
from millrace.functions.taxonomy import hardness
from millrace.operators import compare as CP
from millrace.operators import judge as J
from millrace.operators import metrics as M
from millrace.operators import probes as P
from millrace.operators import runs as R
from millrace.operators import splits as S
from millrace.operators.curation import most_common
from millrace.operators.percentiles import elements_at, nearest_rank
from millrace.plans.report import environment, exact_match_sentence
from millrace.sources import sinks
from millrace.sources.tables import checksums, folder_size, read_json

# The fields of an example and of a prediction, as files have them.
EXAMPLE = "id string, repo string, lang string, old_code string, new_code string, comment string, category string, grounding double, n_old_lines int, n_changed_lines int, source_split string, probe string"
PREDICTION = "id string, lang string, category string, repo string, origin string, probe string, comment string, old_code string, gold string, prediction string, parse_mode string, raw_output string, latency_s double"


def rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """A small aggregate as dicts; more than `most` rows are an error, not a cut."""
    found = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a document")
    return found


def counts(df: DataFrame, column: str, order: str) -> dict:
    """Values with their counts, most common first."""
    return {r["value"]: r["n"] for r in rows(most_common(df, column, order).orderBy("rank"))}


def labels_of(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, in order, as one array; null is the empty text."""
    return df.agg(F.array_sort(F.collect_set(F.coalesce(F.col(column), F.lit("")))).alias("labels"))


# --- dataset -----------------------------------------------------------------


def dataset_card(judged: DataFrame, dropped: DataFrame, splits: DataFrame, settings: dict) -> dict:
    """What was read, rejected and kept, how splits were kept apart, and what they hold."""
    funnel = rows(judged.groupBy("split", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy("split", F.desc("n"), "reason"))
    profile = {r.pop("split"): r for r in rows(S.profile(splits, "split", "repo", "grounding").orderBy("split"))}
    return {
        "settings": settings,
        "funnel": {s: {r["reason"]: r["n"] for r in funnel if r["split"] == s} for s in dict.fromkeys(r["split"] for r in funnel)},
        "splits": {
            s: profile[s] | {"languages": counts(part, "lang", "id"), "categories": counts(part, "category", "id")} for s in profile for part in [splits.filter(F.col("split") == s)]
        },
        "leakage": {
            "collisions": {r["split"]: r["collisions"] for r in rows(S.collision_counts(judged).orderBy("split"))},
            "dropped": rows(dropped)[0],
            "overlaps": {k: [r["key"] for r in rows(S.overlaps(splits, k).orderBy("key").limit(20))] for k in ("repo", "hash")},
        },
    }


# --- benchmark ---------------------------------------------------------------


def with_hardness(pool: DataFrame) -> DataFrame:
    return pool.withColumn("hardness", hardness(F.col("grounding"), F.col("n_changed_lines"), F.col("category")))


def benchmark(pool: DataFrame, handwritten: DataFrame, n_curated: int = 25, seed: int = 7) -> DataFrame:
    """Handwritten examples first, then the hardest of each category in turn, with `origin` and `hardness`."""
    if pool.isEmpty():
        raise FileNotFoundError("the pool has no examples; run build-data first")
    own = handwritten.withColumns({"origin": F.lit("handwritten"), "hardness": F.lit(None).cast("double")})
    hard = with_hardness(pool)
    picked = S.round_robin_sample(hard, ["category"], F.col("hardness"), F.col("id"), n_curated, seed).withColumn("origin", F.lit("curated"))
    probe = F.coalesce("probe", F.lit("natural_distribution")) if "probe" in pool.columns else F.lit("natural_distribution")
    return S.union_in_order(own, picked.withColumn("probe", probe)).withColumnRenamed("_table", "part")


def benchmark_card(merged: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: sizes, mean hardness of the curated part (null if it is empty) and of the pool, and the handwritten probes."""
    own = F.col("origin") == "handwritten"
    card = merged.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(own).alias("n_handwritten"),
        F.count_if(~own).alias("n_curated"),
        F.round(F.avg("hardness"), 4).alias("curated_mean_hardness"),
        F.array_sort(F.collect_set(F.when(own, F.coalesce("probe", F.lit(""))))).alias("probes"),
        F.lit(0).alias("_k"),
    )
    return card.join(with_hardness(pool).agg(F.round(F.avg("hardness"), 4).alias("pool_mean_hardness"), F.lit(0).alias("_k")), "_k").drop("_k")


def write_benchmark(spark: SparkSession, pool: DataFrame, handwritten: DataFrame, out: str, n_curated: int = 25, seed: int = 7) -> dict:
    merged = benchmark(pool, handwritten, n_curated, seed)
    sinks.write_lines(merged, f"{out}/benchmark.jsonl", ["part", "id"])
    card = rows(benchmark_card(merged, pool))[0] | {"seed": seed, "languages": counts(merged, "lang", "id"), "categories": counts(merged, "category", "id"), "output": f"{out}/benchmark.jsonl"}
    sinks.write_json(spark, f"{out}/benchmark_card.json", card)
    return card


# --- predictions -------------------------------------------------------------


def prediction_rows(answered: DataFrame, split: str) -> DataFrame:
    """Answers to examples as a table of predictions; what an example lacks has a default."""

    def given(name: str, default: str) -> Column:
        return (F.coalesce(F.col(name), F.lit(default)) if name in answered.columns else F.lit(default)).alias(name)

    parsed = answered.withColumn("_r", T.parse_generation(F.col("raw_output")))
    return parsed.select(
        "id", "lang", "category", given("repo", ""), given("origin", split), given("probe", ""), "comment", "old_code", F.col("new_code").alias("gold"),
        F.col("_r.code").alias("prediction"), F.col("_r.how").alias("parse_mode"), "raw_output", *(["latency_s"] if "latency_s" in answered.columns else []),
    )


def slices_of(scored: DataFrame, names: list[str]) -> dict:
    found = rows(M.by_slices(scored, names, M.SLICE_MEANS).orderBy("slice", "value"))
    return {f"by_{s}": {r["value"]: {"n": r["n"], **{k: round(r[k], 4) for k in M.SLICE_MEANS}} for r in found if r["slice"] == s} for s in names}


def evaluate(spark: SparkSession, examples: DataFrame, load: Callable, out: str, tag: str, split: str, batch_size: int = 8) -> dict:
    """Answers of an injected model, scored and written as {tag}__{split}.predictions.jsonl and .summary.json."""
    asked = examples.withColumn("_prompt", T.user_prompt(F.col("old_code"), F.col("comment"), F.col("lang")))
    answered = J.generate(asked, "_prompt", load, batch_size).drop("_prompt")
    stem = f"{out}/{tag}__{split}"
    sinks.write_lines(attach_scores(prediction_rows(answered, split)), f"{stem}.predictions.jsonl", ["id"])  # asks once; what follows reads the file
    table = spark.read.schema(PREDICTION).json(f"{stem}.predictions.jsonl")
    scored = with_scores(table)
    latency = rows(elements_at(table, [], "latency_s", {"latency_p50_s": nearest_rank(0.5), "latency_p95_s": nearest_rank(0.95)}))
    n = table.count()
    summary = {
        "tag": tag, "split": split, "n": n,
        "metrics": (rows(M.metric_block(scored, "id"))[0] | slices_of(scored, ["category", "lang"])) if n else {"n": 0},
        "generation": {"batch_size": batch_size, **{k: round(v, 3) for k, v in (latency[0] if latency else {}).items() if k != "n"}},
        "environment": rows(environment(spark))[0],
        "predictions_path": f"{stem}.predictions.jsonl",
    }
    sinks.write_json(spark, f"{stem}.summary.json", summary)
    return summary


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A table of predictions with its scores; of repeated ids the last line counts."""
    from millrace.sources.tables import read_tolerant

    lines = read_tolerant(spark, path, PREDICTION)
    return attach_scores(CP.last_wins(lines, "id", "_order").drop("first_line"))


# --- comparison --------------------------------------------------------------


def headline(table: DataFrame) -> DataFrame:
    """One row on exact match from a paired table, with the rates beside it and a sentence that claims no more than the tests do."""
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    em = {c: of("exact_match", c) for c in ("n", "base", "tuned", "delta", "ci_low", "ci_high", "significant", "p_value", "fixed", "broken")}
    sides = [of(m, s).alias(f"{s}_{name}") for m, name in (("improved", "improved_rate"), ("copied", "copy_rate")) for s in ("base", "tuned")]
    one = table.agg(*[c.alias(k) for k, c in em.items()], *sides)
    sentence = exact_match_sentence(*[F.col(c) for c in ("delta", "ci_low", "ci_high", "p_value", "significant")])
    return one.select(
        "n", F.round("base", 4).alias("base_exact_match"), F.round("tuned", 4).alias("tuned_exact_match"), F.round("delta", 4).alias("exact_match_delta"),
        F.array(F.round("ci_low", 4), F.round("ci_high", 4)).alias("exact_match_ci95"), F.col("significant").alias("exact_match_significant"), F.round("p_value", 10).alias("mcnemar_p"),
        F.col("fixed").alias("examples_fixed"), F.col("broken").alias("examples_broken"), *[F.round(c, 4).alias(c) for c in one.columns if c.endswith("_rate")], sentence.alias("verdict"),
    )


def compare_runs(base: DataFrame, tuned: DataFrame, resamples: int = 10_000) -> dict:
    """Both runs example by example: headline, paired metrics, slices, greatest wins and losses, and what only one run has."""
    pairs = CP.paired_predictions(base, tuned).persist()
    try:
        table = CP.paired_table(pairs, "id", resamples=resamples).persist()
        outcomes = CP.outcome_rows(pairs)
        n = {r["outcome"]: r["n"] for r in rows(outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))}
        names = [c for c in ("category", "lang", "origin") if c in pairs.columns]
        slices = rows(CP.comparison_slices(pairs, names).orderBy("slice", "value"))
        only = CP.coverage(base, tuned, "id")
        best = CP.extremes(outcomes.withColumn("delta_sim", F.col("delta_edit_sim")), "id").drop("delta_sim")
        ends = rows(best)
        return {
            "headline": rows(headline(table))[0],
            "paired_metrics": {r.pop("metric"): r for r in rows(table.orderBy("metric"))},
            **{f"by_{s}": {r["value"]: {k: v for k, v in r.items() if k not in ("slice", "value")} for r in slices if r["slice"] == s} for s in names},
            "wins": [r for r in ends if r["outcome"] == "win"],
            "losses": [r for r in ends if r["outcome"] == "loss"],
            **{f"n_{name}": n.get(kind, 0) for kind, name in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))},
            "coverage": {"compared": pairs.count(), **{f"in_{s}_only": only.filter(F.col("only_in") == s).count() for s in ("base", "tuned")}},
        }
    finally:
        pairs.unpersist()


# --- judge, probes, training, release ----------------------------------------


def judge_runs(base: DataFrame, tuned: DataFrame, caller: Callable[[str], str], limit: int | None = None, store: str | None = None, model: str = "") -> dict:
    """Both orders of every pair before an injected judge; consensus by pair, and summaries by category.

    With a `store`, answers are kept there, and no question is asked that it knows.
    """
    pairs = J.judge_pairs(base, tuned, "id", "id", limit)
    if pairs.isEmpty():
        raise ValueError("the two runs have no example in common")
    first, second = (F.when(F.col("base_is_a") == flag, F.col("base_prediction")).otherwise(F.col("tuned_prediction")) for flag in (True, False))
    both = J.both_orders(pairs)
    prompt = J.judge_prompt(T.lang_name(F.col("lang")), F.col("old_code"), F.col("comment"), F.col("gold"), first, second)
    answered = J.ask_once(both, prompt, caller, store, model) if store else J.ask(both, prompt, caller)
    asked = answered.select("id", "category", "base_is_a", "answer").persist()
    try:
        results = J.consensus(J.votes(asked), "id", "category")
        summary = rows(J.summary(results))[0] | rows(J.failures(asked))[0]
        return {"summary": summary, "by_category": {r.pop("category"): r for r in rows(J.summary(results, ["category"]).orderBy("category"))}, "results": rows(results.orderBy("id"), 100_000)}
    finally:
        asked.unpersist()


def forgetting_run(probes: DataFrame, scorer: Callable, load: Callable, tag: str) -> dict:
    """The probes of one model: questions by log-likelihood, instructions by rule checks."""
    questions, instructions = P.load_probes(probes)
    answers = P.ask_options(questions, scorer).withColumn("n_choices", F.size("choices")).persist()
    said = J.generate(instructions, "prompt", load).withColumnRenamed("raw_output", "text")
    checked = said.withColumn("passed", P.passes(F.col("check"), F.col("arg"), F.col("text"))).persist()
    try:
        mcq, rates = rows(P.accuracy(answers))[0], rows(P.instruction_rates(checked))[0]
        return {
            "tag": tag,
            "multiple_choice": mcq | {"by_domain": {r.pop("domain"): r for r in rows(P.accuracy(answers, ["domain"]).orderBy("domain"))}},
            "instruction_following": rates,
            "headline": {"mcq_accuracy": mcq["accuracy"], "instruction_pass_rate": rates["pass_rate"], "spurious_code_fence_rate": rates["spurious_fence_rate"]},
        }
    finally:
        answers.unpersist()
        checked.unpersist()


def compare_forgetting(spark: SparkSession, base: dict, tuned: dict) -> dict:
    one = lambda d: spark.createDataFrame([tuple(float(d["headline"][k]) for k in ("mcq_accuracy", "instruction_pass_rate", "spurious_code_fence_rate"))], "mcq_accuracy double, instruction_pass_rate double, spurious_code_fence_rate double")
    return rows(P.retention_table(one(base), one(tuned)))[0]


def train_summary(log: DataFrame, name: str, n_examples: int, batch_size: int, epochs: int, evaluations: int) -> dict:
    """What a run's log says: best step, perplexity, steps planned and done, and whether it stopped early."""
    best = rows(R.best_step(log.withColumn("run", F.lit(name)), "run", "step", "eval_loss"))
    last = log.filter("eval_loss is not null").agg(F.max_by("eval_loss", "step").alias("loss"), F.max("step").alias("evaluated")).join(log.agg(F.max("step").alias("done")))
    per = R.steps_per_epoch(F.lit(n_examples), F.lit(batch_size))
    found = last.select(
        F.col("loss").alias("final_eval_loss"), F.round(R.perplexity(F.col("loss")), 4).alias("eval_perplexity"), per.cast("long").alias("steps_per_epoch"),
        R.eval_steps(per, F.lit(evaluations)).cast("long").alias("eval_every_n_steps"), F.col("done").alias("steps_done"), R.early_stopped(F.col("done"), per, F.lit(epochs)).alias("early_stopped"),
    )
    return {"run_name": name, "best_eval_loss": best[0]["best_loss"] if best else None, "best_checkpoint_step": best[0]["best_step"] if best else None, **rows(found)[0]}


CONTRACT = "Chat turns are those of millrace.functions.text: training_messages for the system and user turns, target_turn for the answer. The adapter was trained on them and answers worse to others."


def release_manifest(spark: SparkSession, adapter: str, base_model: str, out: str) -> dict:
    """Checksums and sizes of an adapter's files with its settings, as manifest.json, and files that say how to serve it.

    The base model is the one given, else the one that adapter_config.json names.
    """
    files = rows(checksums(spark, adapter).select("file", "length", "sha256"), 10_000)
    settings = read_json(spark, f"{adapter}/adapter_config.json") or {}
    base_model = base_model or settings.get("base_model_name_or_path", "")
    size = folder_size(spark, adapter).first()[0]
    manifest = {
        "created_utc": datetime.now(UTC).isoformat(timespec="seconds"),
        "base_model": base_model,
        "adapter": adapter,
        "adapter_size_mb": round(size / 1e6, 3),
        "lora": {name: settings.get(key) for name, key in (("r", "r"), ("alpha", "lora_alpha"), ("dropout", "lora_dropout"), ("target_modules", "target_modules"))},
        "task": "edit code as a review comment asks",
        "prompt_contract": CONTRACT,
        "bytes": sum(f["length"] for f in files),
        "files": {f["file"]: {"bytes": f["length"], "sha256": f["sha256"]} for f in files},
    }
    sinks.write_json(spark, f"{out}/manifest.json", manifest)
    sinks.write_text(spark, f"{out}/Modelfile", f"FROM {base_model}\nADAPTER ./adapter\nPARAMETER temperature 0\n")
    rank = f" --max-lora-rank {settings['r']}" if settings.get("r") else ""
    sinks.write_text(spark, f"{out}/serve.sh", f"#!/bin/sh\nvllm serve {base_model} --enable-lora{rank} --lora-modules tuned=./adapter\n")
    lines = [f"# Adapter for {base_model}", "", f"{len(files)} files, {manifest['adapter_size_mb']:.1f} MB. Check them against `manifest.json` (sha-256) before use.", "", CONTRACT, "", "| file | bytes |", "|---|---|", *[f"| {f['file']} | {f['length']} |" for f in files]]
    sinks.write_text(spark, f"{out}/README.md", "\n".join(lines) + "\n")
    return manifest


def load_documents(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Documents that can be read, in order of their paths."""
    return [d for d in (read_json(spark, p) for p in paths) if d is not None]
