"""Capability probes: option arg-max, rule checks, rates and retention."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import lines_of, pytrim, strip_fence


def best_option(logprobs: Column, tokens: Column) -> Column:
    """0-based index of the first greatest mean log-probability; an option without tokens can't win."""
    means = F.transform(F.arrays_zip(logprobs.alias("l"), tokens.alias("t")), lambda x: F.when(x["t"] > 0, x["l"] / x["t"]).otherwise(F.lit(float("-inf"))))
    return (F.array_position(means, F.array_max(means)) - 1).cast("int")


def accuracy(answers: DataFrame, keys: list[str] | None = None, chosen: str = "chosen", answer: str = "answer", n_choices: str = "n_choices") -> DataFrame:
    """n, accuracy and the accuracy of guessing."""
    return answers.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(chosen) == F.col(answer)).cast("double")).alias("accuracy"), F.avg(1.0 / F.col(n_choices)).alias("random_baseline")
    )


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


#: check kind -> (argument, stripped text) -> flag
CHECKS = {
    "one_word": lambda arg, text: _words(text) == 1,
    "contains": lambda arg, text: F.contains(F.lower(text), F.lower(arg)),
    "yes_no": lambda arg, text: pytrim(F.regexp_replace(F.upper(text), r"[.!]+\z", "")).isin("YES", "NO"),
    "n_lines": lambda arg, text: F.size(F.filter(lines_of(text), lambda line: pytrim(line) != "")) == arg.try_cast("int"),
    "max_words": lambda arg, text: _words(text).between(1, arg.try_cast("int")),
    "no_letter": lambda arg, text: ~F.contains(F.lower(text), F.lower(arg)),
    "json_key": lambda arg, text: F.array_contains(F.json_object_keys(strip_fence(text)), arg),
    "json_array": lambda arg, text: F.json_array_length(strip_fence(text)) == arg.try_cast("int"),
}


def passes(kind: Column, arg: Column, text: Column) -> Column:
    """Whether the answer passes the check of this kind; unknown kinds and bad JSON don't."""
    stripped = pytrim(text)
    found = None
    for name, check in CHECKS.items():
        hit = check(arg, stripped)
        found = F.when(kind == name, hit) if found is None else found.when(kind == name, hit)
    return F.coalesce(found, F.lit(False))


def instruction_rates(checked: DataFrame, passed: str = "passed", text: str = "text") -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return checked.agg(F.count(F.lit(1)).alias("n"), (F.count_if(passed) / n).alias("pass_rate"), (F.count_if(F.contains(F.col(text), F.lit("```"))) / n).alias("spurious_fence_rate"))


def load_probes(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, instructions): the two arrays of a probe document as tables."""
    return document.select(F.inline("multiple_choice")), document.select(F.inline("instruction_following"))


PROBES = "multiple_choice array<struct<id: string, question: string, choices: array<string>, answer: int, domain: string>>, instruction_following array<struct<id: string, prompt: string, check: string, arg: string>>"


def ask_options(questions: DataFrame, scorer: Callable[[str, str], tuple[float, int]]) -> DataFrame:
    """Adds `chosen` and `normalised_logprobs`: an injected model gives each option's summed log-probability and token count."""

    @F.pandas_udf("array<struct<l: double, t: int>>")
    def scores(question: pd.Series, choices: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("l", "t"), scorer(q, " " + c), strict=True)) for c in options] for q, options in zip(question, choices, strict=True)])

    rows = questions.withColumn("_s", scores("question", "choices"))
    chosen = best_option(F.transform("_s", lambda x: x["l"]), F.transform("_s", lambda x: x["t"]))
    return rows.select(*questions.columns, chosen.alias("chosen"), F.transform("_s", lambda x: F.round(x["l"] / F.greatest(x["t"], F.lit(1)), 4)).alias("normalised_logprobs"))


def retention_table(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row from two headlines (mcq_accuracy, instruction_pass_rate, spurious_code_fence_rate): what is left of each rate, and of the weaker one."""
    rates = ("mcq_accuracy", "instruction_pass_rate", "spurious_code_fence_rate")
    joined = base.select(F.lit(0).alias("_k"), *[F.col(c).alias(f"b_{c}") for c in rates]).join(tuned.select(F.lit(0).alias("_k"), *[F.col(c).alias(f"t_{c}") for c in rates]), "_k")  # one row each
    mcq, told = (retention(F.col(f"b_{c}"), F.col(f"t_{c}")) for c in rates[:2])
    return joined.select(
        F.col("b_mcq_accuracy").alias("mcq_accuracy_base"),
        F.col("t_mcq_accuracy").alias("mcq_accuracy_tuned"),
        F.round(mcq, 1).alias("mcq_retention_pct"),
        F.col("b_instruction_pass_rate").alias("instruction_pass_base"),
        F.col("t_instruction_pass_rate").alias("instruction_pass_tuned"),
        F.round(told, 1).alias("instruction_retention_pct"),
        F.col("b_spurious_code_fence_rate").alias("spurious_fence_base"),
        F.col("t_spurious_code_fence_rate").alias("spurious_fence_tuned"),
        F.round(F.least(mcq, told), 1).alias("overall_retention_pct"),
        retention_band(F.least(mcq, told), F.col("t_spurious_code_fence_rate") - F.col("b_spurious_code_fence_rate")).alias("verdict"),
    )


def retention_band(worst: Column, fence_jump: Column) -> Column:
    """A sentence on the weaker probe, in bands at 97 and 90 per cent, and on code fences that spread by more than 10 points."""
    band = F.when(worst >= 97, "Kept").when(worst >= 90, "Slightly weakened").otherwise("Clearly weakened")
    text = F.concat(band, F.format_string(": the weaker probe stands at %.0f %% of the base model.", worst))
    return F.concat(text, F.when(fence_jump > 0.1, F.format_string(" Code fences in plain answers rose by %.0f points.", fence_jump * 100)).otherwise(""))


def retention(base: Column, tuned: Column) -> Column:
    """Per cent of the base rate that is left; 100 where there was nothing to lose."""
    return F.when(F.coalesce(base, F.lit(0.0)) == 0, 100.0).otherwise(tuned / base * 100)
