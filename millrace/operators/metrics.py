"""Aggregate metrics over scored predictions, and corpus BLEU."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.functions.text import code_tokens, normalize_code, pytrim

MEANS = {
    "exact_match": "exact_match",
    "improved_rate": "improved",
    "regressed_rate": "regressed",
    "copy_rate": "copied",
    "edit_similarity": "edit_sim",
    "token_f1": "token_f1",
    "edit_line_f1": "changed_right_lines",
    "delta_to_gold": "delta_to_gold",
}
#: Longest n-grams of BLEU.
ORDERS = 4
SLICE_MEANS = {k: MEANS[k] for k in ("exact_match", "improved_rate", "edit_line_f1")}


def mean(c: str) -> Column:
    """Mean of numbers or flags; 0 for no rows."""
    return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))


def format_compliance(mode: str) -> Column:
    """Share of fenced answers; null if no row has a mode."""
    return F.when(F.max(F.coalesce(F.col(mode), F.lit("")) != ""), F.avg(F.coalesce(F.col(mode).isin("fenced", "fenced_unterminated"), F.lit(False)).cast("double")))


def headline(scored: DataFrame, prediction: str = "prediction", mode: str = "parse_mode") -> DataFrame:
    """All headline rates in one aggregation; the syntax rate is over the rows that have a verdict."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        *[mean(c).alias(k) for k, c in MEANS.items()],
        F.coalesce(F.avg(1.0 - F.col("dist_old_gold")), F.lit(0.0)).alias("copy_baseline_edit_similarity"),
        format_compliance(mode).alias("format_compliance"),
        F.coalesce(F.avg((pytrim(F.coalesce(F.col(prediction), F.lit(""))) == "").cast("double")), F.lit(0.0)).alias("empty_rate"),
        F.avg(F.col("syntax_ok").cast("double")).alias("python_syntax_ok"),
        F.count("syntax_ok").alias("python_syntax_checked"),
    )


def metric_block(scored: DataFrame, key: str, prediction: str = "prediction", gold: str = "gold", old: str = "old_code", mode: str = "parse_mode") -> DataFrame:
    """headline() with BLEU of the predictions and of the unchanged code, rates to 4 places and BLEU to 3."""
    block = headline(scored, prediction, mode)
    rounded = [F.col(c) if c in ("n", "python_syntax_checked") else F.round(c, 4).alias(c) for c in block.columns]
    block = block.select(*rounded, F.lit(0).alias("_k"))
    texts = scored.select(key, *[normalize_code(F.col(c)).alias(k) for c, k in ((prediction, "_p"), (gold, "_g"), (old, "_o"))])
    for name, hypothesis in (("bleu", "_p"), ("copy_baseline_bleu", "_o")):
        score = corpus_bleu(texts, key, hypothesis, "_g").select(F.round("bleu", 3).alias(name), F.lit(0).alias("_k"))
        block = block.join(score, "_k")  # one row each
    return block.drop("_k")


def by_slices(scored: DataFrame, slices: list[str], means: dict[str, str], blank_is_unknown: bool = False) -> DataFrame:
    """slice, value, n and the means, for each of several columns in one pass over grouping sets."""

    def named(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.when(value != "", value) if blank_is_unknown else value, F.lit("unknown")).alias(c)

    rows = scored.select(*[named(c) for c in slices], *[F.col(c) for c in dict.fromkeys(means.values())])
    grouped = rows.groupingSets([[F.col(c)] for c in slices], *slices).agg(F.count(F.lit(1)).alias("n"), *[mean(c).alias(k) for k, c in means.items()], *[F.grouping(c).alias(f"_g_{c}") for c in slices])
    which = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in slices])
    return grouped.select(which.alias("slice"), F.coalesce(*slices).alias("value"), "n", *means)


@F.pandas_udf(ArrayType(LongType()))
def clipped(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Of two arrays of tokens, the n-grams in common for n from 1 to ORDERS, each as often as the rarer side has it."""

    def common(p: np.ndarray, g: np.ndarray) -> list[int]:
        known: dict[str, int] = {}
        a, b = ([known.setdefault(x, len(known)) for x in (() if t is None else t)] for t in (p, g))
        return [(Counter(zip(*(a[i:] for i in range(n)), strict=False)) & Counter(zip(*(b[i:] for i in range(n)), strict=False))).total() for n in range(1, ORDERS + 1)]

    return pd.Series([common(p, g) for p, g in zip(pred, gold, strict=True)])


def bleu_counts(pairs: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """n, hits, total and gold_total per n-gram length 1 to 4; the totals of length 1 are the corpus lengths.

    n-grams are counted and clipped inside the row, so that only three sums for
    each length leave a task.
    """
    tokens = pairs.select(code_tokens(F.col(pred)).alias("p"), code_tokens(F.col(gold)).alias("g"))
    counted = tokens.select(F.size("p").alias("p"), F.size("g").alias("g"), clipped("p", "g").alias("hits"))
    orders = [F.struct(F.lit(n).alias("n"), F.col("hits")[n - 1].alias("hits"), F.greatest(F.col("p") - (n - 1), F.lit(0)).alias("total"), F.greatest(F.col("g") - (n - 1), F.lit(0)).alias("gold_total")) for n in range(1, ORDERS + 1)]
    sums = counted.select(F.inline(F.array(*orders))).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("hits", "total", "gold_total")])
    return sums.filter("total + gold_total > 0")


def corpus_bleu(pairs: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """BLEU-4 over the whole corpus, 0 to 100, with exponential smoothing of orders without a hit (Post 2018, arXiv:1804.08771)."""
    rows = bleu_counts(pairs, key, pred, gold)
    one = rows.agg(F.array_sort(F.collect_list(F.struct("n", "hits", "total", "gold_total"))).alias("o"))  # at most four elements
    one = one.select("o", F.coalesce(F.get(F.filter("o", lambda x: x["n"] == 1), F.lit(0))["total"], F.lit(0)).alias("c"), F.coalesce(F.get(F.filter("o", lambda x: x["n"] == 1), F.lit(0))["gold_total"], F.lit(0)).alias("r"))
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("logs"))
    folded = F.aggregate(
        "o",
        start,
        lambda a, x: F.struct(
            F.when(x["hits"] == 0, a["smooth"] * 2).otherwise(a["smooth"]).alias("smooth"),
            (a["logs"] + F.log(F.when(x["hits"] == 0, 100.0 / (a["smooth"] * 2 * x["total"])).otherwise(100.0 * x["hits"] / x["total"]))).alias("logs"),
        ),
    )
    orders = F.filter("o", lambda x: x["total"] > 0)
    brevity = F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    hits = F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["hits"])
    score = F.when((F.size(orders) < 4) | (hits == 0), 0.0).otherwise(brevity * F.exp(folded["logs"] / 4))
    return one.select(score.alias("bleu"))
