"""Paired comparison of two runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scores import mcnemar_p, outcome
from millrace.operators.metrics import by_slices
from millrace.operators.ranges import ranked
from millrace.session import written


def last_wins(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The last row of each key, and `first_line`, where the key first stood."""
    others = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*others), line).alias("_row"), F.min(line).alias("first_line"))
    return packed.select(key, "_row.*", "first_line")


def coverage(base: DataFrame, tuned: DataFrame, key: str) -> DataFrame:
    """Keys that only one run has, with the side, from one full join of distinct keys."""
    b, t = base.select(F.col(key).alias("b")).distinct(), tuned.select(F.col(key).alias("t")).distinct()
    joined = b.join(t, F.col("b") == F.col("t"), "full_outer")
    return joined.filter("b is null or t is null").select(F.coalesce("b", "t").alias(key), F.when(F.col("t").isNull(), "base").otherwise("tuned").alias("only_in"))


def unpivot_metrics(pairs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, a, b) from columns base_<metric>, tuned_<metric>."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(f"base_{m}").cast("double").alias("a"), F.col(f"tuned_{m}").cast("double").alias("b")) for m in metrics]
    return pairs.select(key, F.inline(F.array(*items)))


def mcnemar(pairs: DataFrame, base: str, tuned: str, keys: list[str] | None = None) -> DataFrame:
    """fixed, broken and the exact p, from conditional counts."""
    counts = pairs.groupBy(*(keys or [])).agg(
        F.count_if(F.col(tuned) & ~F.col(base)).alias("fixed"), F.count_if(F.col(base) & ~F.col(tuned)).alias("broken")
    )
    p = mcnemar_p(F.col("fixed"), F.col("broken"))
    return counts.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


#: Pairs of a block, resamples that one task splits and the draws it makes for them at most, decimal places in whose units
#: differences are added up, and the blocks that are broadcast (65,536 pairs; 4 MB for eight metrics).
BLOCK, RESAMPLES, DRAWS, UNIT, BROADCAST = 4096, 250, 1 << 26, 10, 16
#: Digests that are worked out at once: their columns stay in a core's cache.
AT_ONCE = 1 << 15
#: md5's shifts, the order of its words and its constants (RFC 1321).
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def tails(length: int, start: int, end: int) -> np.ndarray:
    """The 16 words of md5's block for each count from `start` to `end`, written out after a head of `length` zero bytes."""
    k = np.arange(start, end)
    block = np.zeros((len(k), 64), np.uint8)
    for digits in range(len(str(start)), len(str(max(end - 1, start))) + 1):
        at = np.flatnonzero((k >= (10 ** (digits - 1) if digits > 1 else 0)) & (k < 10**digits))
        for i in range(digits):
            block[at, length + i] = 48 + k[at] // 10 ** (digits - 1 - i) % 10
        block[at, length + digits] = 0x80
        block[at, 56], block[at, 57] = (length + digits) * 8 % 256, (length + digits) * 8 // 256
    return np.ascontiguousarray(block.view("<u4").T)


def numbers(heads: list[bytes], start: int, end: int, known: dict) -> np.ndarray:
    """Reproducible numbers below 2**32, a row for each head: the md5 of the head and each count from `start` to `end` gives four.

    Heads have one length. Digests of all heads and counts are worked out together,
    a column of words at a time; `known` keeps the counts written out.
    """
    length = len(heads[0])
    if length + len(str(end)) > 55:  # more than one block of md5
        return np.array([np.frombuffer(b"".join([hashlib.md5(h + b"%d" % k).digest() for k in range(start, end)]), ">u4") for h in heads]).astype(np.uint32)
    if (length, start, end) not in known:
        known.clear()
        known[length, start, end] = tails(length, start, end)
    tail = known[length, start, end]
    head = np.frombuffer(b"".join([h.ljust(64, b"\0") for h in heads]), "<u4").reshape(-1, 16)
    shape, m = (len(heads), end - start), []
    for w in range(16):
        column, row = head[:, w : w + 1], tail[w][None, :]
        m.append(None if not column.any() and not row.any() else column if not row.any() else row if not column.any() else column | row)
    a, b, c, d = (np.full(shape, x, np.uint32) for x in START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = m[WORDS[i]]
        if word is None:
            f += np.uint32(SINES[i])
        elif word.size < f.size:
            f += word + np.uint32(SINES[i])
        else:
            f += word
            f += np.uint32(SINES[i])
        np.right_shift(f, 32 - SHIFTS[i], out=g)
        f <<= SHIFTS[i]
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    four = np.empty((*shape, 4), np.uint32)
    for i, (x, begin) in enumerate(zip((a, b, c, d), START, strict=True)):
        np.add(x, np.uint32(begin), out=four[:, :, i])
    return four.byteswap(inplace=True).reshape(len(heads), -1)


def below(x: np.ndarray, n: int) -> np.ndarray:
    """x % n, by a division that NumPy does for many numbers at once."""
    return x if n >= 1 << 32 else x - x // np.uint32(n) * np.uint32(n)


def draws_of(names: list[str], counts: list[int], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, drawn): pieces of the counts[i] draws below `size` that names[i] stands for, in order for each name."""
    heads = [f"{name}:".encode() for name in names]
    for length in sorted({len(h) for h in heads}):
        same, known = [i for i, h in enumerate(heads) if len(h) == length], {}
        most = -(-max(counts[i] for i in same) // 4)
        for start in range(0, most, AT_ONCE):
            end = min(most, start + AT_ONCE)
            rows = max(1, AT_ONCE // (end - start))
            for j in range(0, len(same), rows):
                now = same[j : j + rows]
                drawn = below(numbers([heads[i] for i in now], start, end, known), size)
                for i, x in zip(now, drawn, strict=True):
                    yield i, x[: max(counts[i] - 4 * start, 0)]


def split_counts(seed: int, drawn: range, n: int, block: int) -> np.ndarray:
    """How many of the n draws of each resample in `drawn` fall into each block of pairs."""
    counts = np.zeros((len(drawn), -(-n // block)), np.int64)
    for i, x in draws_of([f"{seed}:{r}" for r in drawn], [n] * len(drawn), n):
        counts[i] += np.bincount(x // np.uint32(block), minlength=counts.shape[1])
    return counts.T


def step_of(n: int) -> int:
    """Resamples that one task splits: fewer of more pairs, so that it draws DRAWS times at most, or for one resample."""
    return max(1, min(RESAMPLES, DRAWS // max(n, 1)))


def block_counts(spark: SparkSession, seed: int, resamples: int, n: int, block: int) -> DataFrame:
    """(b, first, times): for each block of pairs, how often it is drawn by step_of() resamples from `first` on."""
    step = step_of(n)
    firsts = spark.range(0, resamples, step, -(-resamples // step)).select(F.col("id").alias("first"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["first"]:
                drawn = range(first, min(first + step, resamples))
                # With one block the draws themselves are taken inside it.
                times = split_counts(seed, drawn, n, block) if n > block else np.full((1, len(drawn)), n)
                yield pd.DataFrame({"b": np.arange(len(times)), "first": first, "times": list(times)})

    return firsts.mapInPandas(split, "b long, first long, times array<long>")


#: The resamples of a row of block_counts().
RESAMPLE = "sequence(first, first + size(times) - 1)"


def dealt(counts: DataFrame, blocks: DataFrame, step: int, n_blocks: int, copies: int) -> DataFrame:
    """Rows of block_counts() with their block's values, all resamples of a copy in one row and each copy of a block in a partition of its own.

    A block is few bytes and long work: by bytes, adaptive execution would put all
    into a few tasks, and by a hash some tasks would get several and some none.
    Beyond 10,000 copies partitions have equally many.
    """
    parts = min(n_blocks * copies, 10_000)
    unit = lambda b, copy: (b * copies + copy).cast("int").alias("unit")
    copy = F.pmod(F.floor(F.col("first") / F.lit(step)), F.lit(copies))
    counts = counts.select(unit(F.col("b"), copy), "b", F.expr(RESAMPLE).alias("r"), "times")
    counts = counts.repartitionById(parts, "unit").groupBy("unit").agg(F.first("b").alias("b"), F.collect_list(F.struct("r", "times")).alias("x"))  # `resamples` numbers at most
    counts = counts.select("unit", "b", F.flatten(F.col("x.r")).alias("r"), F.flatten(F.col("x.times")).alias("times"))
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(unit(F.col("_b"), F.col("copy")), "values")
    return counts.join(blocks.repartitionById(parts, "unit").hint("merge"), "unit")


def drawn_sums(seed: int, n: int, block: int, width: int):
    """Rows (b, r, times, values): the sums of the values that each of the resamples `r` draws inside the block."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, rs, times, values in zip(batch["b"], batch["r"], batch["times"], batch["values"], strict=True):
                table = np.asarray(values, np.int64).reshape(-1, width)
                # Doubles add whole numbers up exactly below 2**53, and faster.
                exact = float(np.abs(table).max()) * int(max(times)) < 2.0**52
                table = table.astype(np.float64) if exact else table
                sums = np.zeros((len(rs), width), np.int64)
                names = [f"{seed}:{r}:{b}" if n > block else f"{seed}:{r}" for r in rs]
                for i, x in draws_of(names, [int(m) for m in times], len(table)):
                    sums[i] += (np.bincount(x, minlength=len(table)) @ table).astype(np.int64)
                yield pd.DataFrame({"r": rs, **{f"d{i}": sums[:, i] for i in range(width)}})

    return draw


def bootstrap_table(pairs: DataFrame, key: str, metrics: list[str], *, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0, block: int = BLOCK, most: int = BROADCAST) -> DataFrame:
    """metric, n, base, tuned, delta, ci_low, ci_high and significant, from base_<metric> and tuned_<metric>; a null difference counts as 0.

    Draws are split like a tree. Pairs are numbered by ranges of the key and dealt
    into blocks; of a resample, first the number of draws that fall into each block
    is drawn, then, for a block by itself, which of its pairs they are. Both are
    seeded hashes, so a task can draw for any block and any resamples, and all
    metrics share the draws. Draws never leave their task. Up to `most` blocks are
    broadcast to tasks of RESAMPLES resamples; of more, what is shuffled is the pairs, in
    as many copies as keep all cores busy, and one row for each block and task, into
    about a partition a block, so the longest task draws for a few blocks at any
    number of pairs. No pairs give no rows.
    """
    spark = pairs.sparkSession
    diffs = [F.coalesce(F.col(f"tuned_{m}").cast("double") - F.col(f"base_{m}").cast("double"), F.lit(0.0)).cast("decimal(18,10)") for m in metrics]
    diffs = [(d * 10**UNIT).cast("long").alias(f"d{i}") for i, d in enumerate(diffs)]  # whole numbers: their sums don't depend on the order of rows
    rows = pairs.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"), *diffs, *[F.col(f"{side}_{m}").cast("double").alias(f"{side[0]}{i}") for i, m in enumerate(metrics) for side in ("base", "tuned")])
    rows = written(rows, "pairs")
    means = [c for i in range(len(metrics)) for c in (F.avg(f"b{i}").alias(f"b{i}"), F.avg(f"t{i}").alias(f"t{i}"), (F.sum(f"d{i}") / 10.0**UNIT).alias(f"d{i}"))]
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *means).first()
    n = whole["n"]
    schema = "metric string, n long, base double, tuned double, delta double, ci_low double, ci_high double, significant boolean"
    if not n:
        return spark.createDataFrame([], schema)
    numeric = rows.schema["_key"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    by = "_key" if numeric else "_hash"  # other keys are numbered by their hash
    at = F.col("_at") - 1
    indexed = ranked(rows, by, ["_key"], "_at").select(at.alias("i"), F.floor(at / F.lit(block)).alias("_b"), F.array(*[f"d{i}" for i in range(len(metrics))]).alias("v"))
    blocks = indexed.groupBy("_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])).alias("values"))  # `block` pairs at most
    counts = block_counts(spark, seed, resamples, n, block)
    if n <= most * block:
        drawn = counts.withColumn("r", F.expr(RESAMPLE)).join(F.broadcast(blocks), F.col("b") == F.col("_b"))
    else:
        n_blocks = -(-n // block)
        drawn = dealt(counts, blocks, step_of(n), n_blocks, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    drawn = drawn.select("b", "r", "times", "values")
    width = len(metrics)
    sums = drawn.mapInPandas(drawn_sums(seed, n, block, width), "r long, " + ", ".join(f"d{i} long" for i in range(width)))
    sums = sums.groupBy("r").agg(*[(F.sum(f"d{i}") / 10.0**UNIT / n).alias(f"m{i}") for i in range(width)])
    long = sums.select("r", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("m")) for i, m in enumerate(metrics)])))
    placed = long.withColumn("at", F.row_number().over(Window.partitionBy("metric").orderBy("m", "r")) - 1)  # `resamples` rows a metric
    low, high = int(alpha / 2 * resamples), min(resamples - 1, int((1 - alpha / 2) * resamples))
    ends = placed.groupBy("metric").agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("ci_low"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("ci_high"))
    known = spark.createDataFrame([(m, n, whole[f"b{i}"], whole[f"t{i}"], whole[f"d{i}"] / n) for i, m in enumerate(metrics)], "metric string, n long, base double, tuned double, delta double")
    return known.join(ends, "metric").select("metric", "n", "base", "tuned", "delta", "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


def bootstrap_ci(diffs: DataFrame, value: str, order: str, **options) -> DataFrame:
    """delta, ci_low, ci_high and significance of the mean of paired differences. No rows give zeros."""
    pairs = diffs.filter(F.col(value).isNotNull()).select(F.col(order).alias("_o"), F.lit(0.0).alias("base_x"), F.col(value).cast("double").alias("tuned_x"))
    if pairs.isEmpty():
        return diffs.sparkSession.range(1).select(F.lit(0.0).alias("delta"), F.lit(0.0).alias("ci_low"), F.lit(0.0).alias("ci_high"), F.lit(False).alias("significant"))
    return bootstrap_table(pairs, "_o", ["x"], **options).select("delta", "ci_low", "ci_high", "significant")


#: The metrics that runs are compared by, and whether each is a flag.
PAIRED = {"exact_match": True, "improved": True, "regressed": True, "copied": True, "edit_sim": False, "edit_line_f1": False, "token_f1": False, "delta_to_gold": False}


def paired_table(pairs: DataFrame, key: str, metrics: dict[str, bool] = PAIRED, **options) -> DataFrame:
    """bootstrap_table() with fixed, broken and the exact McNemar p for flags; null for the others."""
    flags = [m for m, flag in metrics.items() if flag]
    table = bootstrap_table(pairs, key, list(metrics), **options)
    items = F.array(*[F.struct(F.lit(m).alias("_m"), F.col(f"base_{m}").cast("boolean").alias("_a"), F.col(f"tuned_{m}").cast("boolean").alias("_b")) for m in flags])
    tests = mcnemar(pairs.select(F.inline(items)), "_a", "_b", ["_m"]).select("_m", "fixed", "broken", "p_value")
    return table.join(tests, F.col("metric") == F.col("_m"), "left").drop("_m")


def paired_predictions(base: DataFrame, tuned: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Predictions of two runs side by side: what describes the example from the base run, prediction and scores as base_ and tuned_.

    Both have `scores` as attach_scores() makes them. Of rows with one key the last
    by `order` counts. No key in common is an error.
    """
    if order:
        base, tuned = (last_wins(df, key, order).drop("first_line") for df in (base, tuned))
    about = [c for c in ("lang", "category", "origin", "probe", "comment", "old_code", "gold") if c in base.columns]

    def side(df: DataFrame, name: str, more: list[str]) -> DataFrame:
        return df.select(F.col(key).alias(f"_{name}"), *more, F.col("prediction").alias(f"{name}_prediction"), *[F.col(f"scores.{m}").alias(f"{name}_{m}") for m in PAIRED])

    pairs = side(base, "base", about).join(side(tuned, "tuned", []), F.col("_base") == F.col("_tuned")).drop("_tuned").withColumnRenamed("_base", key)
    if pairs.isEmpty():
        raise ValueError("the two runs have no example in common")
    return pairs


def outcome_rows(pairs: DataFrame, key: str = "id") -> DataFrame:
    """The fifteen columns that describe a pair, and its outcome."""
    rows = routed(pairs)
    about = [(F.coalesce(F.col(c), F.lit("")) if c in pairs.columns else F.lit("")).alias(c) for c in ("lang", "category", "origin", "probe", "comment", "old_code", "gold")]
    return rows.select(
        key, *about, "base_prediction", "tuned_prediction", F.col("base_exact_match").alias("base_exact"), F.col("tuned_exact_match").alias("tuned_exact"), "base_edit_sim", "tuned_edit_sim", F.round("delta_sim", 4).alias("delta_edit_sim"), "outcome"
    )


def comparison_slices(pairs: DataFrame, slices: list[str]) -> DataFrame:
    """slice, value, n and the means and differences of exact match and edit similarity to 4 places; differences are of unrounded means."""
    means = {f"{side}_{m}": f"{side}_{m}" for m in ("exact_match", "edit_sim") for side in ("base", "tuned")}
    rows = by_slices(pairs, slices, means, blank_is_unknown=True)
    out = [c for m in ("exact_match", "edit_sim") for c in (F.round(f"base_{m}", 4).alias(f"base_{m}"), F.round(f"tuned_{m}", 4).alias(f"tuned_{m}"), F.round(F.col(f"tuned_{m}") - F.col(f"base_{m}"), 4).alias(f"delta_{m}"))]
    return rows.select("slice", "value", "n", *out)


def by_gain(slices: DataFrame, slice_name: str = "category", descending: bool = True) -> DataFrame:
    """Values of one slice by the difference of exact match, greatest first, or least first as a chart has them."""
    rows = slices.filter(F.col("slice") == slice_name)
    return rows.orderBy(F.desc("delta_exact_match") if descending else "delta_exact_match", "value")


def routed(pairs: DataFrame, band: float = 0.02) -> DataFrame:
    """Adds delta_sim and outcome to pairs with base_ and tuned_ exact_match and edit_sim."""
    d = pairs.withColumn("delta_sim", F.col("tuned_edit_sim") - F.col("base_edit_sim"))
    return d.withColumn("outcome", outcome(F.col("base_exact_match"), F.col("tuned_exact_match"), F.col("delta_sim"), band))


def extremes(pairs: DataFrame, order: str, k: int = 25) -> DataFrame:
    """The k largest wins and the k largest losses, each by a top-k."""
    wins = pairs.filter("outcome = 'win'").orderBy(F.desc("delta_sim"), order).limit(k)
    losses = pairs.filter("outcome = 'loss'").orderBy("delta_sim", order).limit(k)
    return wins.unionByName(losses)
