"""Analytics over training runs: best step, early stopping, leaderboards, rolling windows."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.percentiles import at_fraction, elements_at, nearest_rank
from millrace.operators.ranges import ranked


def best_step(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """The least loss of each run and its first step, and how many evaluations came after it."""
    seen = log.filter(F.col(loss).isNotNull())
    best = seen.groupBy(run).agg(F.min(F.struct(F.col(loss), F.col(step))).alias("b"))
    best = best.select(run, F.col("b")[loss].alias("best_loss"), F.col("b")[step].alias("best_step"))
    later = seen.join(best.withColumnRenamed(run, "_run"), F.col(run) == F.col("_run")).groupBy(run).agg(F.count_if(F.col(step) > F.col("best_step")).alias("evals_after_best"))
    return best.join(later, run)


def early_stop(log: DataFrame, run: str, order: list[str], loss: str, patience: int = 3, threshold: float = 1e-4) -> DataFrame:
    """Adds best_before, bad_count (evaluations in a row without enough improvement) and stop. Rows without a loss are no evaluations."""
    log = log.filter(F.col(loss).isNotNull())
    by_run = Window.partitionBy(run).orderBy(*order)
    rows = log.withColumn("best_before", F.min(loss).over(by_run.rowsBetween(Window.unboundedPreceding, -1)))
    improved = F.col("best_before").isNull() | ((F.col(loss) < F.col("best_before")) & (F.col("best_before") - F.col(loss) > threshold))
    rows = rows.withColumn("_up", improved.cast("int")).withColumn("_island", F.sum("_up").over(by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_island = Window.partitionBy(run, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("bad_count", F.sum(1 - F.col("_up")).over(in_island))
    return rows.withColumn("stop", F.col("bad_count") >= patience).drop("_up", "_island")


def leaderboard(runs: DataFrame, run: str, loss: str) -> DataFrame:
    """Runs by loss, those without one last, ties by name."""
    return ranked(runs, loss, [run], "rank")


def sweep(runs: DataFrame, run: str, loss: str) -> DataFrame | None:
    """Runs with a loss, the worst first, as a chart of a sweep shows them; None for fewer than two runs."""
    seen = runs.filter(F.col(loss).isNotNull())
    return seen.orderBy(F.desc(loss), run) if seen.limit(2).count() == 2 else None


def history(log: DataFrame, run: str, step: str, keys: tuple[str, ...] = ("loss", "eval_loss")) -> DataFrame:
    """Long series (run, series, step, value) of the metrics that a row has, in order of steps."""
    items = F.array(*[F.struct(F.lit(k).alias("series"), F.col(k).cast("double").alias("value")) for k in keys])
    rows = log.select(run, step, F.inline(F.filter(items, lambda x: x["value"].isNotNull())))
    return rows.select(run, "series", step, "value").orderBy(run, "series", step)


def with_elapsed(log: DataFrame, run: str, ts: str) -> DataFrame:
    """Adds the seconds since the run's first row; the start of each run is aggregated and joined."""
    starts = log.groupBy(F.col(run).alias("_run")).agg(F.min(ts).alias("_start"))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1e6
    return log.join(starts, F.col(run).eqNullSafe(F.col("_run"))).withColumn("elapsed", seconds).drop("_run", "_start")


def early_stopped(steps_done: Column, per_epoch: Column, epochs: Column) -> Column:
    """Whether training ended more than a step before its last epoch did."""
    return steps_done < per_epoch * epochs - 1


BLOCK = 20_000


def rolling(rows: DataFrame, key: str, order: list[str], latency: str, tokens: str, size: int = 500, block: int = BLOCK) -> DataFrame:
    """Over the last `size` rows of each key: count, p50, p95, greatest latency, tokens and tokens per second.

    `order` begins with a number, date or time. Rows are ranked by ranges of it and
    dealt into blocks of a key, each with the last `size` - 1 rows before it, so a
    hot key is many tasks; within a block a sorted window is kept from row to row.
    Latencies and tokens are added up in millionths, as whole numbers.
    """
    columns = rows.columns
    seen = ranked(rows, order[0], order[1:], "_rank", keys=[key]).withColumn("_block", F.expr(f"(_rank - 1) div {block}"))
    last = F.expr(f"(_rank - 1) % {block} >= {block - size + 1}")
    seen = seen.withColumn("_for", F.explode(F.when(last, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    micros = lambda c: (F.col(c).cast("decimal(28,6)") * 1_000_000).cast("long")
    packed = seen.select(F.col(key).alias("_key"), "_for", "_block", "_rank", F.col(latency).cast("double").alias("_l"), micros(latency).alias("_ml"), micros(tokens).alias("_mt"), F.struct(*columns).alias("_row"))

    def windows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rank", kind="stable")
        values, held, out = group["_l"].tolist(), [], []
        ml, mt = (np.concatenate([[0], np.cumsum(group[c].fillna(0).astype("int64").to_numpy())]) for c in ("_ml", "_mt"))
        own = (group["_block"] == group["_for"]).tolist()
        for i, x in enumerate(values):
            if x is not None and x == x:
                bisect.insort(held, x)
            old = values[i - size] if i >= size else None
            if old is not None and old == old:
                del held[bisect.bisect_left(held, old)]
            if own[i]:
                n, first = len(held), max(0, i + 1 - size)
                at = lambda q: held[max(0, -(-int(q * n) // 100) - 1)] if n else None  # noqa: E731,B023
                t, s = (mt[i + 1] - mt[first]) / 1e6, (ml[i + 1] - ml[first]) / 1e6
                out.append((n, at(50), at(95), held[-1] if n else None, t, t / s if s else None))
        kept = group[own][["_key", "_rank"]].reset_index(drop=True)
        return pd.concat([kept, pd.DataFrame(out, columns=STATS)], axis=1)

    kind = rows.schema[key].dataType.simpleString()
    stats = packed.drop("_row").groupBy("_key", "_for").applyInPandas(windows, f"_key {kind}, _rank long, window_count long, p50 double, p95 double, max_latency double, tokens_sum double, tokens_per_second double")
    own = packed.filter("_block = _for").select(F.col("_key").alias("_k"), F.col("_rank").alias("_r"), "_row")
    return own.join(stats, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_r") == F.col("_rank"))).select("_row.*", *STATS)


STATS = ["window_count", "p50", "p95", "max_latency", "tokens_sum", "tokens_per_second"]


def length_report(rows: DataFrame, length: str, limit: int) -> DataFrame:
    """One row on lengths: mean to 1 place, median, p95, greatest, share above `limit`, and, if that is over 5 %, the limit that keeps 99 %."""
    places = elements_at(rows, [], length, {"seq_len_p50": at_fraction(0.5), "seq_len_p95": at_fraction(0.95), "_p99": at_fraction(0.99)})
    over = F.count_if(F.col(length) > limit) / F.count(length) * 100
    rest = rows.agg(F.round(F.avg(length), 1).alias("seq_len_mean"), F.max(length).alias("seq_len_max"), F.round(over, 2).alias("seq_len_truncated_pct"), (over > 5).alias("warn"))
    joined = places.withColumn("_k", F.lit(0)).join(rest.withColumn("_k", F.lit(0)), "_k")  # one row each
    return joined.select("n", "seq_len_mean", "seq_len_p50", "seq_len_p95", "seq_len_max", "seq_len_truncated_pct", "warn", F.when(F.col("warn"), F.col("_p99")).alias("suggested_limit"))


def batch_latency(rows: DataFrame, seconds: str, size: str, times: str) -> DataFrame:
    """p50 and p95 of the time of a row, where rows are batches: its time over its size counts once for each of `times` rows in it."""
    each = rows.select(F.explode(F.array_repeat((F.col(seconds) / F.col(size)), F.col(times).cast("int"))).alias("latency"))
    found = elements_at(each, [], "latency", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
    return found.select("n", F.round("p50", 3).alias("latency_p50_s"), F.round("p95", 3).alias("latency_p95_s"))


def perplexity(loss: Column) -> Column:
    return F.when(loss < 20, F.exp(loss))


def steps_per_epoch(n: Column, batch: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / batch))


def eval_steps(per_epoch: Column, times: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(per_epoch / F.greatest(F.lit(1), times)))
