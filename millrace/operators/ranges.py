"""Ranks and order statistics by ranges of values, so that no task sorts a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt into.
PARTS = 64


def range_of(df: DataFrame, value: str, parts: int = PARTS) -> Column:
    """The number of the range that a row's value lies in, 0 to `parts`; equal values share one, nulls have the last.

    The borders are approximate percentiles, so at most `parts` numbers reach the
    driver. They only balance the ranges: ranks are exact wherever borders lie.
    """
    kind = df.schema[value].dataType.simpleString()
    borders = df.agg(F.approx_percentile(value, [i / parts for i in range(1, parts)]).alias("b")).first()["b"]
    if not borders:
        return F.when(F.col(value).isNull(), parts).otherwise(0)
    of = F.array(*[F.lit(b).cast(kind) for b in sorted(set(borders))])
    return F.when(F.col(value).isNull(), parts).otherwise(F.size(F.filter(of, lambda b: b < F.col(value))))


def ranked(df: DataFrame, value: str, ties: list[str], out: str, *, keys: list[str] | None = None, descending: bool = False, parts: int = PARTS) -> DataFrame:
    """Adds the 1-based rank of each row, within `keys` if given, by a number, date or time, nulls last, then by `ties`.

    Rows are counted by range, running sums over at most `parts` + 1 counts of a key
    give the offsets, and rows are numbered within their range.
    """
    keys = keys or []
    placed = df.withColumn("_range", range_of(df, value, parts))
    if descending:
        placed = placed.withColumn("_range", F.when(F.col(value).isNull(), parts).otherwise(parts - 1 - F.col("_range")))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range")
    before = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, *ties))
    return placed.join(before, same).withColumn(out, (F.col("_before") + inside).cast("long")).select(*df.columns, out)


def elements_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """Per group, the elements of the sorted values at 0-based places; a place is a Column over `n`, the group's size.

    Values are counted first, so that a group of any number of rows is one row per
    distinct value; these are counted by range, and only the ranges that hold a
    wanted place are put in order. Nulls are left out; a group without values gives
    no row.
    """
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_range", range_of(counts, "_v", parts))
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("n", F.sum("_s").over(group)).withColumn("_before", F.sum("_s").over(group.orderBy("_range")) - F.col("_s"))
    wanted = F.lit(False)
    for at in ranks.values():
        wanted = wanted | ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_s")))
    sums = sums.filter(wanted).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), "n", "_before")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    upto = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(sums, same).withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    chosen = [F.max(F.when((F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at), F.col("_v"))).alias(name) for name, at in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *chosen)
