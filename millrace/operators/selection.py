"""Selection by a list of ids, flattening, pairing of tagged runs, and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def in_order_of(rows: DataFrame, key: str, ids: list, fallback: int = 10) -> DataFrame:
    """The rows with these ids, in the order of the list, missing ones skipped; if none is there, the first `fallback` by id."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame(list(enumerate(ids)), f"_pos int, _id {kind}")
    found = rows.join(F.broadcast(wanted), F.col(key) == F.col("_id")).drop("_id")  # as long as the given list
    if found.isEmpty():
        first = rows.orderBy(key).limit(fallback)
        return first.withColumn("_pos", (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))
    return found


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Leaves of nested structs as columns with dotted names."""

    def leaves(kind: StructType, path: list[str]) -> list[Column]:
        found = []
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                found += leaves(f.dataType, here)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return found

    return df.select(*leaves(df.schema, []))


def base_and_first_other(runs: DataFrame, tag: str, order: str) -> DataFrame:
    """The run tagged base, and the first run by `order` with another tag."""
    ranked = runs.withColumn("_n", F.row_number().over(Window.partitionBy(F.col(tag) == "base").orderBy(order)))
    return ranked.filter("_n = 1").drop("_n")


def miss_rate(rows: DataFrame, found: Column, order: str, first: int = 200) -> DataFrame:
    """Share of the first rows for which `found` is false; the count is a feature of this check."""
    return rows.orderBy(order).limit(first).agg(F.count(F.lit(1)).alias("n"), F.avg((~found).cast("double")).alias("miss_rate"))


def require_coverage(rows: DataFrame, found: Column, order: str, first: int = 200, most: float = 0.02) -> None:
    """Raise if more than `most` of the first rows miss."""
    rate = miss_rate(rows, found, order, first).first()["miss_rate"] or 0.0
    if rate > most:
        raise ValueError(f"{rate:.1%} of the first {first} rows lack the response template")


def trained_share(parameters: DataFrame, size: str, trained: str) -> DataFrame:
    """Sizes of trained and of all parameters, and their ratio."""
    t = F.coalesce(F.sum(F.when(F.col(trained), F.col(size))), F.lit(0))
    return parameters.agg(t.alias("trained"), F.sum(size).alias("total"), F.try_divide(t, F.sum(size)).alias("share"))


def pair_verdict(base_exact: Column, tuned_exact: Column, base_sim: Column, tuned_sim: Column, band: float = 0.0) -> Column:
    """One of five labels for a pair of answers: a flip of the exact match first, then the similarity beyond the band."""
    return (
        F.when(tuned_exact & base_exact, "both exact")
        .when(tuned_exact, "tuned exact")
        .when(base_exact, "base exact")
        .when(tuned_sim - base_sim > band, "tuned closer")
        .when(base_sim - tuned_sim > band, "base closer")
        .otherwise("tie")
    )
