"""Leak-free splits and stratified samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.percentiles import at_fraction, elements_at


def side_of(repo: Column) -> Column:
    """valid or test, by the parity of the name's sha1."""
    return F.when(F.conv(F.right(F.sha1(repo), F.lit(1)), 16, 10).cast("int") % 2 == 0, "valid").otherwise("test")


def separate(rows: DataFrame, repo: str = "repo", split: str = "split") -> DataFrame:
    """Drop valid and test rows of train's repositories, and give repositories that both hold to one side.

    Which splits a repository occurs in is aggregated once (bits with partial
    aggregation) and looked up; Spark broadcasts the table if it is small.
    """
    bits = F.when(F.col(split) == "train", 1).when(F.col(split) == "valid", 2).otherwise(4)
    seen = rows.groupBy(F.col(repo).alias("_repo")).agg(F.bit_or(bits).alias("_seen"))
    joined = rows.join(seen, F.col(repo) == F.col("_repo"))
    train, contested = F.col("_seen").bitwiseAND(1) > 0, F.col("_seen") == 6
    keep = (F.col(split) == "train") | (~train & (~contested | (F.col(split) == side_of(F.col(repo)))))
    return joined.filter(keep).select(rows.columns)


def drop_counts(rows: DataFrame, repo: str = "repo", split: str = "split") -> DataFrame:
    """One row: what separate() drops for train's repositories, what valid and test lose to each other, and contested repositories."""
    bits = F.when(F.col(split) == "train", 1).when(F.col(split) == "valid", 2).otherwise(4)
    per = rows.groupBy(F.col(repo).alias("_repo")).agg(F.bit_or(bits).alias("_seen"), *[F.count_if(F.col(split) == s).alias(f"_{s}") for s in ("valid", "test")])
    train, contested = F.col("_seen").bitwiseAND(1) > 0, F.col("_seen") == 6
    side = side_of(F.col("_repo"))

    def total(holds: Column, rows_of: str) -> Column:
        return F.coalesce(F.sum(F.when(holds, F.col(rows_of))), F.lit(0)).cast("long")

    return per.agg(
        total(train, "_valid").alias("valid"),
        total(train, "_test").alias("test"),
        total(contested & (side == "test"), "_valid").alias("valid_lost_to_test"),
        total(contested & (side == "valid"), "_test").alias("test_lost_to_valid"),
        F.count_if(contested).alias("contested_repos"),
    )


def collision_counts(judged: DataFrame, split: str = "split", reason: str = "reject_reason", what: str = "duplicate") -> DataFrame:
    """Rows of each split that were dropped as duplicates; splits without any have 0."""
    return judged.groupBy(split).agg(F.count_if(F.coalesce(F.col(reason), F.lit("")) == what).alias("collisions"))


def shared_texts(rows: DataFrame, code: Column, comment: Column, split: str = "split") -> DataFrame:
    """Rows of valid and test whose code and comment, white space collapsed and the comment in small letters, also stand in train: a semi join."""
    key = F.sha1(F.concat(F.regexp_replace(code, r"(?U)\s+", " "), F.lit("||"), F.lower(F.regexp_replace(comment, r"(?U)\s+", " "))))
    keyed = rows.withColumn("_key", key)
    train = keyed.filter(F.col(split) == "train").select("_key").distinct()
    return keyed.filter(F.col(split) != "train").join(train, "_key", "left_semi").drop("_key")


def overlaps(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    found = rows.select(key, split).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1").select(F.col(key).alias("key"), "splits")


def assert_no_leak(rows: DataFrame, keys: list[str], split: str = "split") -> None:
    """Raise if a key occurs in more than one split."""
    leaks = {k: [r[0] for r in overlaps(rows, k, split).limit(20).collect()] for k in keys}
    if any(leaks.values()):
        raise ValueError(f"splits leak: { {k: v for k, v in leaks.items() if v} }")


def seeded(seed: int | str, key: Column) -> Column:
    """A shuffle order that doesn't depend on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def round_robin_sample(df: DataFrame, cells: list[str], score: Column, key: Column, target: int, seed: int | str) -> DataFrame:
    """Best of each cell, then second best, until `target`; ties and the order of cells are seeded.

    The window keeps at most `target` rows of a cell, which Spark trims before
    the shuffle, and the cut is a top-k, so a hot cell costs no full sort. A pool of
    no more than `target` rows comes back whole.
    """
    cell = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    ranked = df.withColumn("_cell", cell).withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(score.desc(), seeded(seed, key))))
    return ranked.filter(F.col("_rank") <= target).orderBy("_rank", seeded(seed, F.col("_cell"))).limit(target).drop("_cell", "_rank")


def profile(rows: DataFrame, split: str, repo: str, value: str) -> DataFrame:
    """Per split: rows, share, distinct repositories, mean, upper median, least and greatest value."""
    base = rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(repo).alias("n_repos"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )
    base = base.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    medians = elements_at(rows, [split], value, {"median": at_fraction(0.5)}).select(F.col(split).alias("_s"), "median")
    return base.join(medians, F.col(split) == F.col("_s"), "left").drop("_s")


def union_in_order(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by name, with `_table` for their order; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
