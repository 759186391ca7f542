"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source's documents are ordered by a seeded hash of their content; a source
takes every document `floor(target / size)` times, and once more those whose
hash lies below a threshold. The threshold is found without a sort: tokens are
summed by source and hash prefix, the prefix where the running sum passes the
budget is the boundary bucket, and only the rows of that bucket are summed
again under a longer prefix. Thresholds of growing budgets are nested, as the
order of the hashes is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
DIGITS = (3, 6, 9)


def order_hash(id_col: str, text_col: str, seed: str) -> Column:
    """Hex digest that orders rows; the text takes part so that rows with a null or repeated id spread too."""
    return F.md5(
        F.concat(
            F.lit(seed + ":"),
            F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
            F.lit(":"),
            F.md5(F.coalesce(F.col(text_col), F.lit(""))),
        )
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, source_size) -> the same with target.

    Weights repeat over the sources by code point, null last. The budget is
    `share` of all sizes, split by weight; a source stops at `cap` times its
    size and the excess is reshared by weight until none is above. With the
    sources ordered by cap / weight the sources that stop are a prefix, so the
    resharing is one running sum over one row per source.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0.0)
    return (
        sizes.withColumn("_rank", rank)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), zero)) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), zero)))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"])
        .select("_source", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")).alias("target"))
    )


def thresholds(slim: DataFrame, plan: DataFrame, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """One row per source: copies every document gets, and the hash prefix up to which documents get one more."""
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-plan")
    edge = plan.select("_source", F.lit("").alias("_edge"), F.col("_rest").alias("_rest"))
    before = Window.partitionBy("_source").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.partitionBy("_source").orderBy("_prefix")
    for i, d in enumerate(digits):
        known = digits[i - 1] if i else 0
        rows = slim.alias("s").join(
            edge.filter("_rest > 0").alias("e"),
            F.col("s._source").eqNullSafe(F.col("e._source")) & (F.substring("s._hash", 1, known) == F.col("e._edge")),
        )
        sums = rows.groupBy(F.col("s._source").alias("_source"), F.substring("_hash", 1, d).alias("_prefix"), "_rest").agg(F.sum("size").alias("_size"))
        sums = sums.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        hit = sums.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_size") >= F.col("_rest")))
        edge = materialize(
            hit.withColumn("_n", F.row_number().over(in_order)).filter("_n = 1").select(
                "_source", F.col("_prefix").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("_size").alias("_last")
            ),
            f"mix-edge-{d}",
        )
    last = edge.select(F.col("_source").alias("_key"), "_edge", (F.col("_last") - F.col("_rest") <= F.col("_rest")).alias("_whole"))
    return materialize(
        plan.join(last, F.col("_source").eqNullSafe(F.col("_key")), "left").select("_source", "source_size", "target", "copies", "_edge", "_whole"), "mix-thresholds"
    )


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, thresholds): the slim table id, _source, size, _hash and one row per source."""
    slim = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), order_hash(id_col, text_col, seed).alias("_hash")),
        "mix-rows",
    )
    sizes = slim.groupBy("_source").agg(F.sum("size").cast("long").alias("source_size"))
    return slim, thresholds(slim, targets(sizes, weights, share, cap))


def times_taken(hashed: Column) -> Column:
    prefix = F.substring(hashed, 1, DIGITS[-1])
    more = F.coalesce((prefix < F.col("_edge")) | ((prefix == F.col("_edge")) & F.col("_whole")), F.lit(False))
    return F.col("copies") + more.cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with what the mix takes of it.

    Null text has size 0 and null sources are a source of their own (last in
    the order of weights). Repeated rows share one hash and are taken together;
    a document is never taken more than `cap` times. Very long texts count whole.
    Extra columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    slim, per_source = plan_mix(docs, **options)
    per_source = per_source.withColumnRenamed("_source", "_key")
    joined = slim.join(per_source, F.col("_source").eqNullSafe(F.col("_key")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken(F.col("_hash"))).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mixed documents themselves, each row as often as the mix takes it, with the columns of `docs`; edge cases as in mix_report()."""
    _, per_source = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    columns = docs.columns
    plan = per_source.select(F.col("_source").alias("_mix_key"), "copies", "_edge", "_whole")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(source_col).alias("_mix_source"), order_hash(id_col, text_col, seed).alias("_mix_hash"))
    joined = boxed.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_key")))
    taken = joined.select("_row", F.explode(F.array_repeat(F.lit(0), times_taken(F.col("_mix_hash")).cast("int"))))
    return taken.select("_row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 9) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rk % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
v AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM v WINDOW o AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rk LIMIT 1) * weight, cap)) AS target FROM v),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) - size AS before FROM g),
e AS (
  SELECT a.source, a.h, a.size - (target - copies * source_size - before) <= target - copies * source_size - before AS whole
  FROM a JOIN c ON a.source IS NOT DISTINCT FROM c.source
  WHERE before < target - copies * source_size AND before + size >= target - copies * source_size
  QUALIFY row_number() OVER (PARTITION BY a.source ORDER BY a.h) = 1)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * (c.copies + CASE WHEN e.h IS NOT NULL AND (d.h < e.h OR (d.h = e.h AND e.whole)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
