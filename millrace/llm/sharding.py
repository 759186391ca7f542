"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows get a seeded-shuffle rank within their source; the rank plus an offset of the
source, divided by its size, is a fraction, and the rows sorted by fraction are cut
into equal runs: each run then holds every source in the proportion of the whole.
Offsets are even steps over the sources of one size in seeded order, so that sources
smaller than the number of runs are spread over all runs. No sort
ever holds a whole source or the whole table: a source's order is split by hash
prefix and the global order by ranges of the fraction, counts of those buckets
give the offsets, and rows are numbered inside a bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table

SHARDS = 16
#: Hex digits of the hash that make a source's buckets, and ranges of the fraction.
DIGITS, RANGES = 3, 4096


def source_offsets(sizes: DataFrame, seed: str, digits: int) -> DataFrame:
    """(_source, _of) -> the same with _shift between 0 and 1: even steps over the sources of one size, in the order of a seeded hash."""
    named = F.coalesce(F.concat(F.lit("source "), F.col("_source")), F.lit("null"))
    sources = sizes.withColumn("_sh", F.md5(F.concat(F.lit(seed + ":"), named))).withColumn("_sb", F.substring("_sh", 1, digits))
    cells = sources.groupBy(F.col("_of").alias("_o"), F.col("_sb").alias("_c")).agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy("_o").orderBy("_c")
    cells = cells.select("_o", "_c", (F.sum("_m").over(upto) - F.col("_m")).alias("_less"), F.sum("_m").over(Window.partitionBy("_o")).alias("_same"))
    joined = sources.join(cells, (F.col("_of") == F.col("_o")) & (F.col("_sb") == F.col("_c")))
    step = F.row_number().over(Window.partitionBy("_of", "_sb").orderBy("_sh", "_source"))
    return joined.select("_source", "_of", ((F.col("_less") + step - F.lit(0.5)) / F.col("_same")).alias("_shift"))


def shard_interleaved(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard", digits: int = DIGITS, ranges: int = RANGES) -> DataFrame:
    """One row per document with its shard and place; counts of shards are at most one apart.

    size is the text's UTF-8 bytes plus 1 (null text: none, so 1). A null source
    is a source of its own, null or repeated ids are ordered by content, and
    rows equal in all of these are interchangeable. Very long texts are hashed
    whole and travel as their hash. Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = materialize(rows.withColumn("_hash", F.md5(key)).withColumn("_bucket", F.substring("_hash", 1, digits)), "shard-rows")

    counts = materialize(rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "shard-counts")
    in_source = Window.partitionBy("_source").orderBy("_bucket")
    before = counts.select("_source", F.col("_bucket").alias("_b"), (F.sum("_n").over(in_source) - F.col("_n")).alias("_before"))
    shifts = source_offsets(counts.groupBy("_source").agg(F.sum("_n").alias("_of")), seed, digits).withColumnRenamed("_source", "_s")
    offsets = materialize(before.join(shifts, F.col("_source").eqNullSafe(F.col("_s"))).select("_s", "_b", "_before", "_of", "_shift"), "shard-offsets")
    joined = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    place = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "text_crc32", "size"))
    fraction = (F.col("_before") + place - 1 + F.col("_shift")) / F.col("_of")
    ranked = materialize(
        joined.select("doc_id", "size", "text_crc32", "_source", "_hash", fraction.alias("_at")).withColumn("_range", F.floor(F.col("_at") * F.lit(ranges)).cast("int")), "shard-ranked"
    )

    every = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most `ranges` rows
    starts = every.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    numbered = ranked.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_at", "_source", "_hash", "doc_id", "text_crc32", "size"))
    position = (F.col("_start") + inside - 1).cast("long")
    shard = F.expr(f"_p * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (
        numbered.withColumn("_p", position)
        .withColumn("shard", shard.cast("int"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_p") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_interleaved(read_table(spark, sf_dir, "documents"))


#: CRC-32 is worked out byte by byte from its polynomial, as this SQL has no function for it.
OP5_SQL = """
WITH k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT rid, doc_id, source, strlen(t) + 1 AS size, list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM t),
d AS (SELECT rid, doc_id, source, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, k),
h AS (SELECT *, md5('shard:' || coalesce(doc_id::VARCHAR, 'null') || ':' || crc || ':' || size) AS hash FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST, crc, size) AS place, count(*) OVER (PARTITION BY source) AS n FROM h),
o AS (SELECT source, n, md5('shard:' || coalesce('source ' || source, 'null')) AS sh FROM (SELECT DISTINCT source, n FROM r)),
e AS (SELECT source, (row_number() OVER (PARTITION BY n ORDER BY sh, source NULLS FIRST) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY n) AS shift FROM o),
f AS (SELECT r.*, (place - 1 + shift) / n AS fraction FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, hash, doc_id NULLS FIRST, crc, size) - 1 AS p, count(*) OVER () AS total FROM f),
s AS (SELECT *, (p * 16 // total)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard, (p - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
