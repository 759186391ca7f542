"""Exact deduplication by a stateful stream.

Documents are landed once in the shared folder, each with a row number; this is
the content store, and a row number is a content locator. A stream reads the
landed digests. Its state, kept on disk by RocksDB and never expired, holds for
each digest the stable identifier (the largest id so far), the locator of that
row and the number of rows. Partial sums are made before the shuffle, so a
digest that a third of all rows share reaches its state as a few rows.

After each run of the stream every hit is checked on full bytes: the text behind the
state's locator is compared with the texts of all rows of the group. Rows whose bytes differ under
an equal digest are grouped anew by their text, so a collision costs time and
never a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import flag_maybe_in, materialize, maybe_in, new_path, read_table, settings

#: State on disk; no space set aside in advance for each of many small stores, one bound on the memory of all
#: stores of an executor, and stores of ended streams unloaded soon.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def land(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, str]:
    """Write the documents with _row, _id and _digest; the Parquet folder is what the stream reads."""
    spark = docs.sparkSession
    path = new_path(spark, "dedup-landed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    boxed = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        digest(text).alias("_digest"),
        text.alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest") if docs.columns != [text_col] else F.lit(0).alias("_rest"),
        F.col(text_col).isNull().alias("_null"),
    )
    boxed.write.parquet(path)
    return spark.read.schema(boxed.schema).parquet(path), path


def stream_state(spark: SparkSession, landed: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """Run the stream over what is landed and return its state: _digest, group_size, _keep_id, _keep_row.

    The stream's checkpoint lies in the shared folder, so a lost executor's state
    is rebuilt from there, and calling again with more files goes on from it.
    """
    checkpoint = f"{path}-state"
    with settings(spark, STATE):
        rows = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        state = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_row")).alias("keep"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    held = spark.read.format("statestore").load(checkpoint)
    key, (n, keep) = held.schema["key"].dataType.names[0], held.schema["value"].dataType.names
    return materialize(
        held.select(
            F.col("key")[key].alias("_digest"), F.col("value")[n].alias("group_size"), F.col("value")[keep]["_id"].alias("_keep_id"), F.col("value")[keep]["_row"].alias("_keep_row")
        ),
        "dedup-state",
    )


def collided(landed: DataFrame, state: DataFrame) -> DataFrame:
    """Digests under which some row's bytes differ from the bytes behind the state's locator.

    Each task sends at most one row for a digest, its least and greatest text: all
    its texts equal the stored one if these two do. So a digest that a third of all
    rows share meets its stored text as one row, and no key is hot.
    """
    hits = state.filter("group_size > 1").select(F.col("_digest").alias("_hit"), "_keep_row")
    texts = maybe_in(landed.select("_digest", "_text"), F.col("_digest"), hits, F.col("_hit"))
    ends = texts.groupBy("_digest").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
    kept = maybe_in(landed.select("_row", "_text"), F.col("_row"), hits, F.col("_keep_row"))
    stored = hits.join(kept, F.col("_keep_row") == F.col("_row")).select("_hit", F.col("_text").alias("_stored"))
    return ends.join(stored, F.col("_digest") == F.col("_hit")).filter("_low <> _stored or _high <> _stored").select("_digest")


def dedup_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(landed, verdicts): verdicts has _row, _id, _digest, group_size, _keep_id and kept for every row.

    A null text counts as empty. Of rows with one id and one text the last landed
    stays; a null id counts as the smallest. Very long texts are hashed and compared
    whole. Extra columns may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    landed, path = land(docs, id_col, text_col, digest)
    state = stream_state(spark, landed, path, files_per_trigger) if not landed.isEmpty() else landed.selectExpr("_digest", "1L as group_size", "_id as _keep_id", "_row as _keep_row")
    wrong = materialize(collided(landed, state), "dedup-collided")
    slim = landed.select("_row", "_id", "_digest")
    found = slim.join(state.withColumnRenamed("_digest", "_key"), F.col("_digest") == F.col("_key")).drop("_key")
    if not wrong.isEmpty():
        texts = landed.select("_row", "_id", "_digest", "_text").join(wrong, "_digest", "left_semi")
        groups = texts.groupBy("_digest", "_text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_id", "_row")).alias("_k"))
        again = texts.join(groups, ["_digest", "_text"]).select("_row", "_id", "_digest", "group_size", F.col("_k._id").alias("_keep_id"), F.col("_k._row").alias("_keep_row"))
        found = found.join(wrong, "_digest", "left_anti").unionByName(again)
    return landed, found.withColumn("kept", F.col("_row") == F.col("_keep_row"))


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document, dropped ones too: the row that stays, the size of its group, and the digest."""
    _, verdicts = dedup_rows(docs, **options)
    return verdicts.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), "group_size", "kept", F.col("_digest").alias("text_sha256"))


def dedup_documents(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with the columns of `docs`; edge cases as in dedup_rows(). Only rows that may be dropped are shuffled."""
    landed, verdicts = dedup_rows(docs, text_col=text_col, **options)
    dropped = materialize(verdicts.filter("not kept").select("_row"), "dedup-dropped")
    flagged = flag_maybe_in(landed, F.col("_row"), dropped, F.col("_row"))
    stay = flagged.filter("not _maybe").unionByName(flagged.filter("_maybe").join(dropped, "_row", "left_anti").select(flagged.columns))
    text = F.when(~F.col("_null"), F.col("_text")).alias(text_col)
    return stay.select(*[text if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read_table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
