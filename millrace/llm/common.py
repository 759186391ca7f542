"""Shared helpers: tables in the cluster's shared folder, word rules, worker caches."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir

#: White space that separates words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that a Python worker gets at once; the default would hold ten times as many in memory.
ROWS_IN_BATCH = "1000"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block, then what was set before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own in the shared folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    made = worker_cache().setdefault(("made", folder), [])
    if not made:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    made.append(f"{folder}/{name}-{uuid.uuid4().hex[:12]}")
    return made[-1]


@contextmanager
def only_last_stays(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, what was materialized in it, but for the last table."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    made = worker_cache().setdefault(("made", folder), [])
    first = len(made)
    yield
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in made[first:-1]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del made[first:-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage in a form that survives lost executors, and gives
    Catalyst the true size, so a small table is broadcast only when its measured
    size is below `spark.sql.autoBroadcastJoinThreshold`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_IN_BATCH}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words as an array: runs without space, \\t, \\n, \\v, \\f, \\r. Null and blank text give none.

    Every other separator is replaced by a space, each a plain byte search, so that
    the split is on one character; the empty strings between adjacent spaces go.
    """
    spaced = F.coalesce(text, F.lit(""))
    for other in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, whichever way functions were pickled."""
    name = "_millrace_worker_cache"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.store = {}
        sys.modules[name] = module
    return sys.modules[name].store


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need not have this library installed."""
    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(sys.modules[module_name])


#: Bits of the bitmap that maybe_in() broadcasts: 2**BITMAP_BITS / 64 rows of two longs, whatever the data.
BITMAP_BITS = 22


def flag_maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """Adds _maybe: false only where `key` is certainly not among `keys`.

    The keys are hashed into a bitmap of fixed size, held as rows (slot, 64
    bits), so the broadcast has a proven bound at any size of the data. It only
    saves shuffling rows that an exact join would drop: where many keys fill the
    bitmap more rows are flagged, never fewer.
    """
    place = F.pmod(F.xxhash64(keys_key), F.lit(1 << bits))
    bitmap = (
        keys.select(place.alias("_place"))
        .groupBy(F.expr("_place div 64").alias("_slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_place % 64 as int))")).alias("_bits"))
    )
    at = df.withColumn("_at", F.pmod(F.xxhash64(key), F.lit(1 << bits)))
    joined = at.join(F.broadcast(bitmap), F.expr("_at div 64") == F.col("_slot"), "left")
    found = F.coalesce(F.expr("shiftright(_bits, cast(_at % 64 as int)) & 1L") == 1, F.lit(False))
    return joined.withColumn("_maybe", found).drop("_at", "_slot", "_bits")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """The rows of `df` whose key may be among `keys`: all that are, and few others."""
    return flag_maybe_in(df, key, keys, keys_key, bits).filter("_maybe").drop("_maybe")


ship_by_value(__name__)
