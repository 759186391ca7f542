"""Scans: line-numbered tolerant and strict JSON lines, split catalogs, artifacts, configuration files, checksums."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches, asked of the file system that Spark reads from."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def require(spark: SparkSession, path: str, what: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and _order, a struct that sorts lines as they stand in their files, however the files are split.

    A key that stands on several lines gives a row for each; last_wins() of `operators.compare` keeps its last.
    """
    lines = spark.read.text(path)
    return lines.select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id")).alias("_order"))


#: What a line must be to count.
PARSES = "trim(value) <> '' and try_parse_json(value) is not null"


def read_tolerant(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """JSON lines; blank and unparseable ones are skipped. `limit` keeps the first parseable lines in file order.

    With a limit the files are read from the front, and no further than about where the limit falls.
    """
    if limit is not None:
        from millrace.sources.lines import read_capped

        found = read_capped(spark, path, limit, PARSES).lines
        parsed = found.select(F.from_json("value", schema).alias("r"), F.struct(F.col("file"), F.col("offset")).alias("_order"))
        return parsed.select("r.*", "_order")
    parsed = numbered_lines(spark, path).filter(PARSES).select(F.from_json("value", schema).alias("r"), "_order")
    return parsed.select("r.*", "_order")


def read_strict(spark: SparkSession, path: str, schema: str | StructType, missing_is_empty: bool = False) -> DataFrame:
    """JSON lines; a bad line fails the job, a missing file is an error or, on request, an empty table."""
    if missing_is_empty and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    require(spark, path, "table")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """One JSON document, or None if it is absent or can't be parsed."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = (reader.schema(schema) if schema else reader).json(path)
    return None if df.columns == ["_corrupt"] or not df.columns else df


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON document as a dict, or None if it is absent or broken."""
    if not path_exists(spark, path):
        return None
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        return None


def paths_of(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or [])


def read_artifacts(spark: SparkSession, pattern: str, schema: str | StructType) -> DataFrame:
    """Documents that match a glob, with the path each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("path"))


def read_split(spark: SparkSession, catalog: dict[str, str], name: str, schema: str | StructType, final: bool = False) -> DataFrame:
    """A named split, or a literal path; the test split is refused unless the run is final."""
    if name == "test" and not final:
        raise PermissionError("the test split is for final runs only; pass final=True")
    return read_strict(spark, catalog.get(name, name), schema)


def read_log(spark: SparkSession, pattern: str, metrics: list[str], step: str = "_step") -> DataFrame:
    """Metric logs of runs (JSON lines, a file in each run's folder): run, step, ts and the metrics, null where a line has none."""
    schema = ", ".join([f"{step} long", "_ts double", *[f"{m} double" for m in metrics]])
    logs = spark.read.schema(schema).json(pattern)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return logs.select(run.alias("run"), F.col(step).alias("step"), F.col("_ts").alias("ts"), *metrics)


def checksums(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".safetensors", ".bin", ".json")) -> DataFrame:
    """path, relative path, length and sha-256 of files with these suffixes below a folder, in order.

    Files are hashed by executors in chunks, so their size doesn't matter; executors
    open them through pyarrow's file systems (local, HDFS, S3, GCS by their scheme).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[sha256_of(p) for p in batch["path"]])

    found = files.filter(wanted).select("path", "length").mapInPandas(hashed, "path string, length long, sha256 string")
    root = folder.rstrip("/").rpartition("://")[2].rpartition("file:")[2]
    relative = F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", "")
    return found.select("path", relative.alias("file"), "length", "sha256").orderBy("file")


CHUNK = 1 << 20


def opened(path: str):
    """A file as a stream that is read a chunk at a time, unpacked if its name says it is packed.

    Files are opened through pyarrow's file systems, by executors. A stream of a
    plain file can be set to any place.
    """
    from pyarrow import fs

    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    packed = inner.endswith((".gz", ".bz2", ".zst", ".lz4"))
    return system.open_input_stream(inner, compression="detect") if packed else system.open_input_file(inner)


def sha256_of(path: str) -> str:
    """sha-256 of a file, read a chunk at a time."""
    import hashlib

    from pyarrow import fs

    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(inner, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the sizes of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
