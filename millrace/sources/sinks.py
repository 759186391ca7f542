"""Sinks: ordered JSON lines, one-document reports, isolated fan-out."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import paths_of

log = logging.getLogger(__name__)


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with null fields kept; in order, if one is given: part files then sort by name."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def document(df: DataFrame) -> str:
    """The single row of `df` as JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by the file system that the path names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def write_document(df: DataFrame, path: str) -> None:
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_metrics(df: DataFrame, folder: str) -> None:
    """Append to a metric log of JSON lines; readers see whole files only."""
    df.write.mode("append").json(folder)


def append_once(df: DataFrame, folder: str, batch: int, writer: str = "batch") -> bool:
    """Append a numbered batch to a metric log; one that is there already stays as it is, and False is returned.

    The batch is written under a name that readers pass over, then renamed, which is
    the commit: a batch that is retried, or replayed from a checkpoint, leaves one
    copy, and no reader sees part of one. Batches of different writers don't meet.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, draft = path(f"{folder}/{writer}-{batch:012d}"), path(f"{folder}/_{writer}-{batch:012d}-{uuid.uuid4().hex[:8]}")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(final):
        return False
    df.write.json(draft.toString())
    done = not system.exists(final) and system.rename(draft, final)
    if not done:
        system.delete(draft, True)
    return done


def once_log(folder: str, writer: str = "batch") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch of a stream to a metric log exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch, folder, number, writer)

    return write


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all committed batches of a log; a log without any is empty."""
    found = paths_of(spark, f"{folder}/[!_]*-[0-9]*")
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def numbers_only(df: DataFrame) -> DataFrame:
    """The numeric columns, for trackers that take nothing else."""
    return df.select(*[c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")])


MAX_TAG = 500


def tags(values: dict[str, object]) -> dict[str, str]:
    """Settings as texts that trackers take, each cut to what they allow."""
    return {k: str(v)[:MAX_TAG] for k, v in values.items()}


class Tracker(Protocol):
    """Where a run's numbers go."""

    def log(self, metrics: DataFrame) -> None: ...

    def log_summary(self, values: dict[str, object]) -> None: ...

    def log_artifact(self, path: str, name: str, kind: str) -> None: ...

    def finish(self) -> None: ...


class LocalTracker:
    """Always there: metrics are appended to a log of JSON lines, summary and artifacts are documents beside it."""

    def __init__(self, spark: SparkSession, folder: str, config: dict[str, object]) -> None:
        self.spark, self.folder, self.artifacts = spark, folder.rstrip("/"), []
        write_json(spark, f"{self.folder}/config.json", config)

    def log(self, metrics: DataFrame) -> None:
        append_metrics(metrics, f"{self.folder}/metrics")

    def log_summary(self, values: dict[str, object]) -> None:
        write_json(self.spark, f"{self.folder}/summary.json", values)

    def log_artifact(self, path: str, name: str, kind: str) -> None:
        self.artifacts.append({"path": path, "name": name, "kind": kind})

    def finish(self) -> None:
        write_json(self.spark, f"{self.folder}/artifacts.json", self.artifacts)


class Trackers:
    """Several trackers as one; one that fails doesn't stop the others."""

    def __init__(self, *trackers: Tracker) -> None:
        self.trackers = trackers

    def _each(self, call: Callable[[Tracker], None]) -> None:
        for tracker in self.trackers:
            try:
                call(tracker)
            except Exception:
                log.exception("%s failed", type(tracker).__name__)

    def log(self, metrics: DataFrame) -> None:
        self._each(lambda t: t.log(metrics))

    def log_summary(self, values: dict[str, object]) -> None:
        self._each(lambda t: t.log_summary(values))

    def log_artifact(self, path: str, name: str, kind: str) -> None:
        self._each(lambda t: t.log_artifact(path, name, kind))

    def finish(self) -> None:
        self._each(lambda t: t.finish())


#: Remote trackers by kind: the environment variable that says one is set up, in order of preference for `auto`.
REMOTE = {"wandb": "WANDB_API_KEY", "mlflow": "MLFLOW_TRACKING_URI"}


def choose_tracker(kind: str, environment: Mapping[str, str]) -> str:
    """`auto` takes the first remote tracker that is set up, else local; other kinds are taken as they are."""
    if kind != "auto":
        return kind
    return next((name for name, variable in REMOTE.items() if environment.get(variable)), "local")


def trackers(kind: str, local: LocalTracker, remote: dict[str, Callable[[], Tracker]], environment: Mapping[str, str]) -> Trackers:
    """The local tracker and the chosen remote one, made by the caller's factory; one that can't be made is left out."""
    chosen = choose_tracker(kind, environment)
    try:
        return Trackers(local, remote[chosen]()) if chosen in remote else Trackers(local)
    except Exception:
        log.exception("no %s tracker; metrics stay local", chosen)
        return Trackers(local)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch to every sink; one that fails doesn't stop the others."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, batch_id)
                except Exception:
                    log.exception("a sink failed on batch %d", batch_id)
        finally:
            batch.unpersist()

    return write
