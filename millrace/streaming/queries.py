"""Streaming forms of the rolling window, dedup, quotas, early stopping and event-time windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.session import shared_dir


def _in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def rolling_stats_stream(rows: DataFrame, key: str, order: list[str], latency: str, tokens: str, size: int = 500) -> DataFrame:
    """Per key, after each batch: the batch form's figures over the last `size` rows in event order.

    `order` are columns of longs. State: at most `size` rows a key; a late row takes its place among them.
    `seen` counts all rows of the key.
    """

    def at(values: list[float], q: float) -> float | None:
        return values[max(math.ceil(q * len(values)) - 1, 0)] if values else None

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = [], 0
        if state.exists:
            *columns, seen = state.get
            held = list(zip(*columns, strict=True))
        for batch in batches:
            seen += len(batch)
            held += list(zip(*[batch[c].tolist() for c in order], batch[latency].astype(float).tolist(), batch[tokens].astype(float).tolist(), strict=True))
            held = sorted(held)[-size:]
        state.update((*[list(c) for c in zip(*held, strict=True)], seen))
        values, total, spent = sorted(r[-2] for r in held), math.fsum(r[-1] for r in held), math.fsum(r[-2] for r in held)
        yield pd.DataFrame({key: [keys[0]], "seen": [seen], "window_count": [len(held)], "p50": [at(values, 0.5)], "p95": [at(values, 0.95)], "max_latency": [values[-1]], "tokens_sum": [total], "tokens_per_second": [total / spent if spent else None]})

    held = ", ".join([*[f"o{i} array<long>" for i in range(len(order))], "latency array<double>, tokens array<double>, seen long"])
    out = f"{key} string, seen long, window_count long, p50 double, p95 double, max_latency double, tokens_sum double, tokens_per_second double"
    return rows.groupBy(key).applyInPandasWithState(update, out, held, "update", GroupStateTimeout.NoTimeout)


def stop_stream(log: DataFrame, run: str, loss: str, patience: int = 3, threshold: float = 1e-4, order: list[str] | None = None) -> DataFrame:
    """Per run, after each batch: best loss, evaluations in a row without improvement, and whether to stop.

    A batch's rows are taken in `order`, or else as they come.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, stopped = state.get if state.exists else (None, 0, False)
        for batch in [_in_order(batches, order)] if order else batches:
            for x in batch[loss].astype(float):
                improved = best is None or (x < best and best - x > threshold)
                bad = 0 if improved else bad + 1
                best = x if best is None else min(best, x)
                stopped = stopped or bad >= patience
        state.update((best, bad, stopped))
        yield pd.DataFrame({run: [keys[0]], "best": [best], "bad": [bad], "stop": [stopped]})

    return log.groupBy(run).applyInPandasWithState(update, f"{run} string, best double, bad long, stop boolean", "best double, bad long, stop boolean", "update", GroupStateTimeout.NoTimeout)


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key, over the whole stream."""
    return rows.dropDuplicates([key])


def event_windows(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; windows close `late` after they end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))  # event time has to carry the session's zone
    grouped = timed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def quota_stream(rows: DataFrame, group: str, limits: dict[str, int], order: str, out: str = "verdict") -> DataFrame:
    """Rows with the verdict of quotas in turn: kept, or the column whose quota was full.

    Quotas are cascades as in the batch form, so each is a state of its own: rows
    are grouped by `group`, which must determine every column in `limits`, and a
    state holds one count for each. A batch's rows are taken in `order`.
    """
    columns = list(limits)
    names = [f.name for f in rows.schema.fields]

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = list(state.get[0]) if state.exists else [0] * len(columns)
        batch = _in_order(batches, [order])
        verdicts = []
        for _ in range(len(batch)):
            full = next((c for c, n in zip(columns, counts, strict=True) if n >= limits[c]), None)
            counts = counts if full else [n + 1 for n in counts]
            verdicts.append(full or "kept")
        state.update((counts,))
        yield batch[names].assign(**{out: verdicts})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(group).applyInPandasWithState(update, f"{schema}, `{out}` string", "counts array<long>", "append", GroupStateTimeout.NoTimeout)


class Quota(StatefulProcessor):
    """Keeps the first rows of a key, in order inside a batch, and marks the others; state is one count a key.

    Of a batch's rows no more than the quota are held at once, so a hot key costs its
    quota, not its rows. Rows that an earlier quota refused pass through and use up
    nothing. With `idle`, a key's count is forgotten so many milliseconds (of
    processing time) after its last row, by a timer.
    """

    def __init__(self, name: str, limit: int, order: str, out: str, idle: int | None = None) -> None:
        self.name, self.limit, self.order, self.out, self.idle = name, limit, order, out, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getMapState("count", "quota string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used = self.count.getValue((self.name,))[0] if self.count.containsKey((self.name,)) else 0
        room, held = max(self.limit - used, 0), None
        for batch in rows:
            open_rows = batch[self.out].isna()
            if not open_rows.all():
                yield batch[~open_rows]
            both = batch[open_rows] if held is None else pd.concat([held, batch[open_rows]])
            both = both.sort_values(self.order, kind="stable")
            held, refused = both.iloc[:room], both.iloc[room:]
            if len(refused):
                yield refused.assign(**{self.out: self.name})
        if held is not None and len(held):
            self.count.updateValue((self.name,), (used + len(held),))
            yield held
        if self.idle is not None:
            self._wait(timerValues.getCurrentProcessingTimeInMs())

    def _wait(self, now: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Buckets that keys without a timer are dealt into, and the columns of a row's bucket and key.
BUCKETS, IN_BUCKET, KEY = 1024, "bucket_of_quota", "key_of_quota"  # Spark renames those that begin with an underscore


class BucketQuota(StatefulProcessor):
    """Quota() for all keys of a bucket at once, so that Python is called for a bucket and not for every key; state is one count a key.

    Held are at most the quota's rows of each key of the bucket that the batch has.
    """

    def __init__(self, name: str, limit: int, order: str, out: str, columns: list[str]) -> None:
        self.name, self.limit, self.order, self.out, self.columns = name, limit, order, out, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getMapState("count", "key string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used, held = {}, None
        for batch in rows:
            open_rows = batch[self.out].isna()
            if not open_rows.all():
                yield batch.loc[~open_rows, self.columns]
            if not open_rows.any():
                continue
            both = batch[open_rows] if held is None else pd.concat([held, batch[open_rows]])
            both = both.sort_values(self.order, kind="stable")
            for k in both[KEY].unique():
                if k not in used:
                    used[k] = self.count.getValue((k,))[0] if self.count.containsKey((k,)) else 0
            stays = both.groupby(KEY, sort=False).cumcount() < self.limit - both[KEY].map(used)
            held, refused = both[stays], both[~stays]
            if len(refused):
                yield refused[self.columns].assign(**{self.out: self.name})
        if held is not None and len(held):
            for k, n in held[KEY].value_counts().items():
                self.count.updateValue((k,), (used[k] + int(n),))
            yield held[self.columns]

    def close(self) -> None:
        pass


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started in the block keep their state in RocksDB, which quotas_stream() needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def quotas_stream(rows: DataFrame, quotas: list[tuple[str, list[str], int]], order: str, out: str = "verdict", idle: int | None = None) -> DataFrame:
    """Rows with the verdict of several quotas, one after the other: null for rows that stay, or the name of the quota that was full.

    `quotas` has (name, columns, limit): a dedup is a quota of one row. Each is a
    stateful step keyed by its own columns, so that quotas by repository and by
    comment, neither of which determines the other, follow each other as in the
    batch cascade, batch by batch. Null is a key like any other. Without `idle`, keys
    go to Python by the bucket, as a call for each of many keys would take all the time.
    """
    told = rows.withColumn(out, F.lit(None).cast("string"))
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    for name, columns, limit in quotas:
        if idle is not None:
            told = told.groupBy(*columns).transformWithStateInPandas(Quota(name, limit, order, out, idle), schema, "Append", "ProcessingTime")
            continue
        keyed = told.withColumns({KEY: F.to_json(F.struct(*columns)), IN_BUCKET: F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")})
        told = keyed.groupBy(IN_BUCKET).transformWithStateInPandas(BucketQuota(name, limit, order, out, schema.names), schema, "Append", "None")
    return told


BATCH = "batch_number"


def run_available(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give the rows of all its batches, or of the last one in complete mode.

    Batches and the stream's checkpoint are files in the shared folder. With a
    `folder` of the caller's, calling again goes on from the checkpoint there.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.filter(F.col(BATCH) == rows.agg(F.max(BATCH)).first()[0])
    return rows.select(*stream.columns)


def read_stream(spark: SparkSession, folder: str, schema: StructType, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(folder)
