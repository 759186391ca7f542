"""Run analytics, percentiles, rolling windows and streaming twins over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import percentiles as Q
from millrace.operators import runs as R
from millrace.operators import splits as S
from millrace.plans.curation_queries import KEYED, documents, keys_of
from millrace.session import shared_dir
from millrace.sources import tables
from millrace.streaming import queries as SQ


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def metric_log(spark, d):
    """Event types as runs, events in order as evaluations, values as losses."""
    return events(spark, d).select(F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("loss"))


LOG = "SELECT event_type AS run, ts, event_id, value AS loss FROM events"


def latency_percentiles(spark, d):
    found = Q.elements_at(events(spark, d), ["event_type"], "value", {"p50": Q.nearest_rank(0.5), "p95": Q.nearest_rank(0.95)})
    return found.select("event_type", "n", "p50", "p95")


def scan_limit(spark, d):
    """The first 500 documents of JSON lines among blank and broken ones, by a scan that stops reading there."""
    told = F.to_json(F.struct("doc_id", "lang", "text"))
    lines = documents(spark, d).select("doc_id", F.posexplode(F.array(F.lit("  "), told, F.lit('{"doc_id": '))).alias("at", "value"))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex[:12]}"
    lines.orderBy("doc_id", "at").select("value").write.text(path)
    found = tables.read_tolerant(spark, path, "doc_id long, lang string, text string", limit=500)
    return found.select("doc_id", "lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def length_stats(spark, d):
    """Lengths by the convention sorted[int(q n)], the share above a limit, and the limit that would keep 99 % of them."""
    return R.length_report(documents(spark, d), "n_chars", 4000)


def rolling_500(spark, d):
    rows = events(spark, d).select("event_id", "event_type", "ts", "value", (F.col("user_id") % 100 + 1).alias("tokens"))
    return R.rolling(rows, "event_type", ["ts", "event_id"], "value", "tokens").drop("ts", "value", "tokens")


def best_step(spark, d):
    return R.best_step(metric_log(spark, d), "run", "event_id", "loss")


def early_stop(spark, d):
    return R.early_stop(metric_log(spark, d), "run", ["ts", "event_id"], "loss").select("event_id", "best_before", "bad_count", "stop")


def leaderboard(spark, d):
    """Users as runs, their least purchase as the loss; those without one come last."""
    runs = events(spark, d).groupBy(F.col("user_id").cast("string").alias("run")).agg(F.min(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("loss"))
    return R.leaderboard(runs, "run", "loss")


def training_numbers(spark, d):
    """Steps and evaluations of a run with as many examples as a document has characters, the perplexity of a loss, and whether it stopped early."""
    per = R.steps_per_epoch(F.col("n_chars"), F.lit(16))
    loss = (F.col("doc_id") % 40) * 0.55
    return documents(spark, d).select(
        "doc_id", per.cast("long").alias("steps_per_epoch"), R.eval_steps(per, F.lit(4)).cast("long").alias("eval_steps"), F.round(R.perplexity(loss), 4).alias("perplexity"),
        R.early_stopped(F.col("n_chars") % 500, per, F.lit(3)).alias("early_stopped"),
    )


def elapsed(spark, d):
    return R.with_elapsed(metric_log(spark, d), "run", "ts").select("event_id", F.round("elapsed", 3).alias("elapsed"))


def training_curves(spark, d):
    """Series of a log whose rows have one metric or the other."""
    log = metric_log(spark, d).select("run", F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 != 0, F.col("loss")).alias("loss"), F.when(F.col("event_id") % 10 == 0, F.col("loss")).alias("eval_loss"))
    return R.history(log, "run", "step")


def sweep_order(spark, d):
    return R.sweep(best_step(spark, d).select("run", "best_loss"), "run", "best_loss")


def batch_latency(spark, d):
    """Events as batches: value is the batch's time, and 1 to 8 rows are in it."""
    return R.batch_latency(events(spark, d).withColumn("size", F.col("user_id") % 8 + 1), "value", "size", "size")


def union_in_order(spark, d):
    rows = S.union_in_order(documents(spark, d).select("doc_id", "lang"), spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.length("text").alias("chars")))
    return rows.select("doc_id", "lang", "chars", F.col("_table").alias("table_no"))


def event_stream(spark, d):
    return SQ.read_stream(spark, f"{d}/events.parquet*", events(spark, d).schema)


def ordered_stream(spark, d):
    return event_stream(spark, d).select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", (F.col("user_id") % 100 + 1).cast("double").alias("tokens"))


def stream_rolling(spark, d):
    """The last window of each event type, as `rolling_500` has it for the type's last event."""
    stats = SQ.run_available(SQ.rolling_stats_stream(ordered_stream(spark, d), "event_type", ["at", "event_id"], "value", "tokens"), "update")
    last = stats.groupBy("event_type").agg(F.max_by(F.struct(*stats.columns[2:]), "seen").alias("w")).select("event_type", "w.*")
    return last.withColumn("tokens_per_second", F.round("tokens_per_second", 6))


def stream_early_stop(spark, d):
    """Whether each event type, taken as a run, is stopped by its last event; runs over files in event order."""
    stops = SQ.run_available(SQ.stop_stream(ordered_stream(spark, d), "event_type", "value", order=["at", "event_id"]), "update")
    return stops.groupBy("event_type").agg(F.min("best").alias("best"), F.bool_or("stop").alias("stop"))


def stream_dedup(spark, d):
    return SQ.run_available(SQ.first_of_each(event_stream(spark, d).select("user_id"), "user_id"), "append")


def stream_quotas(spark, d):
    """At most 20 events of a user are kept, in order."""
    verdicts = SQ.run_available(SQ.quota_stream(event_stream(spark, d).select("event_id", "user_id"), "user_id", {"user_id": 20}, "event_id"), "append")
    return verdicts.select("event_id", "verdict")


def stream_quota_chain(spark, d):
    """Dedup, then a quota by source, then one by first word, as a stream: the verdicts of the batch cascade."""
    rows = SQ.read_stream(spark, f"{d}/documents.parquet*", documents(spark, d).schema)
    with SQ.state_on_disk(spark):
        found = SQ.run_available(SQ.quotas_stream(keys_of(rows), [("duplicate", ["hash"], 1), ("repo_quota", ["source"], 10), ("comment_quota", ["first_word"], 3)], "doc_id"), "append")
    return found.select("doc_id", F.coalesce("verdict", F.lit("kept")).alias("verdict"))


def stream_windows(spark, d):
    hours = SQ.event_windows(event_stream(spark, d), "ts", ["event_type"], "value")
    return SQ.run_available(hours, "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


ROLLING = """
SELECT event_id, event_type, ts, count(*) OVER w AS window_count, quantile_disc(value, 0.5) OVER w AS p50, quantile_disc(value, 0.95) OVER w AS p95, max(value) OVER w AS max_latency,
sum(tokens::DECIMAL(28,6)) OVER w::DOUBLE AS tokens_sum, sum(tokens::DECIMAL(28,6)) OVER w::DOUBLE / nullif(sum(value::DECIMAL(28,6)) OVER w::DOUBLE, 0) AS tokens_per_second
FROM (SELECT event_id, event_type, ts, value, user_id % 100 + 1 AS tokens FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)"""
STOPS = f"""
WITH l AS ({LOG}), a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM l),
u AS (SELECT *, (best_before IS NULL OR (loss < best_before AND best_before - loss > 0.0001::DOUBLE))::INT AS up FROM a),
i AS (SELECT *, sum(up) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM u),
c AS (SELECT *, (sum(1 - up) OVER (PARTITION BY run, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS bad_count FROM i)"""

QUERIES = {
    "latency_percentiles": (latency_percentiles, "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
    "length_stats": (
        length_stats,
        """WITH s AS (SELECT list_sort(list(n_chars)) AS v, count(*) AS n, round(avg(n_chars), 1) AS mean, max(n_chars) AS greatest, count(*) FILTER (n_chars > 4000)::DOUBLE / count(*) * 100 AS over FROM documents)
SELECT n, mean AS seq_len_mean, v[(floor(n * 0.5::DOUBLE) + 1)::INT] AS seq_len_p50, v[(floor(n * 0.95::DOUBLE) + 1)::INT] AS seq_len_p95, greatest AS seq_len_max, round(over, 2) AS seq_len_truncated_pct, over > 5 AS warn,
CASE WHEN over > 5 THEN v[(floor(n * 0.99::DOUBLE) + 1)::INT] END AS suggested_limit FROM s""",
    ),
    "rolling_500": (rolling_500, f"SELECT * EXCLUDE (ts) FROM ({ROLLING})"),
    "best_step": (
        best_step,
        f"""WITH l AS ({LOG}), b AS (SELECT run, min(loss) AS best_loss FROM l GROUP BY run), s AS (SELECT l.run, best_loss, min(event_id) AS best_step FROM l JOIN b ON l.run = b.run AND loss = best_loss GROUP BY 1, 2)
SELECT s.run, best_loss, best_step, (SELECT count(*) FROM l WHERE l.run = s.run AND event_id > best_step) AS evals_after_best FROM s""",
    ),
    "early_stop": (early_stop, f"{STOPS} SELECT event_id, best_before, bad_count, bad_count >= 3 AS stop FROM c"),
    "leaderboard": (
        leaderboard,
        """WITH r AS (SELECT user_id::VARCHAR AS run, min(value) FILTER (event_type = 'purchase') AS loss FROM events GROUP BY 1)
SELECT run, loss, row_number() OVER (ORDER BY loss NULLS LAST, run) AS rank FROM r""",
    ),
    "scan_limit": (scan_limit, "SELECT doc_id, lang, md5(text) AS digest, length(text)::BIGINT AS n FROM documents ORDER BY doc_id LIMIT 500"),
    "training_numbers": (
        training_numbers,
        """SELECT doc_id, greatest(1, ceil(n_chars::DOUBLE / 16))::BIGINT AS steps_per_epoch, greatest(1, floor(greatest(1, ceil(n_chars::DOUBLE / 16)) / 4))::BIGINT AS eval_steps,
CASE WHEN doc_id % 40 * 0.55::DOUBLE < 20 THEN round(exp(doc_id % 40 * 0.55::DOUBLE), 4) END AS perplexity, n_chars % 500 < greatest(1, ceil(n_chars::DOUBLE / 16)) * 3 - 1 AS early_stopped FROM documents""",
    ),
    "elapsed": (elapsed, "SELECT event_id, round(date_diff('microsecond', min(ts) OVER (PARTITION BY event_type), ts)::DOUBLE / 1000000::DOUBLE, 3) AS elapsed FROM events"),
    "training_curves": (training_curves, "SELECT event_type AS run, CASE WHEN event_id % 10 = 0 THEN 'eval_loss' ELSE 'loss' END AS series, event_id AS step, value FROM events WHERE value IS NOT NULL"),
    "sweep_order": (sweep_order, "SELECT event_type AS run, min(value) AS best_loss FROM events GROUP BY 1"),
    "batch_latency": (
        batch_latency,
        """WITH x AS (SELECT value / (user_id % 8 + 1) AS l FROM events, range(0, 8) AS r(i) WHERE i <= user_id % 8)
SELECT count(*) AS n, round(quantile_disc(l, 0.5), 3) AS latency_p50_s, round(quantile_disc(l, 0.95), 3) AS latency_p95_s FROM x""",
    ),
    "union_in_order": (union_in_order, "SELECT doc_id, lang, NULL::INT AS chars, 0 AS table_no FROM documents UNION ALL SELECT item_id, NULL, length(text)::INT, 1 FROM benchmark"),
    "stream_rolling": (
        stream_rolling,
        f"SELECT event_type, window_count, p50, p95, max_latency, tokens_sum, round(tokens_per_second, 6) AS tokens_per_second FROM ({ROLLING}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "stream_early_stop": (stream_early_stop, f"{STOPS} SELECT run AS event_type, min(loss) AS best, bool_or(bad_count >= 3) AS stop FROM c GROUP BY 1"),
    "stream_quotas": (stream_quotas, "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20 THEN 'kept' ELSE 'user_id' END AS verdict FROM events"),
    "stream_quota_chain": (
        stream_quota_chain,
        f"""WITH k AS ({KEYED}), a AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1 AS one FROM k),
b AS (SELECT *, one AND row_number() OVER (PARTITION BY one, source ORDER BY doc_id) <= 10 AS two FROM a), c AS (SELECT *, two AND row_number() OVER (PARTITION BY two, first_word ORDER BY doc_id) <= 3 AS three FROM b)
SELECT doc_id, CASE WHEN three THEN 'kept' WHEN two THEN 'comment_quota' WHEN one THEN 'repo_quota' ELSE 'duplicate' END AS verdict FROM c""",
    ),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id FROM events"),
    "stream_windows": (
        stream_windows,
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(28,6))::DOUBLE AS total FROM events GROUP BY 1, 2",
    ),
}
