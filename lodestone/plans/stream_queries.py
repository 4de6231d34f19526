"""Events read as a stream; what a stream gives when all of it has been read is a table like any other."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import streams
from . import model
from .model import BUCKETS, MEASUREMENTS


def _events(spark, sf_dir):
    """The events as a stream of files; event time is a timestamp, as watermarks need it."""
    kind = model.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("value").alias("ms"), F.col("user_id").alias("key"))


def _plain(df):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def _read(spark, stream, mode):
    return _plain(streams.collected(stream, mode, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"))


def stream_windows(spark, sf_dir):
    return _read(spark, streams.windowed_counts(_events(spark, sf_dir), "operation", "ts", "6 hours", "1 day"), "complete")


def stream_sliding(spark, sf_dir):
    return _read(spark, streams.windowed_counts(_events(spark, sf_dir), "operation", "ts", "1 day", "1 day", "12 hours"), "complete")


def stream_sessions(spark, sf_dir):
    return _read(spark, streams.session_counts(_events(spark, sf_dir), "key", "ts", "8 hours", "1 day"), "complete")


def stream_rate_limit(spark, sf_dir):
    counts = streams.windowed_counts(_events(spark, sf_dir), "key", "ts", "1 hour", "1 day")
    return _read(spark, streams.rate_limited(counts, 1), "complete").filter("limited").select("key", "start", "n", "retry_after")


def stream_outliers(spark, sf_dir):
    return _read(spark, streams.outliers(_events(spark, sf_dir), "ms", 99.0), "append").select("id", "ts", "ms")


def stream_distinct(spark, sf_dir):
    """One delivery for each user and operation, whichever comes first."""
    events = _events(spark, sf_dir).withColumn("delivery", F.concat_ws("/", "key", "operation"))
    return _read(spark, streams.distinct_deliveries(events, "delivery", "ts", "60 days"), "append").select("delivery")


def stream_token_bucket(spark, sf_dir):
    return _read(spark, streams.token_bucket(_events(spark, sf_dir), "key", "ts", 1.0), "update").groupBy("key").agg(F.sum("n").alias("n"), F.sum("allowed").alias("allowed"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_sessions, stream_rate_limit, stream_outliers, stream_distinct, stream_token_bucket)}
_SPAN = "time_bucket(INTERVAL {0}, ts, TIMESTAMP '1970-01-01')"
ORACLE = {
    "stream_token_bucket": f"WITH {BUCKETS} SELECT key, n, f.n AS allowed FROM folded",
    "stream_windows": f"WITH {MEASUREMENTS} SELECT operation, {_SPAN.format('6 HOURS')} AS start, {_SPAN.format('6 HOURS')} + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM m GROUP BY ALL",
    "stream_sliding": f"WITH {MEASUREMENTS}, b AS (SELECT operation, {_SPAN.format('12 HOURS')} - to_hours(12 * unnest([0, 1])) AS start FROM m) SELECT operation, start, start + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM b GROUP BY ALL",
    "stream_sessions": f"""WITH {MEASUREMENTS}, g AS (SELECT key, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 8 HOURS THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY key ORDER BY ts)),
        s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT key, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS \"end\", count(*) AS n FROM s GROUP BY key, k""",
    "stream_rate_limit": f"WITH {MEASUREMENTS} SELECT key, {_SPAN.format('1 HOUR')} AS start, count(*) AS n, {_SPAN.format('1 HOUR')} + INTERVAL 1 HOUR AS retry_after FROM m GROUP BY ALL HAVING count(*) > 1",
    "stream_outliers": f"WITH {MEASUREMENTS} SELECT id, ts, ms FROM m WHERE ms > 99",
    "stream_distinct": f"WITH {MEASUREMENTS} SELECT DISTINCT key || '/' || operation AS delivery FROM m",
}
