"""Structured Streaming forms of the metering, queue and change-feed operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, key: str, ts: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Requests of a key in fixed or sliding windows; rows later than late are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(counts: DataFrame, most: int) -> DataFrame:
    return counts.withColumn("limited", F.col("n") > most).withColumn("retry_after", F.when(F.col("n") > most, F.col("end")))


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_deliveries(stream: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


def outliers(stream: DataFrame, x: str, limit: float) -> DataFrame:
    return stream.filter(F.col(x) > limit)


def token_bucket(stream: DataFrame, key: str, ts: str, rate: float, late: str = "10 minutes") -> DataFrame:
    """key, n and allowed by key and batch; the state is a bucket's tokens and the time of its last row."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (rate, None)
        n = allowed = 0
        for t in sorted(t.timestamp() for b in batches for t in b[ts]):
            tokens = min(rate, tokens + max(0.0, t - last) * rate) if last is not None else tokens
            last, n = t, n + 1
            if tokens >= 1:
                tokens, allowed = tokens - 1, allowed + 1
        state.update((tokens, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "allowed": [allowed]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long, allowed long", "tokens double, last double", "update", GroupStateTimeout.NoTimeout)


def stale_jobs(stream: DataFrame, key: str, ts: str, silence_minutes: int = 45, late: str = "1 minute", first: int = 1) -> DataFrame:
    """Keys whose heartbeats stop for silence_minutes of event time, with the last one to the nearest millisecond.

    Watermarks begin at 1970 and pandas times span 292 years, so the stream's clock starts at the millisecond first, 1970
    if not given. What is older is told with its own time, but waits for its timeout as if it came at first."""

    def clock(ms: int) -> int:
        return max(ms - first + 1, 1)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [last]})
            return
        seen = [int(b["_ms"].max()) for b in batches if len(b)] + ([state.get[0]] if state.exists else [])
        state.update((max(seen),))
        state.setTimeoutTimestamp(clock(max(seen)) + silence_minutes * 60_000)

    kind = stream.schema[key].dataType.simpleString()
    ms = F.unix_millis(F.timestamp_micros(F.round(F.unix_micros(ts), -3)))
    at = F.timestamp_millis(F.greatest(ms - F.lit(first) + 1, F.lit(1)))
    beats = stream.filter(F.col(ts).isNotNull()).select(key, at.alias(ts), ms.alias("_ms")).withWatermark(ts, late)
    return beats.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, last long", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def claim_order(batch: DataFrame, most: int) -> DataFrame:
    """The jobs that a worker takes from a batch: queued, highest priority first, then the oldest."""
    return batch.filter("status = 'queued'").orderBy(F.desc("priority"), "queued_at", "id").limit(most)


def folded(stream: DataFrame, root: str, empty: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A versioned table below root after apply(table, batch) for each micro-batch. A batch that is repeated after a
    failure starts from the version before it, so apply has to give the same for rows that are there already."""
    from ..operators import tables

    spark = stream.sparkSession
    tables.write_version(empty, f"{root}/table")

    def take(batch: DataFrame, n: int) -> None:
        tables.write_version(apply(tables.read_version(batch.sparkSession, f"{root}/table"), batch), f"{root}/table")

    each_batch(stream, take, f"{root}/checkpoint").awaitTermination()
    return tables.read_version(spark, f"{root}/table")


def buffered(spark, kind, path: str, files: int = 100, most_bytes: int | None = None, **options) -> DataFrame:
    """A stream of files whose micro-batches, as a write buffer's flushes, take so many files or bytes at most."""
    reader = spark.readStream.schema(kind).options(**options)
    return (reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader.option("maxFilesPerTrigger", files)).parquet(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """handle for each micro-batch; a batch that is repeated after a failure has the same number."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def collected(stream: DataFrame, mode: str, root: str) -> DataFrame:
    """What a stream has given once its present input is read, as a table below root.

    Complete results replace the table at each batch; others add a folder for each batch, written again if it is repeated."""
    out, kind = f"{root}/out", stream.schema

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else n}")

    stream.sparkSession.createDataFrame([], kind).write.parquet(f"{out}/batch=-1")
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(kind).parquet(out).select(*kind.names)


def conversation_state(turns: DataFrame, keep: int = 10) -> DataFrame:
    """Each turn with up to keep earlier texts of its conversation, oldest first (batch form of session state)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-keep, -1)
    return turns.withColumn("context", F.collect_list("text").over(w))
