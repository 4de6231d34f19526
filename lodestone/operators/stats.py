"""Statistics over timings, corpora and usage: one aggregation each, with windows where rows meet their neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked_percentiles(df: DataFrame, by: str, x: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles by group without gathering a group: positions come from a sort and a count."""
    counts = df.groupBy(by).agg(F.count(x).alias("_n"))
    placed = df.filter(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(x))).join(counts, by)
    at = lambda s: F.least(F.floor(F.col("_n") * s) + 1, F.col("_n"))
    return placed.groupBy(by).agg(*(F.max(F.when(F.col("_r") == at(s), F.col(x))).alias(name) for name, s in shares.items()))


def memory_efficiency(raw: Column, allocated: Column) -> Column:
    """Bytes of data for each byte taken; 0 where none is taken."""
    return F.when(allocated == 0, 0.0).otherwise(raw / allocated)


def relation_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of true counts: nodes, edges, relations, nodes with an edge out and in, and edges a node."""
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    both = nodes.agg(F.count("*").alias("nodes")).crossJoin(e)  # one row each
    return both.withColumn("edges_per_node", F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0))


def balance(df: DataFrame, part: Column) -> DataFrame:
    """One row: parts, rows, the least and most rows of a part, their mean, most over mean (skew) and mean over most (how
    evenly parts are used); what a tree's depth and fill are to a sorted file."""
    per = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    row = per.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return row.withColumns({"skew": F.col("most") / F.col("mean"), "utilisation": F.col("mean") / F.col("most")})


def basic(df: DataFrame, by: str, x: str) -> DataFrame:
    """n, mean, median (mean of the middle two), least, most, population deviation and sample variance."""
    c = F.col(x)
    return df.groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.stddev_pop(c).alias("sd"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"))


def percentiles(df: DataFrame, by: str, x: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles."""
    return df.groupBy(by).agg(*(F.percentile(x, s).alias(n) for n, s in shares.items()))


def regression(df: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """Least squares of ln y on ln x: slope, intercept and R squared (0 at the least)."""
    logs = df.filter((x > 0) & (y > 0)).select(by, F.log(x).alias("_x"), F.log(y).alias("_y"))
    return logs.groupBy(by).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.greatest(F.coalesce(F.regr_r2("_y", "_x"), F.lit(0.0)), F.lit(0.0)).alias("r2"))


def complexity(slope: Column, r2: Column) -> Column:
    return F.when(r2 <= 0.8, "unclear").when(slope < 0.2, "constant").when(slope < 0.8, "logarithmic").when(slope < 1.2, "linear").when(slope < 1.8, "linearithmic").otherwise("quadratic")


def growth(df: DataFrame, by: str, size: str, x: str) -> DataFrame:
    """Ratios between consecutive sizes."""
    w = W.partitionBy(by).orderBy(size)
    return df.select("*", F.try_divide(x, F.lag(x).over(w)).alias("ratio"), F.try_divide(size, F.lag(size).over(w)).alias("size_ratio"))


def regressed(ratio: Column) -> Column:
    return F.when(ratio > 1.5, "severe").when(ratio > 1.2, "moderate").when(ratio > 1.1, "minor").otherwise("none")


def sla(df: DataFrame, n: Column, ms: Column, base: float) -> DataFrame:
    allowed = base * F.greatest(F.lit(1.0), F.log2(F.greatest(F.lit(1.0), n / 1000)))
    return df.withColumn("allowed", allowed).withColumn("met", ms <= allowed)


def dashboard(df: DataFrame) -> DataFrame:
    """By operation: count, mean, p95, deviation, and operations a second over the span of its timestamps."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return df.groupBy("operation").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.percentile("ms", 0.95).alias("p95"), F.stddev_pop("ms").alias("sd"), F.when(span > 0, F.count("*") / span).alias("per_second"))


def alerts(board: DataFrame, p95: float = 100.0, per_second: float = 0.01) -> DataFrame:
    """A row for each rule that a dashboard's row breaks."""
    rules = F.array_compact(F.array(F.when(F.col("p95") > p95, "slow"), F.when(F.col("sd") > F.col("mean"), "erratic"), F.when(F.col("per_second") < per_second, "idle")))
    return board.select("operation", F.explode(rules).alias("alert"))


def storage_efficiency(docs: DataFrame) -> DataFrame:
    """Content share of size, less a penalty for small documents."""
    a = docs.agg(F.count("*").alias("documents"), F.sum("size").alias("total"), F.sum(F.octet_length("content")).alias("content"))
    mean = F.when(F.col("documents") > 0, F.expr("total div documents"))
    penalty = F.when(mean < 4096, 0.15 * (1 - mean / 4096)).otherwise(0.0)
    share = F.least(F.greatest(F.col("content") / F.col("total") * (1 - penalty) * 0.9, F.lit(0.0)), F.lit(1.0))
    return a.select("documents", "total", mean.alias("mean_size"), share.alias("efficiency"))


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """For each row the rows of its key within the last seconds, itself included."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def rolling(df: DataFrame, key: str, order: list[str], x: str, rows: int, outlier: float) -> DataFrame:
    """Mean and most of the last rows of a key, and whether a row is an outlier."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("mean", F.avg(x).over(w)).withColumn("most", F.max(x).over(w)).withColumn("outlier", F.col(x) > outlier)


def last_versions(df: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    return df.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("version") <= keep)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's rows with no pause over the gap."""
    w = W.partitionBy(key).orderBy(ts, "id")
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = df.withColumn("_new", F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def token_bucket(df: DataFrame, key: str, ts: str, rate: float) -> DataFrame:
    """allowed for each row of a key in time order: a bucket of rate tokens refills by rate tokens a second.

    Rows stream past in order; between them one key's two numbers are kept, since each decision depends on the one before."""
    state: dict = {}

    def one(k, t: datetime) -> bool:
        if state.get("key", state) != k:
            state.update(key=k, tokens=rate, last=t)
        tokens = min(rate, state["tokens"] + (t - state["last"]).total_seconds() * rate)
        state.update(tokens=tokens - (tokens >= 1), last=t)
        return tokens >= 1

    return _folded(df, key, [ts, "id"], [key, ts], lambda: one, "allowed", pa.bool_())


def flushes(df: DataFrame, key: str, ts: str, size: str, rows: int = 100, most_bytes: int = 10 << 20, millis: int = 50) -> DataFrame:
    """flush: the number of the write that takes a row of a key's buffer. A buffer is written once it holds so many rows or
    bytes; and before a row that comes millis or more after its first one."""
    state: dict = {}

    def one(k, t: datetime, n: int) -> int:
        if state.get("key", state) != k:
            state.update(key=k, flush=0, held=0, bytes=0, since=t)
        elif state["held"] and (t - state["since"]) / timedelta(milliseconds=1) >= millis:
            state.update(flush=state["flush"] + 1, held=0, bytes=0)
        if not state["held"]:
            state["since"] = t
        mine = state["flush"]
        state.update(held=state["held"] + 1, bytes=state["bytes"] + (n or 0))
        if state["held"] >= rows or state["bytes"] >= most_bytes:
            state.update(flush=mine + 1, held=0, bytes=0)
        return mine

    return _folded(df, key, [ts, "id"], [key, ts, size], lambda: one, "flush", pa.int64())


def _folded(df: DataFrame, key: str, order: list[str], needs: list[str], make, name: str, kind: pa.DataType) -> DataFrame:
    """df with make()'s function of needs, called for the rows of a key in order. No key is gathered: its rows stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            made = [one(*row) for row in zip(*(b.column(c).to_pylist() for c in needs), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], [*b.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} {'boolean' if kind == pa.bool_() else 'long'}"
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def consistency(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Counts and coverage of an index (id) against its documents (id), with a status."""
    both = docs.select("id").distinct().withColumn("d", F.lit(1)).join(indexed.select("id").distinct().withColumn("i", F.lit(1)), "id", "full_outer")
    a = both.agg(F.count("d").alias("documents"), F.count("i").alias("indexed"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("stale"))
    return a.withColumn("status", F.when((F.col("missing") == 0) & (F.col("stale") == 0), "passed").when(F.col("missing") * 20 <= F.col("documents"), "warning").otherwise("failed"))


def prune_jobs(jobs: DataFrame, finished: Column, updated: str, oldest: Column, most: int) -> DataFrame:
    """Without finished rows before oldest, then without the oldest finished ones while there are over most.

    Finished rows go first, so what stays of them is among the last most rows of all: no order of all rows is needed."""
    kept = jobs.filter(~(finished & (F.col(updated) < oldest)))
    last = kept.orderBy(F.when(finished, 1).otherwise(0), F.desc_nulls_first(updated), F.desc_nulls_first("id")).limit(most)
    return kept.filter(~finished).unionByName(last.filter(F.coalesce(finished, F.lit(True))))


def theoretical_growth(kind: Column, times: Column) -> Column:
    """How much longer an operation of a complexity class takes where its input is times as large; null if unclear."""
    return F.when(kind == "constant", 1.0).when(kind == "logarithmic", F.log2(times)).when(kind == "linear", times).when(kind == "linearithmic", times * F.log2(times)).when(kind == "quadratic", times * times)


def growth_check(df: DataFrame, by: str, size: str, x: str, kind: Column) -> DataFrame:
    """growth()'s rows with broken: whether the ratio is over 1.5 times what the class allows."""
    return growth(df, by, size, x).withColumn("broken", F.coalesce(F.col("ratio") > 1.5 * theoretical_growth(kind, F.col("size_ratio")), F.lit(False)))


def bulk_efficiency(failed: Column, per_second: Column, balance: Column, kind: Column) -> Column:
    """A score from 0 to 1 of one bulk operation."""
    errors = F.when(failed, 0.5).otherwise(1.0)
    speed = F.when(per_second > 10_000, 1.2).when(per_second < 1_000, 0.8).otherwise(1.0)
    even = F.when(balance > 0.9, 1.1).when(balance < 0.7, 0.9).otherwise(1.0)
    # The factor of each complexity class.
    factors = {"constant": 1.3, "logarithmic": 1.2, "linearithmic": 1.0, "linear": 0.8, "quadratic": 0.5}
    growing = F.coalesce(*(F.when(kind == name, f) for name, f in factors.items()), F.lit(0.7))
    return F.least(F.greatest(errors * speed * even * growing, F.lit(0.0)), F.lit(1.0))


def bulk_summary(df: DataFrame, by: str) -> DataFrame:
    """By type of bulk operation (efficiency, speedup, size, failed, ts): count, means, share of successes, the last one."""
    return df.groupBy(by).agg(F.count("*").alias("operations"), F.avg("efficiency").alias("efficiency"), F.avg("speedup").alias("speedup"), F.expr("sum(size) div count(*)").alias("mean_size"), (1 - F.avg(F.col("failed").cast("int"))).alias("successes"), F.max("ts").alias("last"))


def compliance(df: DataFrame) -> DataFrame:
    """Score of three parts (bulk operations, contention, structure) and whether it is 0.8 or more."""
    bulk = (F.col("efficiency") >= 0.8) & (F.col("speedup") >= 5.0)
    contention = (F.col("contention") < 0.3) & (F.col("pending") < 10)
    score = (bulk.cast("int") + contention.cast("int") + 1) / 3.0
    return df.withColumns({"bulk_ok": bulk, "contention_ok": contention, "score": score, "compliant": score >= 0.8})


def healthy(cpu: Column, memory: Column, most_memory: Column, connections: Column, most_connections: Column) -> Column:
    return (cpu <= 90) & (memory / most_memory <= 0.9) & (connections / most_connections <= 0.95)


def queue_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Of jobs (status, queued_at, finished_at): counts by status, failures of the last hour, age of the oldest queued."""
    is_ = lambda s: F.col("status") == s
    recent = is_("failed") & (F.col("finished_at") > as_of - F.expr("INTERVAL 1 HOUR"))
    oldest = F.min(F.when(is_("queued"), F.col("queued_at")))
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", oldest, as_of))
    return jobs.agg(*(F.count_if(is_(s)).alias(s) for s in ("queued", "in_progress", "failed")), F.count_if(recent).alias("failed_recent"), F.when(oldest.isNotNull(), age).alias("oldest_queued_seconds"))


def metric_problems(documents: Column, total: Column, mean: Column) -> Column:
    """Names of the rules that a store's totals break."""
    rules = {"size_below_count": total < documents, "size_without_documents": (documents == 0) & (total >= 1024), "odd_mean": (documents > 0) & ~((mean > 0) & (mean < 100_000_000))}
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def rolling_rank(df: DataFrame, key: str, order: list[str], x: str, rows: int, share: float, name: str) -> DataFrame:
    """The nearest-rank percentile of the last rows of a key; a row's window is bounded by rows."""
    values = F.sort_array(F.collect_list(x).over(W.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)))
    return df.withColumn(name, F.element_at(values, F.least(F.floor(F.size(values) * share) + 1, F.size(values)).cast("int")))


def sample_terms(docs: DataFrame, documents: int = 5, each: int = 3, most: int = 4) -> DataFrame:
    """Up to most search terms from the first documents (id, content): no stop word, no secret, no digit, over two bytes."""
    from ..functions import sanitize

    first = docs.orderBy("id").limit(documents)
    words = first.select("id", F.posexplode(F.slice(sanitize.terms(F.col("content")), 1, each)).alias("at", "term")).select("id", "at", F.lower("term").alias("term"))
    good = words.filter(~F.col("term").isin(*sanitize.STOP_WORDS) & ~F.col("term").rlike(r"password|secret|token|\p{N}") & (F.octet_length("term") > 2))
    return good.groupBy("term").agg(F.min(F.struct("id", "at")).alias("o")).orderBy("o").limit(most).select("term")
