"""Statistics, windows and metering over events as timings, orders as jobs, and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from . import model
from .model import BUCKETS, DOCS, MEASUREMENTS

AS_OF = "timestamp_ntz'2024-01-20 00:00:00'"


def _m(spark, sf_dir):
    return model.measurements(spark, sf_dir)


def _r(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def basic_stats(spark, sf_dir):
    return _r(stats.basic(_m(spark, sf_dir), "operation", "ms"))


def document_totals(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    return d.groupBy(F.element_at("tags", 1).alias("lang")).agg(F.count("*").alias("documents"), F.sum("size").alias("total"), F.expr("sum(size) div count(*)").alias("mean_size"), F.countDistinct(F.element_at("tags", 2)).alias("sources"))


def storage_efficiency(spark, sf_dir):
    return _r(stats.storage_efficiency(model.docs(spark, sf_dir)))


def percentiles_interp(spark, sf_dir):
    return _r(stats.percentiles(_m(spark, sf_dir), "operation", "ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}))


def percentiles_rank(spark, sf_dir):
    return _r(stats.ranked_percentiles(_m(spark, sf_dir), "operation", "ms", {"p95": 0.95, "p99": 0.99}))


def regression_fit(spark, sf_dir):
    fit = stats.regression(_m(spark, sf_dir), "operation", F.col("size"), F.col("ms"))
    return _r(fit.withColumn("class", stats.complexity(F.col("slope"), F.col("r2"))))


def growth_ratios(spark, sf_dir):
    by = _m(spark, sf_dir).groupBy("operation", "size").agg(F.avg("ms").alias("ms"))
    return _r(stats.growth(by, "operation", "size", "ms"))


def regression_detect(spark, sf_dir):
    m = _m(spark, sf_dir)
    half = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    before, after = (m.filter(c).groupBy("operation").agg(F.percentile("ms", 0.5).alias(n)) for n, c in (("before", F.col("ts") < half), ("after", F.col("ts") >= half)))
    j = before.join(after, "operation").withColumn("ratio", F.col("after") / F.col("before"))
    return _r(j.withColumn("verdict", stats.regressed(F.col("ratio"))))


def baseline_compare(spark, sf_dir):
    m = _m(spark, sf_dir)
    side = lambda op, n: m.filter(F.col("operation") == op).groupBy("size").agg(F.avg("ms").alias(n))
    return _r(side("view", "baseline").join(side("purchase", "candidate"), "size").withColumn("speedup", F.col("baseline") / F.col("candidate")))


def sla_check(spark, sf_dir):
    by = _m(spark, sf_dir).groupBy("operation", "size").agg(F.count("*").alias("n"), F.max("ms").alias("ms"))
    return _r(stats.sla(by, F.col("size") * 100, F.col("ms"), 50.0))


def dashboard(spark, sf_dir):
    return _r(stats.dashboard(_m(spark, sf_dir)))


def alerts(spark, sf_dir):
    return stats.alerts(stats.dashboard(_m(spark, sf_dir)), 100.0, 0.001)


def usage_view(spark, sf_dir):
    m = _m(spark, sf_dir)
    keys = m.select("key").distinct()
    recent = m.filter(F.expr(f"ts > {AS_OF} - INTERVAL 1 HOUR AND ts <= {AS_OF}")).groupBy("key").agg(F.count("*").alias("requests"), F.avg("ms").alias("mean"), F.max("ms").alias("most"))
    return _r(keys.join(recent, "key", "left").na.fill(0, ["requests"]))


def job_summary(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    return _r(o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.min("o_orderdate").cast("string").alias("oldest"), F.sum("o_totalprice").alias("work")), 2)


def repository_status(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = model.table(spark, sf_dir, "orders")
    counts = o.groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "open"), ("F", "finished"), ("P", "partial"))), F.count("*").alias("jobs"))
    return c.join(counts, c["c_custkey"] == counts["o_custkey"], "left").drop("o_custkey").na.fill(0)


def rate_limit_sliding(spark, sf_dir):
    return stats.sliding_count(_m(spark, sf_dir), "key", "ts", 3600).select("id", "key", "recent", (F.col("recent") > 3).alias("limited"))


def minute_counters(spark, sf_dir):
    return _m(spark, sf_dir).groupBy("key", F.date_trunc("minute", "ts").cast("string").alias("minute")).agg(F.count("*").alias("n"))


def monthly_quota(spark, sf_dir):
    m = _m(spark, sf_dir).groupBy("key", F.date_trunc("month", "ts").cast("string").alias("month")).agg(F.count("*").alias("used"))
    return m.withColumn("left", F.greatest(F.lit(0), 80 - F.col("used"))).withColumn("within", F.col("used") <= 80)


def last_n_versions(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return stats.last_versions(o, "path", [F.desc("o_orderdate"), F.desc("id")], 3).select("path", "id", "version")


def rolling_outliers(spark, sf_dir):
    return _r(stats.rolling(_m(spark, sf_dir), "operation", ["ts", "id"], "ms", 100, 50.0).select("id", "operation", "mean", "most", "outlier"))


def sessions(spark, sf_dir):
    s = stats.sessions(_m(spark, sf_dir), "key", "ts", 6 * 3600)
    return s.select("key", "session", "rows", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


def token_bucket(spark, sf_dir):
    return stats.token_bucket(_m(spark, sf_dir).select("id", "key", "ts"), "key", "ts", 1.0).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


def key_validation(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer")
    used = _m(spark, sf_dir).groupBy("key").agg(F.count("*").alias("used"))
    j = c.join(used, c["c_custkey"] == used["key"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    reason = F.when(F.col("c_acctbal") < 0, "inactive").when(F.col("c_nationkey") > 20, "expired").when(F.col("used") > 60, "quota").otherwise("ok")
    return j.select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("key_hash"), "used", reason.alias("reason"))


def consistency_report(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    return stats.consistency(d, d.filter("id % 40 <> 3").select("id").unionByName(spark.range(9_000_000, 9_000_005)))


def prune_jobs(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated"), "o_orderstatus")
    oldest = F.expr("timestamp_ntz'1994-01-01 00:00:00'")
    return stats.prune_jobs(o, F.col("o_orderstatus") == "F", "updated", oldest, 9000).select("id", "o_orderstatus")


def contention(spark, sf_dir):
    m = _m(spark, sf_dir)
    return _r(m.groupBy("operation").agg((F.count_if(F.col("ms") > 100) / F.count("*")).alias("ratio"), F.avg(F.when(F.col("ms") > 100, F.col("ms"))).alias("mean_wait"), F.approx_count_distinct("key", 0.01).alias("about_keys"), F.countDistinct("key").alias("keys")).drop("about_keys"))


QUERIES = {f.__name__: f for f in (basic_stats, document_totals, storage_efficiency, percentiles_interp, percentiles_rank, regression_fit, growth_ratios, regression_detect, baseline_compare, sla_check, dashboard, alerts, usage_view, job_summary, repository_status, rate_limit_sliding, minute_counters, monthly_quota, last_n_versions, rolling_outliers, sessions, token_bucket, key_validation, consistency_report, prune_jobs, contention)}

_DASH = f"WITH {MEASUREMENTS}, d AS (SELECT operation, count(*) AS n, avg(ms) AS mean, quantile_cont(ms, 0.95) AS p95, stddev_pop(ms) AS sd, count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6 AS per_second FROM m GROUP BY operation)"
_CLASS = "CASE WHEN r2 <= 0.8 THEN 'unclear' WHEN slope < 0.2 THEN 'constant' WHEN slope < 0.8 THEN 'logarithmic' WHEN slope < 1.2 THEN 'linear' WHEN slope < 1.8 THEN 'linearithmic' ELSE 'quadratic' END"
ORACLE = {
    "token_bucket": f"WITH {BUCKETS} SELECT key, f.n AS allowed, n FROM folded",
    "basic_stats": f"WITH {MEASUREMENTS} SELECT operation, count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(min(ms), 6) AS least, round(max(ms), 6) AS most, round(stddev_pop(ms), 6) AS sd, round(var_samp(ms), 6) AS variance FROM m GROUP BY operation",
    "document_totals": f"WITH {DOCS} SELECT tags[1] AS lang, count(*) AS documents, sum(size)::BIGINT AS total, (sum(size)::BIGINT // count(*)) AS mean_size, count(DISTINCT tags[2]) AS sources FROM docs GROUP BY 1",
    "storage_efficiency": f"WITH {DOCS}, a AS (SELECT count(*) AS documents, sum(size)::BIGINT AS total, sum(strlen(content)) AS c FROM docs), b AS (SELECT *, total // documents AS mean_size FROM a) SELECT documents, total, mean_size, round(c / total * (1 - CASE WHEN mean_size < 4096 THEN 0.15::DOUBLE * (1 - mean_size / 4096) ELSE 0 END) * 0.9::DOUBLE, 6) AS efficiency FROM b",
    "percentiles_interp": f"WITH {MEASUREMENTS} SELECT operation, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM m GROUP BY operation",
    "percentiles_rank": f"WITH {MEASUREMENTS}, l AS (SELECT operation, list_sort(list(ms)) AS v FROM m GROUP BY operation) SELECT operation, round(v[least(floor(len(v) * 0.95)::INT + 1, len(v))], 6) AS p95, round(v[least(floor(len(v) * 0.99)::INT + 1, len(v))], 6) AS p99 FROM l",
    "regression_fit": f"WITH {MEASUREMENTS}, l AS (SELECT operation, ln(size) AS x, ln(ms) AS y FROM m WHERE size > 0 AND ms > 0), r AS (SELECT operation, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, greatest(regr_r2(y, x), 0) AS r2 FROM l GROUP BY operation) SELECT operation, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, {_CLASS} AS class FROM r",
    "growth_ratios": f"WITH {MEASUREMENTS}, b AS (SELECT operation, size, avg(ms) AS ms FROM m GROUP BY ALL) SELECT operation, size, round(ms, 6) AS ms, round(ms / lag(ms) OVER w, 6) AS ratio, round(size::DOUBLE / nullif(lag(size) OVER w, 0), 6) AS size_ratio FROM b WINDOW w AS (PARTITION BY operation ORDER BY size)",
    "regression_detect": f"WITH {MEASUREMENTS}, b AS (SELECT operation, quantile_cont(ms, 0.5) FILTER (ts < TIMESTAMP '2024-01-15') AS before, quantile_cont(ms, 0.5) FILTER (ts >= TIMESTAMP '2024-01-15') AS after FROM m GROUP BY operation) SELECT operation, round(before, 6) AS before, round(after, 6) AS after, round(after / before, 6) AS ratio, CASE WHEN after / before > 1.5 THEN 'severe' WHEN after / before > 1.2 THEN 'moderate' WHEN after / before > 1.1 THEN 'minor' ELSE 'none' END AS verdict FROM b",
    "baseline_compare": f"WITH {MEASUREMENTS}, a AS (SELECT size, avg(ms) FILTER (operation = 'view') AS b, avg(ms) FILTER (operation = 'purchase') AS c FROM m GROUP BY size) SELECT size, round(b, 6) AS baseline, round(c, 6) AS candidate, round(b / c, 6) AS speedup FROM a WHERE b IS NOT NULL AND c IS NOT NULL",
    "sla_check": f"WITH {MEASUREMENTS}, b AS (SELECT operation, size, count(*) AS n, max(ms) AS ms FROM m GROUP BY ALL), c AS (SELECT *, 50.0::DOUBLE * greatest(1.0, log2(greatest(1.0, size * 100 / 1000.0))) AS allowed FROM b) SELECT operation, size, n, round(ms, 6) AS ms, round(allowed, 6) AS allowed, ms <= allowed AS met FROM c",
    "dashboard": f"{_DASH} SELECT operation, n, round(mean, 6) AS mean, round(p95, 6) AS p95, round(sd, 6) AS sd, round(per_second, 6) AS per_second FROM d",
    "alerts": f"{_DASH}, a AS (SELECT operation, unnest([CASE WHEN p95 > 100 THEN 'slow' END, CASE WHEN sd > mean THEN 'erratic' END, CASE WHEN per_second < 0.001 THEN 'idle' END]) AS alert FROM d) SELECT * FROM a WHERE alert IS NOT NULL",
    "usage_view": f"WITH {MEASUREMENTS}, r AS (SELECT key, count(*) AS requests, avg(ms) AS mean, max(ms) AS most FROM m WHERE ts > TIMESTAMP '2024-01-19 23:00:00' AND ts <= TIMESTAMP '2024-01-20' GROUP BY key) SELECT k.key, coalesce(requests, 0) AS requests, round(mean, 6) AS mean, round(most, 6) AS most FROM (SELECT DISTINCT key FROM m) k LEFT JOIN r ON k.key = r.key",
    "job_summary": "SELECT o_orderstatus AS status, count(*) AS jobs, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS oldest, round(sum(o_totalprice), 2) AS work FROM orders GROUP BY 1",
    "repository_status": "SELECT c_custkey, c_mktsegment, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS partial, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "rate_limit_sliding": f"WITH {MEASUREMENTS}, r AS (SELECT id, key, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM m) SELECT *, recent > 3 AS limited FROM r",
    "minute_counters": f"WITH {MEASUREMENTS} SELECT key, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM m GROUP BY ALL",
    "monthly_quota": f"WITH {MEASUREMENTS}, u AS (SELECT key, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS month, count(*) AS used FROM m GROUP BY ALL) SELECT *, greatest(0, 80 - used) AS \"left\", used <= 80 AS within FROM u",
    "last_n_versions": "SELECT o_custkey AS path, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS version FROM orders QUALIFY version <= 3",
    "rolling_outliers": f"WITH {MEASUREMENTS} SELECT id, operation, round(avg(ms) OVER w, 6) AS mean, round(max(ms) OVER w, 6) AS most, ms > 50 AS outlier FROM m WINDOW w AS (PARTITION BY operation ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
    "sessions": f"""WITH {MEASUREMENTS}, a AS (SELECT id, key, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, id)::BIGINT AS session FROM a) SELECT key, session, count(*) AS rows, min(ts)::VARCHAR AS start, max(ts)::VARCHAR AS "end" FROM b GROUP BY key, session""",
    "key_validation": f"WITH {MEASUREMENTS}, u AS (SELECT key, count(*) AS used FROM m GROUP BY key) SELECT sha256(c_custkey::VARCHAR) AS key_hash, coalesce(used, 0) AS used, CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_nationkey > 20 THEN 'expired' WHEN coalesce(used, 0) > 60 THEN 'quota' ELSE 'ok' END AS reason FROM customer LEFT JOIN u ON c_custkey = key",
    "consistency_report": "WITH a AS (SELECT count(*) AS documents, count(*) FILTER (doc_id % 40 <> 3) + 5 AS indexed, count(*) FILTER (doc_id % 40 = 3) AS missing, 5 AS stale FROM documents) SELECT *, CASE WHEN missing * 20 <= documents THEN 'warning' ELSE 'failed' END AS status FROM a",
    "prune_jobs": "WITH k AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1994-01-01')), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS n, count(*) OVER () AS t FROM k) SELECT o_orderkey AS id, o_orderstatus FROM r WHERE o_orderstatus <> 'F' OR n > t - 9000",
    "contention": f"WITH {MEASUREMENTS} SELECT operation, round(count(*) FILTER (ms > 100) / count(*), 6) AS ratio, round(avg(ms) FILTER (ms > 100), 6) AS mean_wait, count(DISTINCT key) AS keys FROM m GROUP BY operation",
}
