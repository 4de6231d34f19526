"""Checks and summaries of operations, queues, versions and usage."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sanitize
from ..operators import stats
from ..streaming import streams
from . import model
from .model import DOCS, MEASUREMENTS, SYMBOLS
from .stat_queries import _m, _r
from .text_queries import _clean_sql

AS_OF = "2024-01-20 00:00:00"
CLASSES = {"view": "constant", "signup": "logarithmic", "purchase": "linear", "error": "linearithmic", "click": "quadratic"}


def _class(operation):
    return F.try_element_at(F.create_map(*(F.lit(x) for p in CLASSES.items() for x in p)), operation)


def growth_check(spark, sf_dir):
    by = _m(spark, sf_dir).filter("size > 0").groupBy("operation", "size").agg(F.max("ms").alias("ms"))
    found = stats.growth_check(by, "operation", "size", "ms", _class(F.col("operation")))
    return found.select("operation", "size", "broken")


def _bulk(spark, sf_dir):
    m = _m(spark, sf_dir)
    failed = F.col("id") % 13 == 0
    score = stats.bulk_efficiency(failed, F.col("size") * 200.0, (F.col("key") % 100) / 100.0, _class(F.col("operation")))
    return m.select("id", "operation", score.alias("efficiency"), (F.col("ms") / 10).alias("speedup"), "size", failed.alias("failed"), "ts")


def bulk_scores(spark, sf_dir):
    return _r(_bulk(spark, sf_dir).select("id", "efficiency"))


def bulk_summary(spark, sf_dir):
    return _r(stats.bulk_summary(_bulk(spark, sf_dir), "operation"))


def recent_operations(spark, sf_dir):
    """The last ten operations of each type."""
    return stats.last_versions(_m(spark, sf_dir), "operation", [F.desc("ts"), F.desc("id")], 10).select("operation", "id", "version")


def compliance(spark, sf_dir):
    by = _bulk(spark, sf_dir).groupBy("operation").agg(F.avg("efficiency").alias("efficiency"), F.avg("speedup").alias("speedup"), F.avg(F.col("failed").cast("int")).alias("contention"), (F.count("*") % 17).alias("pending"))
    return _r(stats.compliance(by))


def health(spark, sf_dir):
    m = _m(spark, sf_dir)
    ok = stats.healthy(F.col("ms"), F.col("size"), F.lit(100.0), F.col("key") % 100, F.lit(100.0))
    return m.groupBy("operation").agg(F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("unhealthy"))


def operation_range(spark, sf_dir):
    return _r(_m(spark, sf_dir).groupBy("operation").agg(F.min("ms").alias("least"), F.avg("ms").alias("mean"), F.max("ms").alias("most")))


def benchmark_summary(spark, sf_dir):
    ranks = stats.ranked_percentiles(_m(spark, sf_dir), "operation", "ms", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    rates = _m(spark, sf_dir).groupBy("operation").agg(F.avg("ms").alias("mean"), (1000 / F.avg("ms")).alias("per_second"), F.avg((F.col("ms") < 90).cast("int")).alias("successes"))
    return _r(ranks.join(rates, "operation"))


def _jobs(spark, sf_dir):
    """Orders as jobs: open ones are queued, half of the partial ones have failed."""
    o = model.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), "failed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
    finished = F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, 0, cast(o_orderkey % 200 AS int), 0)")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("queued_at"), finished.alias("finished_at"), F.col("o_orderpriority").alias("level"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))


def queue_health(spark, sf_dir):
    return stats.queue_health(_jobs(spark, sf_dir), F.expr(f"timestamp_ntz'{AS_OF}'"))


def claimed_jobs(spark, sf_dir):
    return streams.claim_order(_jobs(spark, sf_dir), 25).select("id", "priority")


def jobs_of_owners(spark, sf_dir):
    """The newest three jobs of each owner, with the owner's name."""
    c = model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"))
    newest = stats.last_versions(_jobs(spark, sf_dir), "owner", [F.desc("queued_at"), F.desc("id")], 3)
    return newest.join(c, "owner").select("owner", "name", "version", "id", "status")


def metric_problems(spark, sf_dir):
    by = _m(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    n, total = F.when(F.col("key") % 10 == 0, 0).otherwise(F.col("n")), F.when(F.col("key") % 7 == 0, 0).otherwise(F.col("total") * 30)
    return by.select("key", F.array_join(stats.metric_problems(n, total, F.when(n > 0, total / n).otherwise(0.0)), ",").alias("problems"))


def rolling_percentiles(spark, sf_dir):
    return _r(stats.rolling_rank(_m(spark, sf_dir), "key", ["ts", "id"], "ms", 50, 0.95, "p95").select("id", "key", "p95"))


def sample_terms(spark, sf_dir):
    return stats.sample_terms(model.docs(spark, sf_dir))


def symbol_counts(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    total = s.agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.countDistinct("name").alias("names"), F.countDistinct("type").alias("types"))
    return _r(total.withColumn("density", F.col("symbols") / F.col("files")))


def distinct_counts(spark, sf_dir):
    """Exact distinct counts, and whether the approximate ones are within a tenth."""
    m = _m(spark, sf_dir)
    # each alone: beside a distinct count, an approximate one keeps its registers for every distinct value
    about = m.agg(F.approx_count_distinct("key", 0.02).alias("k"), F.approx_count_distinct("size", 0.02).alias("s"))
    a = about.crossJoin(m.agg(F.countDistinct("key").alias("keys"))).crossJoin(m.agg(F.countDistinct("size").alias("sizes")))  # one row each
    return a.select("keys", "sizes", (F.abs(F.col("k") - F.col("keys")) <= 0.1 * F.col("keys")).alias("keys_close"), (F.abs(F.col("s") - F.col("sizes")) <= 0.1 * F.col("sizes")).alias("sizes_close"))


def version_stats(spark, sf_dir):
    v = stats.last_versions(_m(spark, sf_dir), "key", [F.desc("ts"), F.desc("id")], 10)
    per = v.groupBy("key").agg(F.count("*").alias("versions"))
    return _r(per.agg(F.count("*").alias("files"), F.sum("versions").alias("versions"), F.avg("versions").alias("mean")))


def conversation_context(spark, sf_dir):
    c = streams.conversation_state(model.table(spark, sf_dir, "conversations"), 2)
    return c.select("conv_id", "turn", F.size("context").alias("held"), F.sha2(F.array_join("context", "|"), 256).alias("context_sha256"))


def as_of_join(spark, sf_dir):
    """Each error with the last view of the same user before it."""
    m = _m(spark, sf_dir)
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    seen = m.withColumn("view", F.last(F.when(F.col("operation") == "view", F.col("id")), True).over(w))
    return seen.filter("operation = 'error'").select("id", "key", "view")


QUERIES = {f.__name__: f for f in (growth_check, bulk_scores, bulk_summary, recent_operations, compliance, health, operation_range, benchmark_summary, queue_health, claimed_jobs, jobs_of_owners, metric_problems, rolling_percentiles, sample_terms, symbol_counts, distinct_counts, version_stats, conversation_context, as_of_join)}

_CASE = "CASE operation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + " END"
_SCORE = f"""least(1.0, CASE WHEN id % 13 = 0 THEN 0.5 ELSE 1.0 END * CASE WHEN size * 200 > 10000 THEN 1.2 WHEN size * 200 < 1000 THEN 0.8 ELSE 1.0 END * CASE WHEN (key % 100) / 100.0::DOUBLE > 0.9 THEN 1.1 WHEN (key % 100) / 100.0::DOUBLE < 0.7 THEN 0.9 ELSE 1.0 END
    * CASE operation WHEN 'view' THEN 1.3 WHEN 'signup' THEN 1.2 WHEN 'purchase' THEN 0.8 WHEN 'error' THEN 1.0 ELSE 0.5 END)::DOUBLE"""
_BULK = f"b AS (SELECT id, operation, {_SCORE} AS efficiency, ms / 10 AS speedup, size, id % 13 = 0 AS failed, ts FROM m)"
_JOBS = f"""j AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'done' END AS status, o_orderdate AS queued_at,
    TIMESTAMP '{AS_OF}' - to_minutes(o_orderkey % 200) AS finished_at, substring(o_orderpriority, 1, 1)::INT AS priority FROM orders)"""
_RANK = "list_sort(list(ms))[least(floor(count(*) * {})::INT + 1, count(*))]"
_WORDS = ", ".join(f"'{w}'" for w in sanitize.STOP_WORDS)
ORACLE = {
    "growth_check": f"""WITH {MEASUREMENTS}, b AS (SELECT operation, size, max(ms) AS ms FROM m WHERE size > 0 GROUP BY ALL), g AS (SELECT *, ms / nullif(lag(ms) OVER w, 0) AS ratio, size / nullif(lag(size) OVER w, 0)::DOUBLE AS f FROM b WINDOW w AS (PARTITION BY operation ORDER BY size))
        SELECT operation, size, coalesce(ratio > 1.5 * CASE operation WHEN 'view' THEN 1.0 WHEN 'signup' THEN log2(f) WHEN 'purchase' THEN f WHEN 'error' THEN f * log2(f) ELSE f * f END, false) AS broken FROM g""",
    "bulk_scores": f"WITH {MEASUREMENTS}, {_BULK} SELECT id, round(efficiency, 6) AS efficiency FROM b",
    "bulk_summary": f"WITH {MEASUREMENTS}, {_BULK} SELECT operation, count(*) AS operations, round(avg(efficiency), 6) AS efficiency, round(avg(speedup), 6) AS speedup, (sum(size) // count(*))::BIGINT AS mean_size, round(1 - avg(failed::INT), 6) AS successes, max(ts) AS last FROM b GROUP BY operation",
    "recent_operations": f"WITH {MEASUREMENTS}, r AS (SELECT operation, id, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, id DESC) AS version FROM m) SELECT * FROM r WHERE version <= 10",
    "compliance": f"""WITH {MEASUREMENTS}, {_BULK}, a AS (SELECT operation, avg(efficiency) AS efficiency, avg(speedup) AS speedup, avg(failed::INT) AS contention, count(*) % 17 AS pending FROM b GROUP BY operation),
        k AS (SELECT *, efficiency >= 0.8 AND speedup >= 5 AS bulk_ok, contention < 0.3 AND pending < 10 AS contention_ok FROM a)
        SELECT operation, round(efficiency, 6) AS efficiency, round(speedup, 6) AS speedup, round(contention, 6) AS contention, pending, bulk_ok, contention_ok, round((bulk_ok::INT + contention_ok::INT + 1) / 3.0, 6) AS score, (bulk_ok::INT + contention_ok::INT + 1) / 3.0 >= 0.8 AS compliant FROM k""",
    "health": f"WITH {MEASUREMENTS}, h AS (SELECT operation, ms <= 90 AND size / 100.0 <= 0.9 AND key % 100 <= 95 AS ok FROM m) SELECT operation, count(*) FILTER (ok) AS healthy, count(*) FILTER (NOT ok) AS unhealthy FROM h GROUP BY operation",
    "operation_range": f"WITH {MEASUREMENTS} SELECT operation, round(min(ms), 6) AS least, round(avg(ms), 6) AS mean, round(max(ms), 6) AS most FROM m GROUP BY operation",
    "benchmark_summary": f"WITH {MEASUREMENTS} SELECT operation, round({_RANK.format('0.5')}, 6) AS median, round({_RANK.format('0.95')}, 6) AS p95, round({_RANK.format('0.99')}, 6) AS p99, round(avg(ms), 6) AS mean, round(1000 / avg(ms), 6) AS per_second, round(avg((ms < 90)::INT), 6) AS successes FROM m GROUP BY operation",
    "queue_health": f"""WITH {_JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed' AND finished_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS failed_recent,
        CASE WHEN count(*) FILTER (status = 'queued') > 0 THEN greatest(0, date_diff('second', min(queued_at) FILTER (status = 'queued'), TIMESTAMP '{AS_OF}')) END AS oldest_queued_seconds FROM j""",
    "claimed_jobs": f"WITH {_JOBS} SELECT id, priority FROM j WHERE status = 'queued' ORDER BY priority DESC, queued_at, id LIMIT 25",
    "jobs_of_owners": f"WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY queued_at DESC, id DESC) AS version FROM j) SELECT owner, c_name AS name, version, id, status FROM r JOIN customer ON owner = c_custkey WHERE version <= 3",
    "metric_problems": f"""WITH {MEASUREMENTS}, a AS (SELECT key, CASE WHEN key % 10 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN key % 7 = 0 THEN 0 ELSE sum(size) * 30 END AS total FROM m GROUP BY key)
        SELECT key, array_to_string(list_filter([CASE WHEN total < n THEN 'size_below_count' END, CASE WHEN n = 0 AND total >= 1024 THEN 'size_without_documents' END, CASE WHEN n > 0 AND NOT (total > 0 AND total / n < 100000000) THEN 'odd_mean' END], lambda x: x IS NOT NULL), ',') AS problems FROM a""",
    "rolling_percentiles": f"WITH {MEASUREMENTS}, w AS (SELECT id, key, list(ms) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM m) SELECT id, key, round(list_sort(v)[least(floor(len(v) * 0.95)::INT + 1, len(v))], 6) AS p95 FROM w",
    "sample_terms": f"""WITH {DOCS}, f AS (SELECT id, string_split({_clean_sql("content")}, ' ') AS w FROM docs ORDER BY id LIMIT 5),
        t AS (SELECT id, list_filter(w, lambda t: CASE WHEN contains(t, '*') THEN t = '*' OR strlen(replace(t, '*', '')) BETWEEN 1 AND 100 ELSE strlen(t) BETWEEN 1 AND 100 AND regexp_matches(t, '\\p{{L}}') END)[1:3] AS w FROM f), u AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS place FROM t),
        g AS (SELECT lower(term) AS term, min(id * 10 + place) AS o FROM u WHERE lower(term) NOT IN ({_WORDS}) AND NOT regexp_matches(lower(term), 'password|secret|token|\\p{{N}}') AND strlen(term) > 2 GROUP BY 1) SELECT term FROM g ORDER BY o LIMIT 4""",
    "symbol_counts": f"WITH {SYMBOLS} SELECT count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT name) AS names, count(DISTINCT type) AS types, round(count(*)::DOUBLE / count(DISTINCT file), 6) AS density FROM symbols",
    "distinct_counts": f"WITH {MEASUREMENTS} SELECT count(DISTINCT key) AS keys, count(DISTINCT size) AS sizes, true AS keys_close, true AS sizes_close FROM m",
    "version_stats": f"WITH {MEASUREMENTS}, k AS (SELECT key, least(count(*), 10) AS versions FROM m GROUP BY key) SELECT count(*) AS files, sum(versions)::BIGINT AS versions, round(avg(versions), 6) AS mean FROM k",
    "conversation_context": "WITH w AS (SELECT conv_id, turn, list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS c FROM conversations) SELECT conv_id, turn, coalesce(len(c), 0) AS held, sha256(coalesce(array_to_string(c, '|'), '')) AS context_sha256 FROM w",
    "as_of_join": f"WITH {MEASUREMENTS} SELECT e.id, e.key, (SELECT arg_max(v.id, (v.ts, v.id)) FROM m v WHERE v.key = e.key AND v.operation = 'view' AND (v.ts, v.id) < (e.ts, e.id)) AS view FROM m e WHERE e.operation = 'error'",
}
