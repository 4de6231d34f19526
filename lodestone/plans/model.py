"""The driver's tables as documents, vectors, a graph, symbols, measurements and usage; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md"))
    return d.select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", name).alias("path"), name.alias("title"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"),
        F.octet_length("text").cast("long").alias("size"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int), 0)").alias("updated_at"),
    )


DOCS = """docs AS (SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, 'doc_' || doc_id || '.md' AS title, text AS content,
    [lang, source] AS tags, strlen(text)::BIGINT AS size, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at FROM documents)"""
SEARCH = DOCS + """, s AS (SELECT id, lower(title || ' ' || coalesce(content, '')) AS t FROM docs),
    w AS (SELECT id, t, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS words FROM s)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges src -> dst with a relation: orders of customers, customers and suppliers in nations, nations in regions."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    edge = lambda df, a, b, r: df.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    return (
        edge(t("orders"), key("o", "o_orderkey"), key("c", "o_custkey"), "child_of")
        .unionByName(edge(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), "located_in"))
        .unionByName(edge(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "located_in"))
        .unionByName(edge(t("nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), "part_of"))
        .unionByName(edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), key("p", "l_partkey"), key("s", "l_suppkey"), "supplied_by"))
    )


DAG = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'child_of' AS relation FROM orders
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation
    UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by' FROM lineitem)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation where they trade more than most pairs do: a cyclic graph of nations."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    home = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = line.join(home.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # orders move to their customers, not all their lines
    pairs = sold.groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst")).agg(F.count("*").alias("n"))
    limit = pairs.agg(F.percentile("n", 0.9).alias("q"))
    return pairs.crossJoin(F.broadcast(limit)).filter("n >= q").select("src", "dst", F.lit("trades").alias("relation"), "n")


TRADE = """pairs AS (SELECT 'n' || s_nationkey AS src, 'n' || c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    edges AS (SELECT src, dst, 'trades' AS relation, n FROM pairs WHERE n >= (SELECT quantile_cont(n::DOUBLE, 0.9) FROM pairs))"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code symbols: many share a name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat(F.col("p_brand"), F.lit(".rs")).alias("file"), F.col("p_size").alias("line"), F.round("p_retailprice", 2).alias("price"))


SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand || '.rs' AS file, p_size AS line, round(p_retailprice, 2) AS price FROM part)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timings of operations."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("operation"), F.col("value").alias("ms"), F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("size"))


#: A user's events in order, folded by a bucket of one token that fills up by one a second: k tokens left, n events let by.
BUCKETS = """folded AS (SELECT key, list_reduce(l, lambda a, x: {'t': x.t, 'k': least(1.0, a.k + (x.t - a.t) / 1e6) - (least(1.0, a.k + (x.t - a.t) / 1e6) >= 1)::INT, 'n': a.n + (least(1.0, a.k + (x.t - a.t) / 1e6) >= 1)::INT},
        {'t': -1000000000000000000::BIGINT, 'k': 1.0::DOUBLE, 'n': 0::BIGINT}) AS f, len(l) AS n FROM (SELECT user_id AS key, list({'t': epoch_us(ts), 'k': 1.0::DOUBLE, 'n': 0::BIGINT} ORDER BY ts, event_id) AS l FROM events GROUP BY 1))"""
MEASUREMENTS = "m AS (SELECT event_id AS id, ts, event_type AS operation, value AS ms, user_id AS key, (props::JSON->>'k')::BIGINT AS size FROM events)"
