"""Relationship queries over the tables' keys as a graph, and over the nations' trade, which has cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from . import model
from .model import DAG, TRADE


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _nodes(edges):
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def callers(spark, sf_dir):
    return graph.callers(model.dag(spark, sf_dir), _ids(spark, "n3", "c7")).select("src", "dst", "relation")


def callees(spark, sf_dir):
    return graph.callees(model.dag(spark, sf_dir), _ids(spark, "c7", "p12", "s3")).select("src", "dst", "relation")


def impact_depth(spark, sf_dir):
    return graph.impact(model.dag(spark, sf_dir), _ids(spark, "r1"), 4)


def risk_levels(spark, sf_dir):
    direct = model.dag(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct"))
    return direct.select("id", "direct", graph.risk(F.col("direct")).alias("risk"))


def call_chain(spark, sf_dir):
    found = graph.call_chain(model.dag(spark, sf_dir), _ids(spark, "p12"), _ids(spark, "r0", "r1", "r2", "r3", "r4"))
    return found.select("id", "hops", F.array_join("path", ">").alias("path"))


def cycles(spark, sf_dir):
    return graph.cycles(model.trade(spark, sf_dir))


def strong_components(spark, sf_dir):
    found = graph.strong_components(model.trade(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("nodes")).groupBy("nodes").agg(F.count("*").alias("components"))


def weak_components(spark, sf_dir):
    edges = model.dag(spark, sf_dir).filter("relation <> 'supplied_by' and dst <> 'r1'")
    found = graph.weak_components(_nodes(edges), edges)
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


def unused(spark, sf_dir):
    edges = model.dag(spark, sf_dir)
    return graph.unused(_nodes(edges), edges).groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


def orphans(spark, sf_dir):
    edges = model.dag(spark, sf_dir)
    everyone = model.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(model.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return graph.orphans(everyone, edges.filter("relation in ('child_of', 'supplied_by')"))


def hot(spark, sf_dir):
    return graph.hot(model.dag(spark, sf_dir), 25)


def deps_by_type(spark, sf_dir):
    return model.dag(spark, sf_dir).filter("relation = 'located_in'")


def relation_stats(spark, sf_dir):
    return graph.relation_stats(model.dag(spark, sf_dir))


def subgraph(spark, sf_dir):
    return graph.subgraph(model.dag(spark, sf_dir), _ids(spark, "o1", "p12"), 2).select("src", "dst", "relation")


def simple_paths(spark, sf_dir):
    trade = model.trade(spark, sf_dir)
    most = trade.filter("src <> dst").agg(F.max(F.struct("n", "src", "dst")).alias("m"))  # the ends of the busiest edge
    start, end = most.select(F.col("m.src").alias("id")), most.select(F.col("m.dst").alias("id"))
    return graph.simple_paths(trade, start, end, 4).select(F.array_join("path", ">").alias("path"), "length")


def degree_stats(spark, sf_dir):
    edges = model.dag(spark, sf_dir)
    return graph.degrees(_nodes(edges), edges)


def coupled(spark, sf_dir):
    return graph.coupled(model.dag(spark, sf_dir), 40)


def delete_cascade(spark, sf_dir):
    edges = model.dag(spark, sf_dir)
    nodes, kept = graph.delete_nodes(_nodes(edges), edges, _ids(spark, "n3", "s1"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(kept.agg(F.count("*").alias("edges")))


def containing_symbol(spark, sf_dir):
    """Order lines as references on a line, customers' accounts as spans of lines in a file for each nation."""
    refs = model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("file"), F.round("s_acctbal").cast("long").alias("line"))
    c = model.table(spark, sf_dir, "customer")
    spans = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("file"), F.round("c_acctbal").cast("long").alias("start"), (F.round("c_acctbal") + F.col("c_custkey") % 500).cast("long").alias("end"))
    return graph.containers(refs, spans)


QUERIES = {f.__name__: f for f in (callers, callees, impact_depth, risk_levels, call_chain, cycles, strong_components, weak_components, unused, orphans, hot, deps_by_type, relation_stats, subgraph, simple_paths, degree_stats, coupled, delete_cascade, containing_symbol)}

_REACH = """reach AS (SELECT src, dst FROM edges UNION SELECT reach.src, edges.dst FROM reach JOIN edges ON reach.dst = edges.src)"""
_NODES = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
ORACLE = {
    "callers": f"WITH {DAG} SELECT * FROM edges WHERE dst IN ('n3', 'c7')",
    "callees": f"WITH {DAG} SELECT * FROM edges WHERE src IN ('c7', 'p12', 's3')",
    "impact_depth": f"WITH RECURSIVE {DAG}, w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT src, depth + 1 FROM w JOIN edges ON dst = id WHERE depth < 4) SELECT id, min(depth) AS depth FROM w WHERE depth > 0 AND id <> 'r1' GROUP BY id",
    "risk_levels": f"WITH {DAG} SELECT dst AS id, count(*) AS direct, CASE WHEN count(*) <= 5 THEN 'low' WHEN count(*) <= 20 THEN 'medium' WHEN count(*) <= 50 THEN 'high' ELSE 'critical' END AS risk FROM edges GROUP BY dst",
    "call_chain": f"""WITH RECURSIVE {DAG}, w AS (SELECT 'p12' AS tip, ['p12'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN edges ON src = tip WHERE len(path) <= 4),
        b AS (SELECT tip, path, row_number() OVER (PARTITION BY tip ORDER BY len(path), path) AS n FROM w WHERE tip LIKE 'r%') SELECT tip AS id, len(path) - 1 AS hops, array_to_string(path, '>') AS path FROM b WHERE n = 1""",
    "cycles": f"WITH RECURSIVE {TRADE}, {_REACH} SELECT least(a.src, min(a.dst)) AS component, a.src AS id FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src",
    "strong_components": f"WITH RECURSIVE {TRADE}, {_REACH}, {_NODES}, c AS (SELECT id, least(id, coalesce(min(a.dst), id)) AS c FROM nodes LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON id = a.src GROUP BY id), k AS (SELECT c, count(*) AS nodes FROM c GROUP BY c) SELECT nodes, count(*) AS components FROM k GROUP BY nodes",
    "weak_components": f"""WITH RECURSIVE {DAG}, e AS (SELECT src, dst FROM edges WHERE relation <> 'supplied_by' AND dst <> 'r1'), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS id FROM u),
        top AS (SELECT DISTINCT id FROM n WHERE id LIKE 'r%' OR id LIKE 'n%'), w AS (SELECT id, id AS root FROM top UNION SELECT u.dst, w.root FROM w JOIN u ON u.src = w.id),
        l AS (SELECT id, min(root) AS r FROM w GROUP BY id), f AS (SELECT id, r, min(id) OVER (PARTITION BY r) AS component FROM l) SELECT component, count(*) AS nodes FROM f GROUP BY component""",
    "unused": f"WITH {DAG}, {_NODES} SELECT substring(id, 1, 1) AS kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT dst FROM edges) GROUP BY 1",
    "orphans": f"WITH {DAG}, e AS (SELECT * FROM edges WHERE relation IN ('child_of', 'supplied_by')), a AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part) SELECT id FROM a WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)",
    "hot": f"WITH {DAG} SELECT dst AS id, count(*) AS \"references\" FROM edges GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 25",
    "deps_by_type": f"WITH {DAG} SELECT * FROM edges WHERE relation = 'located_in'",
    "relation_stats": f"WITH {DAG} SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY relation",
    "subgraph": f"WITH RECURSIVE {DAG}, w AS (SELECT unnest(['o1', 'p12']) AS id, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN edges ON src = id WHERE d < 2) SELECT * FROM edges WHERE src IN (SELECT id FROM w)",
    "simple_paths": f"""WITH RECURSIVE {TRADE}, m AS (SELECT src, dst FROM edges WHERE src <> dst ORDER BY n DESC, src DESC, dst DESC LIMIT 1),
        w AS (SELECT src AS tip, [src] AS path FROM m UNION ALL SELECT edges.dst, list_append(path, edges.dst) FROM w JOIN edges ON edges.src = tip WHERE len(path) <= 4 AND NOT list_contains(path, edges.dst) AND tip <> (SELECT dst FROM m))
        SELECT array_to_string(path, '>') AS path, len(path) AS length FROM w WHERE tip = (SELECT dst FROM m) AND len(path) > 1""",
    "degree_stats": f"WITH {DAG}, {_NODES} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM nodes",
    "coupled": f"WITH {DAG}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) SELECT id, count(*) AS edges FROM e GROUP BY id HAVING count(*) > 40",
    "delete_cascade": f"WITH {DAG}, {_NODES} SELECT (SELECT count(*) FROM nodes WHERE id NOT IN ('n3', 's1')) AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN ('n3', 's1') AND dst NOT IN ('n3', 's1')) AS edges",
    "containing_symbol": """WITH r AS (SELECT s_suppkey AS ref, s_nationkey AS file, round(s_acctbal)::BIGINT AS line FROM supplier),
        s AS (SELECT c_custkey AS id, c_nationkey AS file, round(c_acctbal)::BIGINT AS a, round(c_acctbal)::BIGINT + c_custkey % 500 AS b FROM customer),
        m AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY b - a, id) AS n FROM r JOIN s ON r.file = s.file AND line BETWEEN a AND b)
        SELECT r.ref, file, line, m.id AS container FROM r LEFT JOIN m ON r.ref = m.ref AND n = 1""",
}
