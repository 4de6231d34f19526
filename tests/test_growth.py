"""Rows that are many to a key, against plain programs; each of these took work or memory by pairs before."""

import random

from lodestone.operators import graph, stats, symbols, tables
from lodestone.plans import registry
from lodestone.sources import code
from pyspark.sql import functions as F


def test_containers_of_many_spans_on_a_line(spark):
    rng = random.Random(5)
    spans = [(i, rng.choice("ab"), s := rng.randint(-40, 300), s + rng.choice([-1, 0, 1, 5, 63, 200, 100_000])) for i in range(800)] + [(900, None, 0, 9), (901, "a", None, 9)]
    refs = [(i, rng.choice("abc"), rng.randint(-60, 500)) for i in range(600)] + [(700, "a", None), (701, None, 5)]
    want = {r: min(((e - s, i) for i, g, s, e in spans if g == f and None not in (g, s, x) and s <= x <= e), default=(0, None))[1] for r, f, x in refs}
    made = graph.containers(spark.createDataFrame(refs, "ref long, file string, line int"), spark.createDataFrame(spans, "id long, file string, start int, end int"))
    assert made.columns == ["ref", "file", "line", "container"]
    assert {r["ref"]: r["container"] for r in made.collect()} == want


def test_parents_by_a_plain_program(spark):
    rng = random.Random(6)
    spans = [(i, rng.choice("ab"), s := rng.randint(-30, 120), s + rng.choice([-2, 0, 1, 2, 3, 9, 40, 80])) for i in range(700)] + [(900, None, 0, 9), (901, None, 1, 8), (902, "a", None, 3)]
    want = {}
    for x, f, s, e in spans:
        held = [(b - a, -p, p) for p, g, a, b in spans if g == f and None not in (f, s, a) and a <= s and e <= b and (b - a > e - s or b - a == e - s and p < x)]
        want[x] = min(held)[2] if held else None
    made = symbols.parents(spark.createDataFrame(spans, "id long, file string, start int, end int"))
    assert {r["id"]: r["parent"] for r in made.collect()} == want


def test_parents_pair_no_spans(spark):
    """20,000 nested spans of one file: their pairs would be 200 million rows."""
    n = 20_000
    made = symbols.parents(spark.range(n).selectExpr("id", "'f' AS file", "id AS start", f"{2 * n} - id AS `end`"))
    assert made.filter("parent = id - 1").count() == n - 1 and made.filter("parent is null").select("id").collect() == [(0,)]


def test_nearest_keys_by_a_plain_program(spark):
    """60,000 keys in few partitions: a window that ends unbounded takes a look at all pairs."""
    table = spark.range(0, 60_000, 7).selectExpr("id AS key").unionByName(spark.range(2).selectExpr("cast(null AS bigint) AS key"))
    asked = spark.range(-3, 60_010).selectExpr("id AS key").unionByName(spark.range(1).selectExpr("cast(null AS bigint) AS key"))
    last = 60_000 // 7 * 7
    plain = lambda k: (k, None, None) if k is None else (k, None if k < 0 else min(k // 7 * 7, last), 0 if k < 0 else None if k > last else -(-k // 7) * 7)
    made = {(r["key"], r["below"], r["above"]) for r in tables.nearest_keys(table, asked).collect()}
    assert made == {plain(k) for k in [*range(-3, 60_010), None]}


def _sources(spark, n):
    """Sources as one task of a small file would give them, each called twice on one line, and one file twice."""
    text = "fn a(x: &str) -> Kind { b(x); b(x) }\nfn b(x: &str) {}\n"
    return spark.createDataFrame([(f"src/p{i}.rs", text) for i in range(n)] + [("src/p0.rs", text)], "path string, content string").coalesce(1)


def test_sources_are_read_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for read in (code.symbols, code.references, code.imports):
            made = read(_sources(spark, 300).withColumn("content", F.concat(F.lit("use a::b;\n"), "content")))
            assert made.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_references_come_once_without_an_aggregate(spark):
    made = code.references(_sources(spark, 3))
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    rows = [(r["path"], r["name"], r["line"]) for r in made.collect()]
    assert sorted(rows) == sorted((f"src/p{i}.rs", n, 1) for i in range(3) for n in ("b", "Kind")) and made.select("ref").distinct().count() == 6


def test_graph_of_sources_broadcasts_no_sources(spark):
    """Estimates of what a reader gives are of the files before it; edges are as from each file read on its own."""
    _, edges = code.code_graph(_sources(spark, 40).withColumn("content", F.concat(F.lit("use crate::p1::b;\n"), "content")))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan and "BuildLeft" not in plan
    assert edges.count() == 40 and edges.select("dst", "relation").distinct().count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruned_jobs_need_no_order_of_all(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["F", "O", None]), rng.choice([None, *range(60)])) for i in range(400)]
    jobs = spark.createDataFrame(rows, "id long, status string, updated int")
    for most in (0, 40, 250, 390, 1000):
        kept = sorted((r for r in rows if not (r[1] == "F" and (r[2] is None or r[2] < 20)) and not (r[1] is None and (r[2] is None or r[2] < 20))), key=lambda r: (r[1] != "F", r[2] is None, r[2] or 0, r[0]))
        want = {r[0] for n, r in enumerate(kept, 1) if r[1] == "O" or n > len(kept) - most}
        made = stats.prune_jobs(jobs, F.col("status") == "F", "updated", F.lit(20), most)
        assert "Window" not in _plan(made) and {r["id"] for r in made.collect()} == want


def test_counts_keep_no_registers_a_value(spark, sf):
    assert "Expand" not in _plan(registry.queries()["distinct_counts"](spark, sf))


def test_statistics_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string").coalesce(1).mapInArrow(count, "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert tuple(graph.graph_stats(nodes, edges).first())[:2] == (3, 3) and made.value == 3
