"""Operators by hand-made cases."""

import pytest
from lodestone.functions import filters, paths, sanitize, text
from lodestone.operators import graph, search, symbols, tables, vector
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "pattern", "match"),
    [("a/b.rs", "*", True), ("a/b.rs", "*.rs", True), ("a/b.rs", "*.py", False), ("a/b.rs", "a/*", True), ("a/b.rs", "b*", False), ("a/b.rs", "a*rs", True), ("a", "a*a", True), ("abc", "ab", True), ("abc", "bc", False), ("src/x/y.rs", "src/*/*.rs", True), ("axbxc", "a*b*c", True), ("ac", "a*b*c", False), ("bab", "*a*b", True), ("", "a*", False), ("x**y", "x*y", True), ("Ab", "ab", False)],
)
def test_wildcards(spark, path, pattern, match):
    assert one(spark, paths.wildcard(F.col("p"), pattern), p=path) is match


@pytest.mark.parametrize("t", ["", "ab", "abc", "aXb c", "日本語テスト", "a--", "---", "abcdefghijklmnopqrstuvwxyz"])
def test_trigrams(spark, t):
    low = t.lower()
    want = [w for w in (low[i : i + 3] for i in range(len(low) - 2)) if any(map(str.isalnum, w))]
    assert one(spark, text.trigrams(F.col("t")), t=t) == want == text.query_trigrams(t)


def test_thresholds():
    assert [search.threshold(n) for n in (1, 3, 4, 5, 6, 7, 8, 10)] == [1, 3, 3, 4, 5, 4, 4, 6]
    assert [search.set_threshold(n, "abc") for n in (1, 3, 4, 5, 6, 7, 8, 10)] == [1, 3, 4, 4, 5, 5, 5, 6]
    assert search.set_threshold(10, "abcdefghijkl") == 9
    assert search.relaxed_thresholds(3) == [3, 2, 1]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("select name", "select name"), ("x'; DROP TABLE users", "x TABLE users"), ("x DROP TABLE users", "x users"), ("a | b && c", "a b c"), ("../../etc/passwd", "etc/passwd"), ("<script>alert</script> fn", "alert fn"), ("123 ***", None), ("*", "*"), ("test*", "test*"), ("fn  main\t()", "fn main"), ("", None), ("x" * 101, None)],
)
def test_sanitize(spark, raw, clean):
    made = one(spark, sanitize.sanitized(F.col("q")), q=raw)
    assert (made or "").split() == (clean or "").replace(">", " ").split()


def test_length_factor_has_its_pole(spark):
    f = lambda n, safe=False: one(spark, search.length_factor(F.col("n"), safe), n=n)
    assert f(0) == 1.0 and f(100) == 1.0 and f(36) < 0 < f(37) and f(37) > 100 and f(36, True) == 1.0


def _edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, relation string")


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_graph_shapes(spark):
    e = _edges(spark, "ab", "bc", "cd", "ax", "xd", "ef", "fe", "gg", "ab")
    depth = {r["id"]: r["depth"] for r in graph.reachable(e, _ids(spark, "a"), 5).collect()}
    assert depth == {"b": 1, "x": 1, "c": 2, "d": 2}
    assert {r["id"] for r in graph.impact(e, _ids(spark, "d"), 5).collect()} == {"a", "b", "c", "x"}
    assert graph.call_chain(e, _ids(spark, "a"), _ids(spark, "d")).first()["path"] == ["a", "x", "d"]
    assert sorted(r["path"] for r in graph.simple_paths(e, _ids(spark, "a"), _ids(spark, "d"), 4).collect()) == [["a", "b", "c", "d"], ["a", "x", "d"]]
    assert {(r["component"], r["id"]) for r in graph.cycles(e).collect()} == {("e", "e"), ("e", "f")}
    strong = graph.strong_components(e).groupBy("component").count().filter("count > 1").collect()
    assert [(r["component"], r["count"]) for r in strong] == [("f", 2)]
    nodes = _ids(spark, *"abcdefgx", "lone")
    weak = {r["id"]: r["component"] for r in graph.weak_components(nodes, e).collect()}
    assert weak == dict.fromkeys("abcdx", "a") | dict.fromkeys("ef", "e") | {"g": "g", "lone": "lone"}
    assert [r["id"] for r in graph.orphans(nodes, e).collect()] == ["lone"]
    assert {r["id"] for r in graph.unused(nodes, e).collect()} == {"a", "lone"}


def test_reference_resolution(spark):
    names = spark.createDataFrame([(1, "m::go"), (2, "longer::m::go"), (3, "go")], "id long, qualified string")
    refs = spark.createDataFrame([(1, "go"), (2, "m::go"), (3, "none")], "ref long, name string")
    assert {r["ref"]: (r["target"], r["how"]) for r in graph.resolve(refs, names).collect()} == {1: (3, "exact"), 2: (1, "exact"), 3: (None, None)}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1, 0.0])], "id long, v array<double>")
    assert [r["id"] for r in vector.knn(v, q, 3).collect()] == [1, 2, 3]
    made = v.filter("id = 1").select(vector.interpolate(F.col("v"), 5).alias("i"), vector.repeat(F.col("v"), 5).alias("r"), vector.pad(F.col("v"), 5).alias("p"), F.size(vector.standard(F.col("v"))).alias("n")).first()
    assert made["i"] == [1.0, 0.5, 0.0, 0.0, 0.0] and made["r"] == [1.0, 0.0, 0.0, 1.0, 0.0] and made["p"] == [1.0, 0.0, 0.0, 0.0, 0.0] and made["n"] == 1536


def test_versions_and_changes(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    tables.write_version(a, root)
    tables.write_version(tables.insert(tables.read_version(spark, root), spark.createDataFrame([(2, "z"), (3, "c")], "id long, path string")), root)
    assert sorted(tuple(r) for r in tables.read_version(spark, root).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_filter_language(spark):
    d = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"]), (3, None, ["x", "y"])], "id long, n string, tags array<string>")
    ids = lambda spec: [r["id"] for r in d.filter(filters.compile_filter(spec)).orderBy("id").collect()]
    assert ids({"id": {"$gte": 2}}) == [2, 3] and ids({"$or": [{"n": "a"}, {"n": {"$exists": False}}]}) == [1, 3]
    assert ids({"$not": {"id": {"$in": [1]}}, "tags": {"$contains": ["x"]}}) == [3] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.compile_filter({"id": {"$near": 1}})
    assert one(spark, filters.intent(F.col("t")), t="Who calls main?") == "callers"


def test_symbol_helpers(spark):
    assert one(spark, symbols.import_target(F.col("t")), t="use crate::a::b;") == "crate"
    assert one(spark, symbols.import_target(F.col("t")), t="import x from './y'") == "./y"
    assert one(spark, symbols.import_target(F.col("t")), t="let a = 1") is None
    assert one(spark, symbols.import_target(F.col("t")), t="import os.path as p") == "os.path"
    assert one(spark, symbols.import_target(F.col("t")), t='import "./side.js";') == "./side.js"
    assert one(spark, symbols.import_target(F.col("t")), t="from a.b import c") == "a.b"
    assert one(spark, symbols.simple_reference(F.col("t")), t="  let x = (*self.go(1)") is None
    assert one(spark, symbols.simple_reference(F.col("t")), t="  let x = &self.go(1)") == "self.go"
    body = "pub fn f(x: &str) -> Map<K> {\n  // skip(1)\n  let y: Thing = make(2);\n  println!(1);\n}"
    assert one(spark, symbols.text_dependencies(F.col("t")), t=body) == ["Map", "Thing", "f", "make", "println"]


@pytest.mark.parametrize(("raw", "made"), [("src/*.rs", "src/*.rs"), ("a | b", "a b"), ("a/b | c", "a/b | c"), ("../up", "../up"), ("<x>", "x"), ("   ", "*"), ("y" * 1025, None)])
def test_path_aware(spark, raw, made):
    assert one(spark, sanitize.path_aware(F.col("q")), q=raw) == made


def test_relation_names(spark):
    assert one(spark, graph.relation_of(F.col("t"), True), t="async_call") == "awaits" and one(spark, graph.relation_of(F.col("t")), t="?") == "references"
    assert one(spark, graph.caller_verb(F.col("t")), t="uses_type") == "Uses" and one(spark, graph.impact_label(F.col("t")), t="odd") == "Custom Relationship Impact (odd)"
    assert one(spark, paths.is_entry_point(F.col("n"), F.col("k")), n="App::new", k="Function") and not one(spark, paths.is_entry_point(F.col("n"), F.col("k")), n="main", k="class")


def test_names_have_similarity(spark):
    assert one(spark, symbols.name_similarity(F.col("a"), F.col("b")), a="parse", b="parser") == pytest.approx(5 / 6 + 0.3 if 5 / 6 + 0.3 < 1 else 1.0)


def test_definitions_around_matches():
    from lodestone.operators import definitions as D

    text = "use x;\n\npub fn one() {\n    let s = \"}\";\n    target();\n}\n\n// fn no {\nstruct Two {\n    target: u8,\n}\ntarget outside\n"
    assert D.definitions(text, "target") == "// Lines 3-6\n" + "\n".join(text.split("\n")[2:6]) + D.BETWEEN + "// Lines 9-11\nstruct Two {\n    target: u8,\n}" + D.BETWEEN + "// Lines 9-11\nstruct Two {\n    target: u8,\n}"
    assert D.definitions(text, "nothing") is None and D.definitions("a target", "target") is None and D.definitions(None, "x") is None
    far = "fn f() {\n" + "    x();\n" * 200 + "}\n"
    assert D.definitions("fn f() {\n" + "a\n" * 40 + "target\n}", "target") is None and D.definitions(far, "fn f").startswith("// Lines 1-101\n")


def test_match_locations(spark):
    from lodestone.operators import definitions as D

    made = [tuple(m)[:3] for m in one(spark, D.match_locations(F.col("t"), "a.b c"), t="x A.B c a.b")]
    assert made == [("exact", 2, 7), ("term", 2, 5), ("term", 8, 11), ("term", 6, 7)]
    many = one(spark, D.match_locations(F.col("t"), "q z"), t="q " * 30 + "z z")
    assert [m["kind"] for m in many] == ["exact"] + ["term"] * 11 and many[-1]["context"].startswith("...q")
