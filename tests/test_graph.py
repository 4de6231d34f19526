"""Graph operators against plain programs: deep, cyclic, skewed and random graphs."""

import random
from collections import defaultdict, deque

import pytest
from lodestone.operators import graph, symbols


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, relation string")


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _distances(pairs, start):
    out, seen, todo = defaultdict(set), {start: 0}, deque([start])
    for a, b in pairs:
        out[a].add(b)
    while todo:
        x = todo.popleft()
        for y in out[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def _strong(pairs):
    """The strong component of each node, by mutual reach."""
    nodes = {x for p in pairs for x in p}
    reach = {x: set(_distances(pairs, x)) for x in nodes}
    return {x: frozenset(y for y in reach[x] if x in reach[y]) for x in nodes}


def test_long_cycle_and_long_chain(spark):
    """A cycle of 200 edges, a chain of 30 into it, and a cycle of 70 behind it."""
    ring = [(f"r{i:03}", f"r{(i + 1) % 200:03}") for i in range(200)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("c30", "r000")]
    behind = [("r100", "z00")] + [(f"z{i:02}", f"z{(i + 1) % 70:02}") for i in range(70)]
    e = _edges(spark, ring + chain + behind)
    made = defaultdict(set)
    for r in graph.cycles(e).collect():
        made[r["component"]].add(r["id"])
    assert made == {"r000": {f"r{i:03}" for i in range(200)}, "z00": {f"z{i:02}" for i in range(70)}}
    strong = {r["id"]: r["component"] for r in graph.strong_components(e).collect()}
    assert strong == {x: max(c) for x, c in _strong(ring + chain + behind).items()}


def test_call_chain_of_any_length(spark):
    pairs = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("c05", "x"), ("x", "c06"), ("c07", "c03")]
    e = _edges(spark, pairs)
    made = {r["id"]: (r["hops"], r["path"]) for r in graph.call_chain(e, _ids(spark, ["c00"]), _ids(spark, ["c30", "x", "nowhere"])).collect()}
    assert made == {"c30": (30, [f"c{i:02}" for i in range(31)]), "x": (6, [f"c{i:02}" for i in range(6)] + ["x"])}
    assert graph.call_chain(e, _ids(spark, ["c00"]), _ids(spark, ["c30"]), 29).count() == 0
    assert graph.call_chain(e, _ids(spark, ["c30"]), _ids(spark, ["c00"])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(24)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(26 + 8 * seed)]
    e, nodes = _edges(spark, pairs), _ids(spark, names)
    want = _strong(pairs)
    assert {r["id"]: r["component"] for r in graph.strong_components(e).collect()} == {x: max(c) for x, c in want.items()}
    assert {r["id"]: r["component"] for r in graph.cycles(e).collect()} == {x: min(c) for x, c in want.items() if len(c) > 1}
    aims = {b for _, b in pairs}
    far = lambda starts: max((d for s in starts for d in _distances(pairs, s).values()), default=0)
    assert graph.max_depth(nodes, e) == far([x for x in names if x not in aims])
    assert graph.max_depth(nodes, e, roots=False) == far(names)
    files = {x: f"f{int(x[1:]) % 5}" for x in names}
    row = graph.bridge_stats(spark.createDataFrame(list(files.items()), "id string, file string"), e).first()
    assert (row["nodes"], row["edges"], row["files"], row["imports"]) == (24, len(pairs), 5, sum(files[a] != files[b] for a, b in pairs))
    assert row["strong"] == len(set(want.values())) + len(set(names) - set(want)) and row["depth"] == far(names)


def test_containers_of_one_file(spark):
    """One file holds every span and every line; nested, equal, crossing and one-line spans."""
    rnd = random.Random(7)
    spans = [(i, "f" if i % 9 else "g", s := rnd.randint(-50, 3000), s + rnd.choice([0, 1, 2, 7, 8, 63, 64, 500, 3000])) for i in range(300)]
    refs = [(i, "f", rnd.randint(-60, 6200) if i % 50 else None) for i in range(400)]
    made = {r["ref"]: r["container"] for r in graph.containers(spark.createDataFrame(refs, "ref long, file string, line long"), spark.createDataFrame(spans, "id long, file string, start long, end long")).collect()}
    want = {ref: min(((e - s, i) for i, f, s, e in spans if f == file and line is not None and s <= line <= e), default=(0, None))[1] for ref, file, line in refs}
    assert made == want
    assert graph.containers(spark.createDataFrame(refs, "ref long, file string, line long"), spark.createDataFrame([], "id long, file string, start long, end long")).filter("container is null").count() == 400


def test_names_that_many_share(spark):
    """2,000 types with a method of one name and 2,000 references to it: work that multiplies both would be 4 million pairs."""
    names = spark.createDataFrame([(i, f"m::t{i:04}::new") for i in range(2000)] + [(5000, "n::new")], "id long, qualified string")
    refs = spark.createDataFrame([(i, "new") for i in range(2000)] + [(9000 + i, f"t{i:04}::new") for i in range(50)], "ref long, name string")
    made = {r["ref"]: (r["target"], r["how"]) for r in graph.resolve(refs, names).collect()}
    assert made == {i: (5000, "suffix") for i in range(2000)} | {9000 + i: (i, "suffix") for i in range(50)}


def test_names_by_imports(spark):
    names = spark.createDataFrame([(1, "a::b::Thing"), (2, "x::y::Other"), (3, "std::Vec"), (4, "deep::tests::Lone"), (5, "deeper::far::Lone"), (6, "a::b::Thing::go"), (7, "x::y::sub::go"), (8, "w::any"), (9, "Exact"), (10, "a::b::Exact")], "id long, qualified string")
    imports = spark.createDataFrame([("f", "a::b", ["Thing", "Exact"], None, False, 1), ("f", "x::y", [], "short", False, 2), ("f", "w::*", [], None, True, 3)], "file string, path string, items array<string>, alias string, wildcard boolean, line int")
    asked = {"Thing": 1, "Thing::go": 6, "short::Other": 2, "y::sub::go": 7, "any": 8, "Vec": 3, "Exact": 9, "Lone": 4, "none": None}
    refs = spark.createDataFrame([(i, "f", n) for i, n in enumerate(asked)] + [(100, "other", "Thing")], "ref int, file string, name string")
    made = {r["name"]: r["target"] for r in graph.resolve(refs.filter("ref < 100"), names, imports).collect()}
    assert made == asked
    avoiding = {r["name"]: r["target"] for r in graph.resolve(refs.filter("name = 'Lone'"), names, imports, avoid_tests=True).collect()}
    assert avoiding == {"Lone": 5}
    assert graph.resolve(refs.filter("ref = 100"), names, imports).first()["how"] == "suffix"


def test_inserts(spark):
    old = spark.createDataFrame([("a", "x", 5), ("b", "x", 1)], "id string, kind string, at int")
    new = spark.createDataFrame([("a", "y", 1), ("a", "z", 2), ("c", "w", 1)], "id string, kind string, at int")
    made = sorted(tuple(r) for r in graph.insert_nodes(old, new, "at").collect())
    assert made == [("a", "z", 2), ("b", "x", 1), ("c", "w", 1)]
    edges = _edges(spark, [("a", "b")])
    assert sorted((r["src"], r["dst"]) for r in graph.insert_edges(edges, _edges(spark, [("a", "b"), ("a", "nobody")]), old).collect()) == [("a", "b"), ("a", "b")]


def test_qualified_names_of_any_depth(spark):
    """Seventy levels of nesting in one file."""
    spans = spark.createDataFrame([(i, f"s{i}", "f", i, 200 - i) for i in range(70)], "id long, name string, file string, start long, end long")
    made = {r["id"]: r["qualified"] for r in symbols.qualified(symbols.parents(spans)).collect()}
    assert made == {i: "::".join(f"s{j}" for j in range(i + 1)) for i in range(70)}
