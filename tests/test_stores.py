"""Stores, the parser over tokens, query routing and streams that fold, by hand-made cases."""

from datetime import datetime, timedelta

import pytest
from lodestone.functions import paths
from lodestone.operators import rerank, search, stats, tables, vector
from lodestone.plans import registry
from lodestone.sources import code, repository, stores
from lodestone.sources.lexer import Tokens
from lodestone.streaming import streams
from oracle import connect
from pyspark.sql import functions as F


def _docs(spark, rows):
    return spark.createDataFrame([(i, f"src/f{i}.md", f"f{i}.md", t, ["en"] if i % 2 else ["fr"], len(t), datetime(2024, 1, 1) + timedelta(days=i)) for i, t in rows], "id long, path string, title string, content string, tags array<string>, size long, updated_at timestamp_ntz")


def test_written_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = _docs(spark, [(i, "the quick brown fox " * (i % 5) + "jumps over the lazy dog " * (i % 3) + "ab") for i in range(40)])
    root = f"file://{tmp_path}/index"
    assert not stores.exists(spark, root)
    search.write_index(docs, root, 8)
    assert stores.exists(spark, root)
    for query in ("quick fox", "lazy", "the the", "zzqx", "ab", ""):
        assert search.search_index(spark, root, query, 12).collect() == search.text_search(docs, query, 12).collect()
    plan = stores.read_keyed(spark, root, "fox")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan or "PartitionFilters: [_bucket" in plan


def test_store_is_built_once_for_its_files(spark, tmp_path):
    at, built = f"{tmp_path}/in.parquet", []
    spark.range(3).write.parquet(at)

    def build(root):
        built.append(root)
        stores.write_keyed(spark.read.parquet(at), root, "id", buckets=2)

    first = stores.stored(spark, "numbers", [at], build)
    assert stores.stored(spark, "numbers", [at], build) == first and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(at)
    second = stores.stored(spark, "numbers", [at], build)
    assert second != first and sorted(r["id"] for r in stores.read_keyed(spark, second).collect()) == [0, 1, 2, 3, 4]
    assert [r["id"] for r in stores.read_keyed(spark, second, 3, 99).collect()] == [3]


def test_unfinished_versions_are_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    stores.save_graph(nodes, edges, root)
    broken = edges.withColumn("dst", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        stores.save_graph(nodes.limit(0), broken, root)
    n, e = stores.load_graph(spark, root)
    assert n.count() == 2 and e.count() == 1
    tables.write_version(nodes.limit(0), f"{root}/empty")
    assert tables.read_version(spark, f"{root}/empty").columns == ["id"]


def test_metadata_files(spark, tmp_path):
    one = tmp_path / "deep"
    one.mkdir()
    (one / "a.json").write_text('{"id": "a", "file_path": "./a.md", "size": 3, "created": 10, "updated": 11, "hash": [0, 255, 16]}')
    (one / "b.json").write_text("not json")
    (one / "c.txt").write_text("{}")
    (row,) = stores.read_metadata(spark, f"file://{tmp_path}").collect()
    assert (row["id"], row["path"], row["size"], row["sha256"]) == ("a", "./a.md", 3, "00ff10")


RUST = """use std::collections::{HashMap, hash_map::Entry as E};
use crate::shapes::*;
/* outer /* inner } */ fn no() {} */
pub(crate) struct Area<T: Clone> { side: Vec<T> }
impl<T: Clone> Shape for Area<T> where T: Copy {
    pub async fn total(&self, c: char) -> f64 {
        let s = r#"} fn no() { "#;
        if c == '{' || c == '\\'' { helper::<u8>(1); }
        self.side.iter().map(|v| v + 1);
        Area::build(s); println!("{}", s);
        0.0
    }
}
mod inner { fn deep<'a>(x: &'a str) { fn deeper() {} } }
"""
SCRIPT = """import base, { a } from './m';
export class View extends Base<Item> {
  static async load(id: string): Promise<View> { return fetch(`/v/${name({a: 1})}}`) }
  handler = (e) => { this.load(e) };
}
const half = (x: number) => x / 2;
let re = /function no() {}/g; // class No {}
function* gen() { yield half(1) }
"""


def test_rust_by_tokens():
    made = {(n, k, v, a, b, p) for n, k, v, a, b, _, p, _ in code.parse("a.rs", RUST)}
    assert made == {
        ("std::collections", "import", "private", 1, 1, None), ("crate::shapes", "import", "private", 2, 2, None), ("Area", "struct", "internal", 4, 4, None), ("total", "method", "public", 6, 12, "Area"),
        ("inner", "module", "private", 14, 14, None), ("deep", "function", "private", 14, 14, "inner"), ("deeper", "function", "private", 14, 14, "inner::deep"),
    }
    refs = {(n, k) for n, k, *_ in code.reference_lines("a.rs", RUST)}
    assert {("helper", "turbofish_call"), ("iter", "method_call"), ("map", "chained_method_call"), ("Area::build", "static_method_call"), ("println", "macro_invocation"), ("Shape", "trait_impl"), ("Vec", "type_usage")} <= refs
    assert not {n for n, _ in refs} & {"no", "total", "if"}
    assert sorted(code.import_rows("a.rs", RUST), key=str) == sorted([("std::collections", ["HashMap"], None, False, 1), ("std::collections::hash_map::Entry", [], "E", False, 1), ("crate::shapes", [], None, True, 2)], key=str)
    assert code.stat_row("a.rs", RUST)[0][3] == 0 and code.stat_row("a.rs", RUST[:-3])[0][3] == 1


def test_scripts_by_tokens():
    made = {(n, k, a, b, p) for n, k, _, a, b, _, p, _ in code.parse("a.ts", SCRIPT)}
    assert made == {("./m", "import", 1, 1, None), ("View", "class", 2, 5, None), ("load", "method", 3, 3, "View"), ("handler", "method", 4, 4, "View"), ("half", "function", 6, 6, None), ("gen", "function", 8, 8, None)}
    refs = {(n, k) for n, k, *_ in code.reference_lines("a.ts", SCRIPT)}
    assert {("fetch", "function_call"), ("name", "function_call"), ("load", "method_call"), ("half", "function_call"), ("Base", "inheritance")} <= refs and not {n for n, _ in refs} & {"no", "No", "gen"}
    assert code.import_rows("a.ts", SCRIPT) == [("./m", ["base", "a"], None, False, 1)]


@pytest.mark.parametrize("text", ["", "fn", "impl", "use", "use ::{", "fn a(", "class {", "const = =>", "import", "`${", "'", '"', "/*", "r#\"", "struct A<", "}}}", "export default", "type X", "(" * 500])
def test_broken_code(text):
    for path in ("a.rs", "a.ts", "a.py", "a.txt"):
        code.parse(path, text), code.reference_lines(path, text), code.import_rows(path, text), code.stat_row(path, text)
    assert Tokens(text, True).errors >= 0


def test_edges_by_imports(spark):
    files = spark.createDataFrame([("lib.py", "def go():\n    pass\n"), ("use.py", "from lib import go as run\n\n\ndef main():\n    run()\n"), ("app/m.ts", "export const half = (x) => x\n"), ("app/v.ts", "import * as tools from './m'\nfunction start() { half(2) }\nimport { half } from './m'\n"), ("src/shapes.rs", "pub fn area() {}\n"), ("other/shapes.rs", "pub fn area() {}\n"), ("src/main.rs", "use crate::shapes::area as size;\nfn top() { size(); }\n")], "path string, content string")
    nodes, edges = code.code_graph(files)
    names = {r["id"]: r["name"] for r in nodes.collect()}
    assert {(names[r["src"]], names[r["dst"]]) for r in edges.collect()} == {("main", "go"), ("start", "half"), ("top", "area")}


def test_ingest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn one() { two(); }\nfn two() {}\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0")
    made = stores.ingest(spark, repository.files(spark, f"file://{tmp_path}/src"), "demo", f"file://{tmp_path}/out")
    assert (made["documents"].count(), made["symbols"].count(), made["edges"].count()) == (2, 2, 1)


def test_built_queries(spark):
    docs = _docs(spark, [(i, "alpha beta gamma" if i < 8 else "delta") for i in range(12)])
    assert search.Query.of("src/*").pattern == "src/*" and search.Query.of("beta").text == "beta"
    ids = lambda q: [r["id"] for r in q.run(docs).collect()]
    assert ids(search.Query.of("src/f1*", limit=2, offset=1)) == [10, 11]
    assert ids(search.Query.of("beta", tags=("en",), since="2024-01-03", limit=2, offset=1)) == [5, 7]
    for bad in ({"limit": 0}, {"limit": 10**6}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.Query.of("x", **bad)
    kind, made = search.search_content(docs, search.Query.of("beta", context="medium"), F.lit("2024-02-01").cast("date"))
    assert kind == "optimized" and made.count() == 8 and {"id", "snippet", "tokens"} <= set(made.columns)


def test_weights_and_dimensions(spark):
    with pytest.raises(ValueError):
        vector.check_weights(0.5, 0.6)
    vector.check_weights(0.7, 0.305)
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    kept, refused = vector.insert(v, spark.createDataFrame([(2, [9.0, 9.0]), (3, [1.0]), (4, None), (None, [1.0, 1.0])], "id long, v array<double>"), 2)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, [1.0, 2.0]), (2, [9.0, 9.0])] and refused.count() == 3


def test_advice(spark):
    q = spark.range(1).select(rerank.suggestions(F.lit("an Error in tests"), F.lit(0)).alias("s"), rerank.warnings(F.lit(9), 5, F.lit(50)).alias("w")).first()
    assert len(q["s"]) == 6 and q["w"][0].startswith("Results exceed token budget (9 > 5)") and len(q["w"]) == 2


@pytest.mark.parametrize(("a", "b", "same"), [("./a//b/", "a/b", True), ("x/a/b", "a/b", True), ("xa/b", "a/b", False), ("a\\b", "a/b", True), ("b", "a/b", True), ("c", "a/b", False)])
def test_same_paths(spark, a, b, same):
    assert spark.range(1).select(paths.same_path(F.lit(a), F.lit(b)).alias("x")).first()["x"] is same


def test_flushes_by_hand(spark):
    t = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    rows = [(i, 1, t(ms), n) for i, (ms, n) in enumerate([(0, 1), (10, 1), (20, 1), (30, 1), (90, 1), (139, 1), (140, 9), (141, 1), (500, 1)])] + [(20, 2, t(0), 100), (21, 2, t(1), 1)]
    made = {r["id"]: r["flush"] for r in stats.flushes(spark.createDataFrame(rows, "id long, key long, ts timestamp, size long"), "key", "ts", "size", 3, 10, 50).collect()}
    assert made == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 20: 0, 21: 1}


def test_nearest_keys_over_partitions(spark):
    held = spark.createDataFrame([(k,) for k in range(0, 1000, 50)], "key long").repartition(7)
    asked = spark.createDataFrame([(k,) for k in (-5, 0, 1, 49, 50, 777, 950, 2000)], "key long")
    made = {r["key"]: (r["below"], r["above"]) for r in tables.nearest_keys(held, asked).collect()}
    assert made == {-5: (None, 0), 0: (0, 0), 1: (0, 50), 49: (0, 50), 50: (50, 50), 777: (750, 800), 950: (950, 950), 2000: (950, None)}


def test_renames(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "path string, n int")
    moves = spark.createDataFrame([("a", "b"), ("c", "d")], "path string, to string")
    assert sorted(tuple(r) for r in tables.renamed(v, moves).select("path", "n", "renamed_from").collect()) == [("b", 1, "a"), ("b", 2, "a"), ("d", 4, "c")]


def test_folds_and_heartbeats(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    at = f"{tmp_path}/in"
    for n, rows in enumerate(([(1, "a", t(0)), (2, "a", t(1))], [(1, "b", t(5)), (3, "a", t(200))])):
        spark.createDataFrame(rows, "id long, x string, ts timestamp").coalesce(1).write.mode("append").parquet(at)
    kind = "id long, x string, ts timestamp"
    stream = streams.buffered(spark, kind, at, files=1)
    made = streams.folded(stream, f"file://{tmp_path}/fold", spark.createDataFrame([], kind), lambda table, batch: tables.upsert(table, batch, "ts"))
    assert sorted((r["id"], r["x"]) for r in made.collect()) == [(1, "b"), (2, "a"), (3, "a")]
    stale = streams.collected(streams.stale_jobs(streams.buffered(spark, kind, at, files=1), "id", "ts", 45), "update", f"file://{tmp_path}/stale").collect()
    assert {r["id"] for r in stale} == {1, 2}


def _stale(spark, sf, con):
    """Rows of the query and of its SQL as they are; oracle.rows keeps nine digits of a number, too few for milliseconds."""
    made = [tuple(r) for r in registry.queries()["stale_heartbeats"](spark, sf).collect()]
    return sorted(made, key=str), sorted(con.execute(registry.oracle_sql()["stale_heartbeats"]).fetchall(), key=str)


def test_stale_heartbeats_to_the_millisecond(spark, sf):
    made, want = _stale(spark, sf, connect(sf))
    assert want and made == want


_NEWEST, _HOUR = 1_706_640_381_466_500, 3_600_000_000
_BOUND = (_NEWEST + 500) - 60_000_000 - 12 * _HOUR
_YEAR = 365 * 24 * _HOUR


@pytest.mark.parametrize(
    "beats",
    [
        [(1, _NEWEST)] + [(2 + n, _BOUND + us) for n, us in enumerate((-1501, -1500, -1000, -501, -500, 0))],
        [(1, _NEWEST), (2, None), (3, _NEWEST - 24 * _HOUR), (3, None), (None, _NEWEST - 24 * _HOUR - 500)],
        [(1, 5), (2, -36 * _HOUR), (3, -24 * _HOUR - 500), (4, -_HOUR)],
        [(1, _NEWEST), (2, _NEWEST - 400 * _YEAR), (3, _NEWEST + 400 * _YEAR), (4, -_HOUR)],
        [],
    ],
    ids=["bound", "nulls", "before_1970", "centuries", "none"],
)
def test_stale_heartbeats_of_any_time(spark, tmp_path, beats):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for n, (key, us) in enumerate(beats):
        con.execute("INSERT INTO events SELECT ?, make_timestamp(?::BIGINT), ?, 'x', 1.0, '{}'", [n, us, key])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    made, want = _stale(spark, str(tmp_path), con)
    assert bool(want) == bool(beats) and made == want
