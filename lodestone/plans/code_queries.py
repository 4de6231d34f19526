r"""Symbols nested in files, lines of code, graph statistics and paths, embeddings, and changes to an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize, trigrams
from ..operators import definitions as D
from ..operators import graph, search, tables, vector
from ..operators import symbols as S
from ..sources import code
from ..sources.shared import cut
from . import model
from .graph_queries import _NODES, _ids, _nodes
from .model import DAG, DOCS, SYMBOLS, TRADE, VECTORS
from .rule_queries import _pick, _pick_sql

LINES = ("use {0}::inner::{1};", "import {0} from './{1}'", "from {0}.{1} import x", "import {0} as {1}", "let a = &self.{0}({1});", "  {1} = 1", "import './{0}.css'", "({0})")


def _words(spark, sf_dir):
    """Parts with two words of their names, a line and a body of code made of them."""
    p = model.table(spark, sf_dir, "part")
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    line = F.replace(F.replace(_pick(LINES, "p_partkey"), F.lit("{0}"), a), F.lit("{1}"), b)
    body = F.concat(F.lit("fn "), a, F.lit("(x: &str) -> "), F.initcap(b), F.lit(" {\n    // skip(1)\n    let y: Kind = "), b, F.lit("(x);\n    "), a, F.lit("!(y)\n    let n: Vec<u8> = 1;\n}"))
    return p.select(F.col("p_partkey").alias("id"), line.alias("line"), body.alias("body"))


def import_lines(spark, sf_dir):
    return _words(spark, sf_dir).select("id", S.import_target(F.col("line")).alias("module"))


def reference_lines(spark, sf_dir):
    return _words(spark, sf_dir).select("id", S.simple_reference(F.col("line")).alias("reference"), S.visibility(F.concat(_pick(("pub ", "", "pub(crate) "), "id"), F.lit("fn x()"))).alias("visibility"))


def text_dependencies(spark, sf_dir):
    return _words(spark, sf_dir).select("id", F.array_join(S.text_dependencies(F.col("body")), ",").alias("names"))


def _spans(spark, sf_dir):
    """Customers as symbols: a nation is a file, an account balance a line."""
    start = F.round("c_acctbal").cast("long")
    return model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), "c_custkey").alias("name"), F.col("c_nationkey").alias("file"), start.alias("start"), (start + F.col("c_custkey") * 37 % 900).alias("end"))


def nested_symbols(spark, sf_dir):
    return S.qualified(S.parents(_spans(spark, sf_dir))).select("id", "parent", "qualified")


def file_symbols(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter("file = 'Brand#11.rs'").select("id", "name", "type", "line")


def type_symbols(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter(F.col("type").isin("PROMO", "SMALL")).groupBy("type", "file").agg(F.count("*").alias("symbols"))


def any_term_symbols(spark, sf_dir):
    return S.any_term(model.symbols(spark, sf_dir), ["green", "blue", "ivory"], 60)


def file_replaced(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    new = s.filter("file = 'Brand#12.rs'").withColumn("file", F.lit("Brand#11.rs")).withColumn("id", F.col("id") + 1_000_000)
    return S.replace_file(s, "Brand#11.rs", new).groupBy("file").agg(F.count("*").alias("symbols"), F.max("id").alias("last"))


def signature_index(spark, sf_dir):
    return _words(spark, sf_dir).select(F.explode(S.signature_tokens(F.col("body"))).alias("token"), "id").groupBy("token").agg(F.count("*").alias("symbols"))


def impact_paths(spark, sf_dir):
    """Indirect impact: the shortest way from a region to what depends on it."""
    found = graph.impact_paths(model.dag(spark, sf_dir).filter("relation <> 'child_of'"), _ids(spark, "r2"), 3)
    return found.select("id", "hops", F.array_join("path", ">").alias("path"))


def graph_statistics(spark, sf_dir):
    edges = model.trade(spark, sf_dir).select("src", "dst").unionByName(model.dag(spark, sf_dir).filter("relation = 'part_of' or relation = 'located_in'").select("src", "dst"))
    edges = cut(edges)
    return graph.graph_stats(_nodes(edges), edges).withColumn("mean_out", F.round("mean_out", 6))


def limited_callers(spark, sf_dir):
    return graph.limited(graph.callers(model.dag(spark, sf_dir), _ids(spark, "n3", "n4")), ["src", "dst"], 12).select("src", "dst", "truncated")


def edge_changes(spark, sf_dir):
    edges = graph.update_edges(model.dag(spark, sf_dir), (F.col("relation") == "located_in") & F.col("src").startswith("s"), "uses_place").filter("relation <> 'part_of'")
    return edges.groupBy("relation").agg(F.count("*").alias("edges"))


def dependents_by_relation(spark, sf_dir):
    found = graph.callers(model.dag(spark, sf_dir).filter(F.col("relation").isin("located_in", "part_of")), _ids(spark, "n1", "r1", "c5"))
    return found.select("src", "dst", "relation")


def from_dependents(spark, sf_dir):
    held = model.dag(spark, sf_dir).filter("relation = 'supplied_by'").groupBy(F.col("dst").alias("id")).agg(F.collect_set("src").alias("dependents"))
    return graph.from_dependents(held)


def described_edges(spark, sf_dir):
    return graph.described(model.dag(spark, sf_dir).filter("relation <> 'supplied_by'"))


def symbol_documents(spark, sf_dir):
    """Graph nodes of the documents whose path is a symbol's."""
    d = model.docs(spark, sf_dir).withColumn("path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/symbols/"), "path")).otherwise(F.concat(F.lit("/"), "path")))
    return d.filter(F.col("path").startswith("/symbols/")).select(F.concat(F.lit("d"), "id").alias("id"), F.element_at("tags", 1).alias("node_type"), F.substring("path", 10, 4000).alias("qualified"))


def similar_percent(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    near = vector.find_similar(v, v.filter("id = 3").select("id", "v"), 25)
    return near.select("id", F.round(vector.similarity_percent(F.col("distance")), 6).alias("percent"))


def hashed_embeddings(spark, sf_dir):
    e = vector.hashed_embeddings(model.docs(spark, sf_dir).select("id", tokenize(F.col("content")).alias("words")), 16)
    return e.select("id", F.size("v").alias("dimensions"), F.round(vector.norm(F.col("v")), 6).alias("norm"))


def stale_embeddings(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    before = d.filter("id % 10 <> 0").select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("content_hash"))
    return vector.stale(d.filter("content is not null"), before).select("id")


def index_updated(spark, sf_dir):
    """Postings after one in five documents is deleted and one in seven replaced by its title. An index's rows of what is
    not deleted are the postings of those documents, so documents are deleted and not their many rows."""
    d = model.docs(spark, sf_dir)
    gone, new = d.filter("id % 5 = 0"), d.filter("id % 7 = 0 and id % 5 <> 0").withColumn("content", F.col("title"))
    kept = search.postings(tables.delete(tables.delete(d, gone), new))
    return kept.unionByName(search.postings(new)).groupBy("id").agg(F.count("*").alias("trigrams"), F.sum("tf").alias("occurrences"))


def trigram_sets(spark, sf_dir):
    """How much of each page of a benchmark item's trigrams are distinct."""
    b = model.table(spark, sf_dir, "benchmark")
    t = trigrams(F.col("text"))
    return b.select("item_id", F.size(t).cast("long").alias("trigrams"), F.size(F.array_distinct(t)).cast("long").alias("distinct_trigrams"))


def match_locations(spark, sf_dir):
    d = model.docs(spark, sf_dir).filter("content is not null").select("id", D.match_locations(F.col("content"), "that the").alias("m"))
    n = lambda kind: F.size(F.filter("m", lambda x: x["kind"] == kind)).cast("long")
    return d.select("id", n("exact").alias("exact"), n("term").alias("term"), F.array_min(F.transform("m", lambda x: x["start"])).alias("first"), D.match_type(F.col("m")).alias("type"))


def code_snippets(spark, sf_dir):
    return _words(spark, sf_dir).select("id", D.code_snippet(F.col("body"), "kind", 80).alias("snippet"))


def _files(spark, sf_dir):
    return _words(spark, sf_dir).select(F.concat(F.lit("src/p"), "id", F.lit(".rs")).alias("path"), F.col("body").alias("content"))


def parsed_symbols(spark, sf_dir):
    return code.symbols(_files(spark, sf_dir)).select("path", "name", "type", "visibility", "start", "end", "qualified")


def parsed_references(spark, sf_dir):
    return code.references(_files(spark, sf_dir)).select("path", "name", "kind", "line")


SCRIPTS = {
    "py": ("import {0}.{1} as m\nfrom {0} import {1}, x\n\n\nclass {2}(Base):\n    def {0}(self, n: int):\n        return {1}(self.go(n))\n", (("class", 5, 7), ("method", 6, 7))),
    "js": ("import {{ {1} }} from './{0}'\n// function no() {{}}\nexport class {2} extends Base {{\n  {0}(n) {{ return {1}(this.go(`${{n}}`)) }}\n}}\n", (("class", 3, 5), ("method", 4, 4))),
    "ts": ("import * as m from './{0}'\nexport interface {2} {{\n  {0}(n: number): void;\n}}\nexport const {1} = (n: {2}) => m.go(n);\n", (("interface", 2, 4), ("method", 3, 3))),
}


def _scripts(spark, sf_dir):
    """Parts as files of three languages, whose names stand in classes, calls and imports."""
    p = model.table(spark, sf_dir, "part")
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    kind = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    body = F.coalesce(*(F.when(kind == k, F.lit(t.replace("{{", "{").replace("}}", "}"))) for k, (t, _) in SCRIPTS.items()))
    for place, value in (("{0}", a), ("{1}", b), ("{2}", F.initcap(b))):
        body = F.replace(body, F.lit(place), value)
    return p.select(F.concat(F.lit("app/p"), "p_partkey", F.lit("."), kind).alias("path"), body.alias("content"))


def script_symbols(spark, sf_dir):
    found = code.symbols(_scripts(spark, sf_dir)).filter("type in ('class', 'interface', 'method')")
    return found.select("path", "name", "type", "start", "end", "parent")


def script_imports(spark, sf_dir):
    return code.imports(_scripts(spark, sf_dir)).select("path", "module", F.array_join("items", ",").alias("items"), "alias", "wildcard", "line")


def script_references(spark, sf_dir):
    return code.references(_scripts(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def parse_statistics(spark, sf_dir):
    """Files of four languages, one in ten cut in the middle: how many hold errors, and the deepest brackets."""
    files = _files(spark, sf_dir).unionByName(_scripts(spark, sf_dir).filter("path not like '%.py'"))
    n = F.regexp_extract("path", r"p(\d+)\.", 1).cast("int")
    broken = files.withColumn("content", F.when(n % 10 == 0, F.substring_index("content", "}", 1)).otherwise(F.col("content")))
    made = code.parse_stats(broken)
    return made.groupBy(F.substring_index("path", ".", -1).alias("extension")).agg(F.count("*").alias("files"), F.count_if(F.col("errors") > 0).alias("broken"), F.max("depth").alias("depth"))


def parsed_graph(spark, sf_dir):
    return code.code_graph(_files(spark, sf_dir))[1].groupBy("relation").agg(F.count("*").alias("edges"))


QUERIES = {f.__name__: f for f in (match_locations, code_snippets, parsed_symbols, parsed_references, parsed_graph, script_symbols, script_imports, script_references, parse_statistics, import_lines, reference_lines, text_dependencies, nested_symbols, file_symbols, type_symbols, any_term_symbols, file_replaced, signature_index, impact_paths, graph_statistics, limited_callers, edge_changes, dependents_by_relation, from_dependents, described_edges, symbol_documents, similar_percent, hashed_embeddings, stale_embeddings, index_updated, trigram_sets)}

_AB = "w AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part)"
_BODY = "'fn ' || a || '(x: &str) -> ' || upper(b[1]) || lower(b[2:]) || replace(' {~    // skip(1)~    let y: Kind = ', '~', chr(10)) || b || replace('(x);~    ', '~', chr(10)) || a || replace('!(y)~    let n: Vec<u8> = 1;~}', '~', chr(10))"
_TIMES = "((length(t) - length(replace(t, '{0}', ''))) / {1})::BIGINT"
_FUZZY_ONE = "SELECT id FROM (SELECT id, CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN starts_with(lower(name), '{q}') THEN 0.8 WHEN contains(lower(name), '{q}') THEN 0.6 WHEN o > 0.5 THEN o * 0.5 END::DOUBLE AS s FROM (SELECT *, len(list_intersect(list_distinct(string_split(lower(name), '')), list_distinct(string_split('{q}', ''))))::DOUBLE / len(list_distinct(list_concat(string_split(lower(name), ''), string_split('{q}', '')))) AS o FROM symbols)) WHERE s IS NOT NULL ORDER BY s DESC, id LIMIT 60"
_GRAMS = "y AS (SELECT {key}, string_split({t}, '') AS c FROM {src}), g AS (SELECT {key}, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS trigram FROM y), k AS (SELECT * FROM g WHERE regexp_matches(trigram, '[\\p{{L}}\\p{{N}}]'))"
_VERBS = "CASE relation WHEN 'child_of' THEN 'is child of' ELSE 'has custom relationship with' END"
ORACLE = {
    "match_locations": f"""WITH {DOCS}, a AS (SELECT id, lower(content) AS t FROM docs WHERE content IS NOT NULL), b AS (SELECT id, t, {_TIMES.format("that the", 8)} AS exact, {_TIMES.format("that", 4)} AS x, {_TIMES.format("the", 3)} AS y FROM a),
        c AS (SELECT *, least(x, 10) + least(y, greatest(1, 10 - least(x, 10))) AS term FROM b)
        SELECT id, exact, term, nullif(least(CASE WHEN contains(t, 'that') THEN instr(t, 'that') ELSE 1000000 END, CASE WHEN contains(t, 'the') THEN instr(t, 'the') ELSE 1000000 END), 1000000) - 1 AS first, CASE WHEN exact > 0 THEN 'exact_phrase' WHEN term > 1 THEN 'proximity' ELSE 'term' END AS type FROM c""",
    "code_snippets": f"WITH {_AB} SELECT id, CASE WHEN length({_BODY}) <= 80 THEN {_BODY} ELSE '// Lines 1-6' || chr(10) || {_BODY} END AS snippet FROM w",
    "parsed_symbols": f"WITH {_AB} SELECT 'src/p' || id || '.rs' AS path, a AS name, 'function' AS type, 'private' AS visibility, 1 AS start, 6 AS \"end\", 'src/p' || id || '.rs::' || a AS qualified FROM w",
    "parsed_references": f"WITH {_AB} SELECT 'src/p' || id || '.rs' AS path, b AS name, 'function_call' AS kind, 3 AS line FROM w UNION ALL SELECT 'src/p' || id || '.rs', a, 'macro_invocation', 4 FROM w UNION ALL SELECT 'src/p' || id || '.rs', unnest([upper(b[1]) || lower(b[2:]), 'Kind', 'Vec']), 'type_usage', unnest([1, 3, 5]) FROM w",
    "script_symbols": f"""WITH {_AB}, s AS (SELECT *, upper(b[1]) || lower(b[2:]) AS c FROM w WHERE true), k AS (SELECT id % 3 AS k, * FROM s)
        SELECT 'app/p' || id || ['.py', '.js', '.ts'][k + 1] AS path, c AS name, ['class', 'class', 'interface'][k + 1] AS type, [5, 3, 2][k + 1] AS start, [7, 5, 4][k + 1] AS "end", NULL AS parent FROM k
        UNION ALL SELECT 'app/p' || id || ['.py', '.js', '.ts'][k + 1], a, 'method', [6, 4, 3][k + 1], [7, 4, 3][k + 1], c FROM k""",
    "script_imports": f"""WITH {_AB}, k AS (SELECT id % 3 AS k, * FROM w) SELECT 'app/p' || id || '.py' AS path, a || '::' || b AS module, '' AS items, 'm' AS alias, false AS wildcard, 1 AS line FROM k WHERE k = 0
        UNION ALL SELECT 'app/p' || id || '.py', a, b || ',x', NULL, false, 2 FROM k WHERE k = 0 UNION ALL SELECT 'app/p' || id || '.js', './' || a, b, NULL, false, 1 FROM k WHERE k = 1 UNION ALL SELECT 'app/p' || id || '.ts', './' || a, '', 'm', true, 1 FROM k WHERE k = 2""",
    "script_references": "WITH n AS (SELECT p_partkey % 3 AS k FROM part), t AS (SELECT unnest(CASE k WHEN 0 THEN ['inheritance', 'function_call', 'method_call', 'type_annotation'] WHEN 1 THEN ['inheritance', 'function_call', 'method_call'] ELSE ['type_usage', 'method_call'] END) AS kind FROM n) SELECT kind, count(*) AS n FROM t GROUP BY 1",
    "parse_statistics": "WITH n AS (SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['rs'] WHEN 1 THEN ['rs', 'js'] ELSE ['rs', 'ts'] END) AS extension FROM part) SELECT extension, count(*) AS files, count(*) FILTER (id % 10 = 0) AS broken, CASE extension WHEN 'rs' THEN 2 WHEN 'js' THEN 4 ELSE 2 END AS depth FROM n GROUP BY 1",
    "parsed_graph": f"WITH {_AB}, f AS (SELECT a AS name, id, row_number() OVER (PARTITION BY a ORDER BY length('src/p' || id || '.rs'), 'src/p' || id || '.rs::' || a) AS n FROM w), e AS (SELECT w.id AS s, f.id AS d FROM w JOIN f ON w.b = f.name AND n = 1 UNION ALL SELECT w.id, f.id FROM w JOIN f ON w.a = f.name AND n = 1) SELECT 'calls' AS relation, count(*) AS edges FROM e WHERE s <> d GROUP BY 1",
    "import_lines": f"WITH {_AB} SELECT id, CASE WHEN id % 8 IN (0, 3) THEN a WHEN id % 8 = 1 THEN './' || b WHEN id % 8 = 2 THEN a || '.' || b WHEN id % 8 = 6 THEN './' || a || '.css' END AS module FROM w",
    "reference_lines": f"WITH {_AB} SELECT id, CASE WHEN id % 8 = 4 THEN 'self.' || a END AS reference, {_pick_sql(['public', 'unknown', 'internal'], 'id')} AS visibility FROM w",
    "text_dependencies": f"WITH {_AB} SELECT id, array_to_string(list_sort(list_distinct([a, b, upper(b[1]) || lower(b[2:]), 'Kind', 'Vec'])), ',') AS names FROM w",
    "nested_symbols": """WITH RECURSIVE s AS (SELECT c_custkey AS id, 's' || c_custkey AS name, c_nationkey AS file, round(c_acctbal)::BIGINT AS a, round(c_acctbal)::BIGINT + c_custkey * 37 % 900 AS b FROM customer),
        m AS (SELECT s.id, p.id AS parent, row_number() OVER (PARTITION BY s.id ORDER BY p.b - p.a, p.id DESC) AS n FROM s JOIN s p ON s.file = p.file AND p.a <= s.a AND s.b <= p.b AND (p.b - p.a > s.b - s.a OR p.b - p.a = s.b - s.a AND p.id < s.id)),
        u AS (SELECT s.id, name, parent FROM s LEFT JOIN m ON s.id = m.id AND n = 1),
        q AS (SELECT id, parent, name AS qualified, parent AS up FROM u UNION ALL SELECT q.id, q.parent, z.name || '::' || q.qualified, z.parent FROM q JOIN u z ON q.up = z.id)
        SELECT id, parent, qualified FROM q WHERE up IS NULL""",
    "file_symbols": f"WITH {SYMBOLS} SELECT id, name, type, line FROM symbols WHERE file = 'Brand#11.rs'",
    "type_symbols": f"WITH {SYMBOLS} SELECT type, file, count(*) AS symbols FROM symbols WHERE type IN ('PROMO', 'SMALL') GROUP BY ALL",
    "any_term_symbols": f"WITH {SYMBOLS} " + " UNION ".join(f"SELECT * FROM ({_FUZZY_ONE.format(q=q)})" for q in ("green", "blue", "ivory")),
    "file_replaced": f"WITH {SYMBOLS}, n AS (SELECT id, file FROM symbols WHERE file <> 'Brand#11.rs' UNION ALL SELECT id + 1000000, 'Brand#11.rs' FROM symbols WHERE file = 'Brand#12.rs') SELECT file, count(*) AS symbols, max(id) AS last FROM n GROUP BY file",
    "signature_index": "SELECT unnest(['str', 'vec']) AS token, count(*) AS symbols FROM part GROUP BY 1",
    "impact_paths": f"""WITH RECURSIVE {DAG}, e AS (SELECT * FROM edges WHERE relation <> 'child_of'), w AS (SELECT 'r2' AS tip, ['r2'] AS path UNION ALL SELECT src, list_append(path, src) FROM w JOIN e ON dst = tip WHERE len(path) <= 3),
        b AS (SELECT tip, path, row_number() OVER (PARTITION BY tip ORDER BY len(path), path) AS n FROM w WHERE tip <> 'r2') SELECT tip AS id, len(path) - 1 AS hops, array_to_string(path, '>') AS path FROM b WHERE n = 1""",
    "graph_statistics": f"""WITH RECURSIVE {TRADE.replace("edges AS", "trade AS")}, {DAG.replace("edges AS", "dag AS")}, edges AS (SELECT src, dst FROM trade UNION ALL SELECT src, dst FROM dag WHERE relation IN ('part_of', 'located_in')), {_NODES},
        roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)), reach AS (SELECT DISTINCT src, dst FROM edges WHERE src LIKE 'n%' UNION SELECT reach.src, edges.dst FROM reach JOIN edges ON reach.dst = edges.src),
        mutual AS (SELECT x.src, min(x.dst) AS low FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src),
        d AS (SELECT id AS root, id AS node, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM d JOIN edges ON src = node WHERE depth < 30), f AS (SELECT root, node, min(depth) AS depth FROM d GROUP BY ALL)
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes), 6) AS mean_out, (SELECT count(DISTINCT least(src, low)) FROM mutual) AS strong, (SELECT max(depth) FROM f) AS depth""",
    "limited_callers": f"WITH {DAG}, f AS (SELECT * FROM edges WHERE dst IN ('n3', 'n4')) SELECT src, dst, (SELECT count(*) > 12 FROM f) AS truncated FROM f ORDER BY src, dst LIMIT 12",
    "edge_changes": f"WITH {DAG} SELECT CASE WHEN relation = 'located_in' AND src LIKE 's%' THEN 'uses_place' ELSE relation END AS relation, count(*) AS edges FROM edges WHERE relation <> 'part_of' GROUP BY 1",
    "dependents_by_relation": f"WITH {DAG} SELECT * FROM edges WHERE relation IN ('located_in', 'part_of') AND dst IN ('n1', 'r1', 'c5')",
    "from_dependents": f"WITH {DAG} SELECT src, dst, 'calls' AS relation FROM edges WHERE relation = 'supplied_by'",
    "described_edges": f"WITH {DAG} SELECT *, src || ' ' || {_VERBS} || ' ' || dst AS caller, CASE relation WHEN 'child_of' THEN 'Parent-Child Relationship Impact' ELSE 'Custom Relationship Impact (' || relation || ')' END AS impact FROM edges WHERE relation <> 'supplied_by'",
    "symbol_documents": f"WITH {DOCS} SELECT 'd' || id AS id, tags[1] AS node_type, path AS qualified FROM docs WHERE id % 3 = 0",
    "similar_percent": f"WITH {VECTORS}, q AS (SELECT v AS q FROM vectors WHERE id = 3), d AS (SELECT id, 1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS d FROM vectors, q WHERE id <> 3) SELECT id, round(greatest(0, 1 - greatest(0, d)) * 100, 6) AS percent FROM d ORDER BY d.d, id LIMIT 25",
    "stale_embeddings": f"WITH {DOCS} SELECT id FROM docs WHERE content IS NOT NULL AND (id % 10 = 0 OR id % 4 = 0)",
    "index_updated": f"WITH {DOCS}, x AS (SELECT id, lower(title || ' ' || CASE WHEN id % 7 = 0 THEN title ELSE coalesce(content, '') END) AS t FROM docs WHERE id % 5 <> 0), {_GRAMS.format(key='id', t='t', src='x')} SELECT id, count(DISTINCT trigram) AS trigrams, count(*) AS occurrences FROM k GROUP BY id",
    "trigram_sets": f"WITH {_GRAMS.format(key='item_id', t='lower(text)', src='benchmark')} SELECT b.item_id, count(trigram) AS trigrams, count(DISTINCT trigram) AS distinct_trigrams FROM benchmark b LEFT JOIN k ON b.item_id = k.item_id GROUP BY b.item_id",
}
