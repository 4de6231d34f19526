"""Lookups in written stores, searches that are built and routed, and checks of what goes in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed_values import MANY_RESULTS, SUGGESTIONS
from ..operators import graph, rerank, search, stats, symbols, tables, vector
from ..sources import repository, sinks, stores
from ..sources.shared import shared_dir
from ..streaming import streams
from . import model
from .graph_queries import _NODES, _REACH, _nodes
from .model import DAG, DOCS, SYMBOLS, TRADE, VECTORS
from .stat_queries import _m, _r
from .stream_queries import _events, _plain
from .text_queries import RANKED, SHORT, _ranked_sql, _rounded


def _scratch(spark):
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def document_lookup(spark, sf_dir):
    return model.docs(spark, sf_dir).filter("id = 42").select("id", "path", "title", "size")


def delete_everywhere(spark, sf_dir):
    """One delete over documents, their postings' trigrams and their sizes."""
    d = model.docs(spark, sf_dir)
    gone = d.filter("id % 4 = 1")
    left = tables.delete_everywhere(gone, documents=d.select("id"), statistics=search.doc_stats(d).select("id", "words"), tags=d.select("id", F.explode("tags").alias("tag")))
    rows = [t.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("table_name"), "n", "ids") for name, t in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def metadata_files(spark, sf_dir):
    at = _scratch(spark)
    stores.write_metadata(model.docs(spark, sf_dir), at)
    return _plain(stores.read_metadata(spark, at).select(F.col("id").cast("long").alias("id"), "path", "size", "updated_at", "sha256"))


def commit_log_lines(spark, sf_dir):
    """Orders as records of a commit log, read by its parser."""
    o = model.table(spark, sf_dir, "orders")
    f = lambda *parts: F.concat_ws("\x1f", *parts)
    stat = F.concat(F.lit("\n\n3\t"), F.col("o_orderkey") % 7, F.lit("\tsrc/a b.py\n-\t-\tblob.bin\n"))
    text = f(F.sha1(F.col("o_orderkey").cast("string").cast("binary")), F.concat(F.lit("C"), "o_custkey"), F.lit("c@example.com"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "p1 p2").otherwise(""), F.concat(F.lit("Order\n\nby "), "o_custkey"), stat)
    made = repository.parsed_log(o.select(text.alias("record")))
    return made.select("sha", "author", "ts", F.size("parents").cast("long").alias("parents"), "message", F.array_join("files", "|").alias("files"), "added", "removed")


def only_paths(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    wanted = d.filter("id % 3 = 0").select(F.concat(F.lit("./"), "path").alias("path"))
    return repository.only(d.select("id", "path"), wanted)


def symbol_store(spark, sf_dir):
    """Lookups by id, name and file in a store of symbols that the first of them writes."""
    at = stores.stored(spark, "symbols-2", [f"{sf_dir}/part.parquet"], lambda root: stores.Symbols.write(model.symbols(spark, sf_dir), root))
    held = stores.Symbols(spark, at)
    pick = lambda how, rows: rows.select(F.lit(how).alias("how"), "id", "name", "file", "line")
    return pick("id", held.by("id", 7, 77)).unionByName(pick("name", held.by("name", "small widget", "hot widget"))).unionByName(pick("file", held.by("file", "Brand#11.rs"))).unionByName(pick("all", held.all()))


def graph_store(spark, sf_dir):
    """A graph as saved and loaded again: edges by relation, and nodes by kind."""
    edges = model.dag(spark, sf_dir)
    at = _scratch(spark)
    stores.save_graph(_nodes(edges), edges, at)
    nodes, edges = stores.load_graph(spark, at)
    return edges.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).unionByName(nodes.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n")))


def renamed_files(spark, sf_dir):
    """Versions of files after two in five are moved, some onto another's path."""
    m = _m(spark, sf_dir)
    versions = m.select(F.concat(F.lit("f"), F.col("key") % 60).alias("path"), "id", "ts")
    files = versions.select("path").distinct().withColumn("n", F.substring("path", 2, 9).cast("int"))
    moves = files.filter("n % 5 < 2").select("path", F.concat(F.lit("f"), F.col("n") + F.when(F.col("n") % 5 == 0, 2).otherwise(1000)).alias("to"))
    return tables.renamed(versions, moves).groupBy("path", "renamed_from").agg(F.count("*").alias("versions"), F.max("id").alias("last"))


def csv_round_trip(spark, sf_dir):
    at, d = _scratch(spark), model.docs(spark, sf_dir).select("id", "path", "content", "size", "updated_at")
    sinks.write_csv(d, at)
    return sinks.read_csv(spark, at, d.schema).select("id", "path", "size", "updated_at", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


def json_round_trip(spark, sf_dir):
    at, d = _scratch(spark), model.docs(spark, sf_dir).select("id", "path", "content", "tags", "size")
    sinks.write_json(d, at)
    return spark.read.schema(d.schema).json(at).select("id", "path", "size", F.array_join("tags", ",").alias("tags"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


def registered_repositories(spark, sf_dir):
    """Registrations of (owner, address): the last one stays."""
    o = model.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("https://example.com/"), F.substring("o_orderpriority", 3, 20)).alias("url"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return tables.upsert(o.filter("at % 2 = 0"), o.filter("at % 2 = 1"), "at", ("owner", "url"))


def same_paths(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    other = F.when(F.col("id") % 4 == 0, F.concat(F.lit("./"), "path")).when(F.col("id") % 4 == 1, F.replace("path", F.lit("/"), F.lit("\\"))).when(F.col("id") % 4 == 2, F.substring_index("path", "/", -2)).otherwise(F.concat(F.lit("x"), F.substring_index("path", "/", -1)))
    return d.select("id", paths.same_path(F.col("path"), other).alias("same"))


def built_queries(spark, sf_dir):
    """A path pattern, a text, and a text within tags and times, each with a page."""
    docs = model.docs(spark, sf_dir)
    asked = (search.Query.of("src1*/en/*", limit=5, offset=5), search.Query.of(RANKED, limit=5, offset=3), search.Query.of(SHORT, tags=("en",), since="2024-01-01 00:20:00", until="2024-01-01 02:00:00", limit=8))
    parts = [q.run(docs).select(F.lit(n).alias("query"), "id", F.round("score", 6).alias("score")) for n, q in enumerate(asked)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def content_front(spark, sf_dir):
    """A search with no context, whole; the kinds of all four fronts."""
    docs, as_of = model.docs(spark, sf_dir), F.lit("2024-02-15").cast("date")
    asked = [search.Query.of(RANKED), search.Query.of(RANKED, context="medium"), search.Query.of("*", context="full"), search.Query.of("")]
    made = [search.search_content(docs, q, as_of) for q in asked]
    kinds = "/".join(kind for kind, _ in made)
    return _rounded(made[0][1].select("id", "score")).withColumn("kinds", F.lit(kinds))


def code_page(spark, sf_dir):
    return symbols.code_search(model.symbols(spark, sf_dir), "*widget*", 15, 10).select("id", "name", "score", "total")


def context_info(spark, sf_dir):
    d, c = model.docs(spark, sf_dir), F.col("content")
    return d.select("id", F.array_join(rerank.callees(c), "|").alias("callees"), F.array_join(rerank.related_types(c), "|").alias("types"), rerank.importance(c).alias("importance"))


def search_advice(spark, sf_dir):
    c = model.table(spark, sf_dir, "conversations")
    found, tokens = F.col("turn") % 3 * 25, F.length("text").cast("long")
    return c.select("conv_id", "turn", F.array_join(rerank.suggestions(F.col("text"), found), "|").alias("suggestions"), F.array_join(rerank.warnings(tokens, 120, found), "|").alias("warnings"))


def hybrid_capped(spark, sf_dir):
    """Sixty rows are asked for, fifty is the most."""
    query = model.vectors(spark, sf_dir).filter("id = 0")
    meaning = vector.ranked(vector.knn(model.vectors(spark, sf_dir), query, 180), "distance", "id")
    words = vector.ranked(search.text_search(model.docs(spark, sf_dir), RANKED, 10), F.desc("score"), "id")
    return vector.hybrid(meaning, words, 60, 0.6, 0.4).withColumn("score", F.round("score", 9))


def vector_insert(spark, sf_dir):
    """Some new vectors replace old ones, some are too short or null."""
    v = model.vectors(spark, sf_dir).select("id", "v")
    new = v.filter("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(100_000)).alias("id"), F.when(F.col("id") % 4 == 0, F.slice("v", 1, 10)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.transform("v", lambda x: x * 2)).alias("v"))
    kept, refused = vector.insert(v, new, 64)
    return kept.select("id", F.lit(True).alias("taken"), F.round(vector.norm(F.col("v")), 6).alias("norm")).unionByName(refused.select("id", F.lit(False).alias("taken"), F.lit(None).cast("double").alias("norm")))


def vector_remove(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    return vector.remove(v, v.filter("label = 3").select("id")).groupBy("label").agg(F.count("*").alias("n"))


def bridge_statistics(spark, sf_dir):
    """The trade of nations, a region being a file."""
    n = model.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("file"))
    return _r(graph.bridge_stats(n, model.trade(spark, sf_dir).select("src", "dst")))


def batch_inserts(spark, sf_dir):
    """Customers as new nodes, several of one id, the last of which stays, and orders as edges between known nodes."""
    n = model.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("nation").alias("node_type"))
    c = model.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("id"), F.col("c_custkey").alias("seq"), F.lit("customer").alias("node_type"))
    nodes = graph.insert_nodes(n, c, "seq")
    new = model.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 45).alias("src"), (F.col("o_orderkey") % 45).alias("dst"))
    edges = graph.insert_edges(new.limit(0), new, nodes)
    count = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    return nodes.join(count, "id", "left").select("id", "seq", "node_type", "edges")


def _typed(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    edges = model.dag(spark, sf_dir)
    return _nodes(edges).withColumn("node_type", F.element_at(kinds, F.substring("id", 1, 1))), edges


KINDS = {"o": "order", "c": "customer", "n": "nation", "r": "region", "s": "supplier", "p": "part"}


def nodes_by_type(spark, sf_dir):
    """Suppliers, each with the number of edges at it."""
    nodes, edges = _typed(spark, sf_dir)
    mine = graph.nodes_of_type(nodes, "supplier")
    at = graph.edges_of(edges, mine)
    ends = at.select(F.col("src").alias("id")).unionByName(at.select(F.col("dst").alias("id")))
    return mine.join(ends.groupBy("id").agg(F.count("*").alias("edges")), "id", "left").select("id", "edges")


def node_statistics(spark, sf_dir):
    return _r(graph.node_stats(*_typed(spark, sf_dir)))


def relation_totals(spark, sf_dir):
    edges = model.dag(spark, sf_dir)
    return _r(stats.relation_totals(_nodes(edges), edges))


def memory_efficiency(spark, sf_dir):
    m = _m(spark, sf_dir)
    return _r(m.groupBy("key").agg(F.sum("size").alias("raw"), F.sum(F.when(F.col("key") % 9 == 0, 0).otherwise(F.col("size") + 8)).alias("taken")).select("key", stats.memory_efficiency(F.col("raw"), F.col("taken")).alias("efficiency")))


def key_balance(spark, sf_dir):
    return _r(stats.balance(model.table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 64))


def ordered_map(spark, sf_dir):
    """Bulk inserts (the last of a key stays) and removals, then a range."""
    p = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(0).cast("long").alias("at"), F.col("p_size").cast("long").alias("value"))
    new = model.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").cast("long").alias("value"))
    held = tables.remove_all(tables.put_all(p, new, "at"), p.filter("key % 10 = 3").select("key"))
    return tables.entries_between(held, 20, 150)


def nearest_keys(spark, sf_dir):
    """Orders' keys among the multiples of 7 of them."""
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return tables.nearest_keys(o.filter("key % 7 = 0"), o.filter("key % 7 <> 0"))


def stale_heartbeats(spark, sf_dir):
    """Users without an event for twelve hours before the newest one; the clock starts a century before that one."""
    newest = model.measurements(spark, sf_dir).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    beats = streams.stale_jobs(_events(spark, sf_dir), "key", "ts", 12 * 60, first=(newest or 0) - 36_525 * 86_400_000)
    return streams.collected(beats, "update", f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}").select("key", "last")


def stream_upserts(spark, sf_dir):
    """The last event of each user, folded from micro-batches into a versioned table."""
    rows = _events(spark, sf_dir).select(F.col("key").alias("id"), F.col("id").alias("event"), "operation", F.struct(F.unix_micros("ts").alias("us"), "id").alias("at"))
    empty = spark.createDataFrame([], rows.schema)
    made = streams.folded(rows, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", empty, lambda table, batch: tables.upsert(table, batch, "at"))
    return made.select("id", "event", "operation")


def write_flushes(spark, sf_dir):
    """How users' events fall into writes of three rows, or of what came within a day."""
    made = stats.flushes(_m(spark, sf_dir), "key", "ts", "size", 3, 150, 24 * 3_600_000)
    return made.select("id", "key", "flush")


QUERIES = {f.__name__: f for f in (
    document_lookup, delete_everywhere, metadata_files, commit_log_lines, only_paths, symbol_store, graph_store, renamed_files, csv_round_trip, json_round_trip, registered_repositories, same_paths, built_queries, content_front, code_page, context_info,
    search_advice, hybrid_capped, vector_insert, vector_remove, bridge_statistics, batch_inserts, nodes_by_type, node_statistics, relation_totals, memory_efficiency, key_balance, ordered_map, nearest_keys, stale_heartbeats, stream_upserts, write_flushes,
)}

_M = "m AS (SELECT event_id AS id, ts, event_type AS operation, user_id AS key, value AS ms, (props::JSON->>'k')::BIGINT AS size FROM events)"
_SUGGEST = lambda name: "[" + ", ".join(f"'{x}'" for x in SUGGESTIONS[name]) + "]"
_LINES = "string_split(content, chr(10))"
_TYPED = f"{DAG}, {_NODES}, t AS (SELECT id, CASE substring(id, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END AS node_type FROM nodes)"
ORACLE = {
    "document_lookup": f"WITH {DOCS} SELECT id, path, title, size FROM docs WHERE id = 42",
    "delete_everywhere": "WITH d AS (SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 1), s AS (SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM d) SELECT unnest(['documents', 'statistics', 'tags']) AS table_name, unnest([n, n, 2 * n]) AS n, unnest([ids, ids, 2 * ids]) AS ids FROM s",
    "metadata_files": f"WITH {DOCS} SELECT id, path, size, updated_at, sha256(coalesce(content, '')) AS sha256 FROM docs",
    "commit_log_lines": "SELECT sha1(o_orderkey::VARCHAR) AS sha, 'C' || o_custkey AS author, o_orderkey AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS parents, 'Order' || chr(10) || chr(10) || 'by ' || o_custkey AS message, 'src/a b.py|blob.bin' AS files, 3 AS added, (o_orderkey % 7)::INT AS removed FROM orders",
    "only_paths": f"WITH {DOCS} SELECT id, path FROM docs WHERE id % 3 = 0",
    "symbol_store": f"WITH {SYMBOLS} SELECT 'id' AS how, id, name, file, line FROM symbols WHERE id IN (7, 77) UNION ALL SELECT 'name', id, name, file, line FROM symbols WHERE name IN ('small widget', 'hot widget') UNION ALL SELECT 'file', id, name, file, line FROM symbols WHERE file = 'Brand#11.rs' UNION ALL SELECT 'all', id, name, file, line FROM symbols",
    "graph_store": f"WITH {DAG}, {_NODES} SELECT relation AS kind, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT substring(id, 1, 1), count(*) FROM nodes GROUP BY 1",
    "renamed_files": f"""WITH {_M}, v AS (SELECT 'f' || key % 60 AS path, key % 60 AS n, id FROM m), f AS (SELECT DISTINCT path, n FROM v), s AS (SELECT path, 'f' || (n + CASE WHEN n % 5 = 0 THEN 2 ELSE 1000 END) AS "to" FROM f WHERE n % 5 < 2),
        k AS (SELECT v.* FROM v WHERE path NOT IN (SELECT "to" FROM s) OR path IN (SELECT path FROM s))
        SELECT coalesce("to", k.path) AS path, CASE WHEN "to" IS NOT NULL THEN k.path END AS renamed_from, count(*) AS versions, max(id) AS last FROM k LEFT JOIN s ON k.path = s.path GROUP BY 1, 2""",
    "csv_round_trip": f"WITH {DOCS} SELECT id, path, size, updated_at, sha256(coalesce(content, '')) AS sha256 FROM docs",
    "json_round_trip": f"WITH {DOCS} SELECT id, path, size, array_to_string(tags, ',') AS tags, sha256(coalesce(content, '')) AS sha256 FROM docs",
    "registered_repositories": "SELECT o_custkey AS owner, 'https://example.com/' || substring(o_orderpriority, 3) AS url, max(o_orderkey) AS at, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2",
    "same_paths": f"WITH {DOCS} SELECT id, id % 4 <> 3 AS same FROM docs",
    "built_queries": f"""WITH {DOCS}, p AS (SELECT id FROM docs WHERE path LIKE 'src1%' AND contains(path[5:], '/en/') ORDER BY id LIMIT 5 OFFSET 5), t AS (SELECT id, score FROM ({_ranked_sql(RANKED, "5", 8)}) ORDER BY score DESC, id LIMIT 5 OFFSET 3),
        documents_ AS (SELECT doc_id, text, lang, source FROM documents WHERE lang = 'en' AND doc_id >= 20 AND doc_id < 120 OR source = 'en' AND doc_id >= 20 AND doc_id < 120), u AS (SELECT id, score FROM ({_ranked_sql(SHORT, "2", 8).replace("FROM documents)", "FROM documents_)")}))
        SELECT 0 AS query, id, 0.0::DOUBLE AS score FROM p UNION ALL SELECT 1, id, score FROM t UNION ALL SELECT 2, id, score FROM u""",
    "content_front": f"SELECT id, score, 'regular/optimized/wildcard/regular' AS kinds FROM ({_ranked_sql(RANKED, '5')})",
    "code_page": f"WITH {SYMBOLS}, f AS (SELECT min(id) AS id, name FROM symbols WHERE lower(name) LIKE '%widget%' GROUP BY name, file, line) SELECT id, name, 1.0::DOUBLE AS score, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 15 OFFSET 10",
    "context_info": rf"""WITH {DOCS}, l AS (SELECT id, content, list_transform({_LINES}, lambda x: regexp_extract(x, '^[^(]*?([^\s(]+)\s*\(', 1)) AS c,
        list_transform(list_filter(flatten(list_transform(list_filter({_LINES}, lambda x: contains(x, 'impl ') OR contains(x, ': ')), lambda x: string_split_regex(x, '\s+'))), lambda w: regexp_matches(w, '^\p{{Lu}}')), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]+$', '')) AS t FROM docs)
        SELECT id, array_to_string(list_sort(list_distinct(list_filter(c, lambda w: w <> '' AND NOT starts_with(w, 'fn') AND NOT starts_with(w, 'if'))))[1:5], '|') AS callees, array_to_string(list_sort(list_distinct(t))[1:5], '|') AS types,
               CASE WHEN contains(content, 'pub ') THEN 0.9 WHEN contains(content, '#[test]') OR contains(content, '#[cfg(test)]') THEN 0.3 ELSE 0.5 END::DOUBLE AS importance FROM l""",
    "search_advice": f"""WITH c AS (SELECT conv_id, turn, text, turn % 3 * 25 AS f FROM conversations) SELECT conv_id, turn,
        array_to_string(list_concat(list_concat(CASE WHEN contains(text, 'error') OR contains(text, 'Error') THEN {_SUGGEST("error")} ELSE [] END, CASE WHEN contains(text, 'test') OR contains(text, 'Test') THEN {_SUGGEST("test")} ELSE [] END), list_concat(CASE WHEN f > 10 THEN {_SUGGEST("many")} ELSE [] END, CASE WHEN f = 0 THEN {_SUGGEST("none")} ELSE [] END)), '|') AS suggestions,
        concat_ws('|', CASE WHEN length(text) > 120 THEN 'Results exceed token budget (' || length(text) || ' > 120). Some content may be truncated.' END, CASE WHEN f >= 50 THEN '{MANY_RESULTS}' END) AS warnings FROM c""",
    "hybrid_capped": f"""WITH {VECTORS}, n AS (SELECT a.id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM vectors a, vectors b WHERE b.id = 0 ORDER BY 2, 1 LIMIT 180), t AS ({_ranked_sql(RANKED, "5")}),
        r AS (SELECT id, 0.6::DOUBLE / (60 + row_number() OVER (ORDER BY distance, id)) AS p FROM n UNION ALL SELECT id, 0.4::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM t) SELECT id, round(sum(p), 9) AS score FROM r GROUP BY id ORDER BY sum(p) DESC, id LIMIT 50""",
    "vector_insert": f"""WITH {VECTORS}, n AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 100000 END AS id, CASE WHEN id % 4 = 0 THEN v[1:10] WHEN id % 5 = 0 THEN NULL ELSE list_transform(v, lambda x: x * 2) END AS v FROM vectors WHERE id % 3 = 0), g AS (SELECT * FROM n WHERE len(v) = 64)
        SELECT id, true AS taken, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM (SELECT id, v FROM vectors WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, v FROM g) UNION ALL SELECT id, false, NULL FROM n WHERE v IS NULL OR len(v) <> 64""",
    "vector_remove": "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label",
    "bridge_statistics": f"""WITH RECURSIVE {TRADE}, {_REACH}, n AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS file FROM nation), c AS (SELECT id, coalesce((SELECT min(least(x.dst, n.id)) FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src WHERE x.src = n.id), id) AS c FROM n),
        d AS (SELECT id AS root, id AS node, 0 AS depth FROM n UNION SELECT root, dst, depth + 1 FROM d JOIN edges ON src = node WHERE depth < 25), s AS (SELECT root, node, min(depth) AS depth FROM d GROUP BY ALL)
        SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file) FROM n) AS files, (SELECT count(*) FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id WHERE a.file <> b.file) AS imports,
               (SELECT count(DISTINCT c) FROM c) AS strong, (SELECT max(depth) FROM s) AS depth, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM n), 6) AS mean_out""",
    "batch_inserts": """WITH c AS (SELECT c_custkey % 40 AS id, max(c_custkey) AS seq FROM customer GROUP BY 1), n AS (SELECT id, seq, 'customer' AS node_type FROM c UNION ALL SELECT n_nationkey, 0, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT id FROM c)),
        e AS (SELECT o_custkey % 45 AS src, o_orderkey % 45 AS dst FROM orders), k AS (SELECT src, count(*) AS edges FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY src) SELECT id, seq, node_type, edges FROM n LEFT JOIN k ON id = src""",
    "nodes_by_type": f"WITH {_TYPED}, k AS (SELECT dst AS id, count(*) AS n FROM edges WHERE relation = 'supplied_by' GROUP BY 1) SELECT t.id, coalesce(k.n, 0) + (SELECT count(*) FROM edges WHERE src = t.id) AS edges FROM t LEFT JOIN k ON t.id = k.id WHERE node_type = 'supplier'",
    "node_statistics": f"WITH {_TYPED}, o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1) SELECT node_type, count(*) AS nodes, round(avg(coalesce(i.n, 0)), 6) AS mean_in, round(avg(coalesce(o.n, 0)), 6) AS mean_out, count(*) FILTER (i.n IS NULL AND o.n IS NULL) AS alone FROM t LEFT JOIN o ON t.id = o.id LEFT JOIN i ON t.id = i.id GROUP BY 1",
    "relation_totals": f"WITH {DAG}, {_NODES}, n AS (SELECT count(*) AS nodes FROM nodes) SELECT nodes, count(*) AS edges, count(DISTINCT relation) AS relations, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(count(*)::DOUBLE / nodes, 6) AS edges_per_node FROM edges, n GROUP BY nodes",
    "memory_efficiency": f"WITH {_M} SELECT key, CASE WHEN key % 9 = 0 THEN 0 ELSE round(sum(size)::DOUBLE / sum(size + 8), 6) END AS efficiency FROM m GROUP BY key",
    "key_balance": "WITH p AS (SELECT l_suppkey % 64 AS part, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS parts, sum(n)::BIGINT AS rows, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(max(n) / avg(n), 6) AS skew, round(avg(n) / max(n), 6) AS utilisation FROM p",
    "ordered_map": "WITH l AS (SELECT l_partkey AS key, max(l_orderkey * 10 + l_linenumber) AS at, arg_max(l_quantity::BIGINT, l_orderkey * 10 + l_linenumber) AS value FROM lineitem GROUP BY 1), a AS (SELECT * FROM l UNION ALL SELECT p_partkey, 0, p_size FROM part WHERE p_partkey NOT IN (SELECT key FROM l)) SELECT * FROM a WHERE key % 10 <> 3 AND key >= 20 AND key < 150",
    "nearest_keys": "WITH t AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 7 = 0), a AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT a.key, t.key AS below FROM a ASOF LEFT JOIN t ON a.key >= t.key), c AS (SELECT a.key, t.key AS above FROM a ASOF LEFT JOIN t ON a.key <= t.key) SELECT b.key, below, above FROM b JOIN c ON b.key = c.key",
    "stale_heartbeats": "WITH l AS (SELECT user_id AS key, epoch_ms(max(ts)) AS last FROM events GROUP BY 1) SELECT key, last FROM l WHERE last + 12 * 3600000 < (SELECT max(last) FROM l) - 60000",
    "stream_upserts": "SELECT user_id AS id, arg_max(event_id, (epoch_us(ts)::HUGEINT * 1000000 + event_id)) AS event, arg_max(event_type, (epoch_us(ts)::HUGEINT * 1000000 + event_id)) AS operation FROM events GROUP BY 1",
    "write_flushes": """WITH e AS (SELECT user_id AS key, list({'id': event_id, 't': epoch_us(ts), 's': coalesce((props::JSON->>'k')::BIGINT, 0), 'f': 0::BIGINT, 'held': 0::BIGINT, 'out': []::BIGINT[]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
        r AS (SELECT key, l, list_reduce(l, lambda a, x: list_transform([a.held > 0 AND x.t - a.t >= 86400000000], lambda late: list_transform([{'f': a.f + late::INT, 'held': CASE WHEN late THEN 1 ELSE a.held + 1 END, 's': CASE WHEN late OR a.held = 0 THEN x.s ELSE a.s + x.s END, 't': CASE WHEN late OR a.held = 0 THEN x.t ELSE a.t END}],
            lambda q: {'id': x.id, 't': q.t, 's': q.s, 'f': q.f + (q.held >= 3 OR q.s >= 150)::INT, 'held': CASE WHEN q.held >= 3 OR q.s >= 150 THEN 0 ELSE q.held END, 'out': list_append(a.out, q.f)})[1])[1], {'id': 0::BIGINT, 't': 0::BIGINT, 's': 0::BIGINT, 'f': 0::BIGINT, 'held': 0::BIGINT, 'out': []::BIGINT[]}) AS f FROM e)
        SELECT unnest(list_transform(l, lambda x: x.id)) AS id, key, unnest(f.out) AS flush FROM r""",
}
