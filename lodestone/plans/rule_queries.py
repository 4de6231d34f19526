"""Rules of single rows: names, settings, labels, validation, documents of files, and the filter language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, paths, rules, sanitize, text
from ..functions.fixed_values import ENTRY_NAMES, ENTRY_PARTS, ENTRY_SUFFIXES, PARSED_EXTENSIONS, RELATION_LABELS, RELATIONS, SKIPPED_DIRECTORIES, SYMBOL_CODES, WORD_IMPACTS, WORD_VERBS
from ..operators import graph, search
from ..operators import symbols as S
from ..sources import repository, sinks
from . import model
from .model import DAG, DOCS, MEASUREMENTS, SYMBOLS
from .text_queries import _clean_sql

AS_OF = "2024-01-04 00:00:00"


def _pick(values, by):
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


def _pick_sql(values, by) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({by} % {len(values)})::INT + 1]"


def path_aware_clean(spark, sf_dir):
    c = model.table(spark, sf_dir, "conversations")
    joined = F.when(F.col("turn") % 3 == 0, F.regexp_replace("text", " ", "/")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", sanitize.path_aware(joined).alias("clean"))


def strict_clean(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    raw = F.concat("content", F.lit(" (select)=drop, "), "path")
    return d.select("id", sanitize.clean(raw, strict=True).alias("clean"))


TAGS = ("Rust-2024", "two words", "ü_1", "no/slash", "", "x" * 51)


def tag_rules(spark, sf_dir):
    t = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(TAGS, "o_orderkey").alias("tag"))
    return t.select("id", sanitize.tag(F.col("tag")).alias("clean"), rules.tag_ok(F.col("tag")).alias("valid"))


def validate_documents(spark, sf_dir):
    """Every seventh title is blank, some tags hold a slash, every eleventh row was updated before it was created."""
    d = model.docs(spark, sf_dir)
    title = F.when(F.col("id") % 7 == 0, "  ").otherwise(F.col("title"))
    tags = F.when(F.col("id") % 5 == 0, F.concat("tags", F.array(F.lit("a/b")))).otherwise(F.col("tags"))
    created = F.when(F.col("id") % 11 == 0, F.expr("updated_at + INTERVAL 1 DAY")).otherwise(F.col("updated_at"))
    return d.select("id", F.array_join(rules.document_problems(title, tags, F.col("size"), created.cast("timestamp"), F.col("updated_at").cast("timestamp")), ",").alias("problems"))


SETTINGS = ('{"branch": "main", "options": {"depth": "3", "fast": "true"}}', '{"branch": "dev"}', '{"options": {"depth": "x"}}')
OVERRIDES = ('{"branch": "next", "options": {"depth": "9"}}', None, '{"options": {"fast": "false"}, "extra": "1"}', '{}')


def settings_merge(spark, sf_dir):
    m = model.measurements(spark, sf_dir).select("id", _pick(SETTINGS, "id").alias("base"), _pick(OVERRIDES, "id").alias("over"))
    s = m.select("id", rules.merged_settings(F.col("base"), F.col("over")).alias("s"))
    return s.select("id", F.col("s")["branch"].alias("branch"), F.col("s")["extra"].alias("extra"), rules.option(F.col("s"), "depth", "long").alias("depth"), rules.option(F.col("s"), "fast", "boolean").alias("fast"))


URLS = ("https://git.example.com/org/tool.git", "git@git.example.com:org/my.app.git", "https://u:p@git.example.com/a/b?x=1#y", "/srv/repos/--Odd name!--", "https://git.example.com/org/***")
REFS = ("refs/heads/main", "refs/tags/v1.2", "main", "refs/heads/feature/x")


def repository_names(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(URLS, "o_orderkey").alias("url"), _pick(REFS, "o_orderkey").alias("ref"))
    name = repository.repository_name(F.col("url"))
    return o.select("id", name.alias("name"), repository.safe_name(name).alias("folder"), repository.branch(F.col("ref")).alias("branch"))


def owner_names(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(URLS[:2], "o_orderkey").alias("url"))
    both = repository.owner_and_repository(F.col("url"))
    return o.select("id", F.substring_index(both, "/", 1).alias("owner"), F.substring_index(both, "/", -1).alias("repository"))


KINDS = (*RELATIONS, "unheard_of")


def relation_names(spark, sf_dir):
    p = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick(KINDS, "p_partkey").alias("kind"))
    named = p.select("id", graph.relation_of(F.col("kind")).alias("relation"), graph.relation_of(F.col("kind"), True).alias("descriptive"))
    return named.select("*", graph.caller_verb(F.col("descriptive")).alias("verb"), graph.impact_label(F.col("descriptive")).alias("impact"))


def symbol_types(spark, sf_dir):
    p = model.table(spark, sf_dir, "part")
    return p.groupBy(S.type_of(F.col("p_size") % 17).alias("type")).agg(F.count("*").alias("symbols"))


NAMES = ("main", "App::new", "a::B::new", "server.main", "launch", "UserRoute", "helper", "test_it", "CliArgs", "x::run", "renew")
TYPES = ("Function", "struct", None, "method")


def entry_points(spark, sf_dir):
    p = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick(NAMES, "p_partkey").alias("name"), _pick(TYPES, "p_partkey").alias("kind"))
    return p.filter(paths.is_entry_point(F.col("name"), F.col("kind")))


def symbol_ids(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    made = s.select("id", S.symbol_id(F.col("file"), F.lit(None).cast("string"), F.col("name"), F.col("type"), F.col("line").cast("string"), F.col("id").cast("string")).alias("symbol_id"))
    return made.select("id", "symbol_id", F.col("symbol_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("formed"))


EXTENSIONS = ("rs", "PY", "tsx", "md", "cjs")


def _tree(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    folder = F.when(F.col("id") % 9 == 0, "target").when(F.col("id") % 9 == 1, ".git").otherwise(F.element_at("tags", 2))
    return d.select("id", F.concat(folder, F.lit("/"), F.concat(F.lit("f"), "id", F.lit("."), _pick(EXTENSIONS, "id"))).alias("path"), F.encode("content", "UTF-8").alias("content"), "size", (F.col("id") % 6 == 0).alias("binary"))


def source_files(spark, sf_dir):
    """Files that are parsed, outside skipped directories, up to a size."""
    t = _tree(spark, sf_dir).select("id", "path", "size", paths.parsed_language(F.col("path")).alias("language"))
    kept = t.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_DIRECTORIES))))
    return kept.filter(F.col("language").isNotNull() & (F.col("size") <= 4000))


def file_documents(spark, sf_dir):
    made = repository.file_documents(_tree(spark, sf_dir).drop("id"), "demo")
    return made.select("path", "title", F.array_join("tags", ",").alias("tags"), F.sha2("content", 256).alias("content_sha256"))


def commit_documents(spark, sf_dir):
    """Orders as commits, their lines as changed files."""
    o, l = model.table(spark, sf_dir, "orders"), model.table(spark, sf_dir, "lineitem")
    files = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("src/p"), "l_partkey", F.lit(".rs")))).alias("files"), F.sum("l_quantity").cast("int").alias("added"))
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    parents = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(sha))
    c = o.join(files, o["o_orderkey"] == files["l_orderkey"]).select(sha.alias("sha"), F.concat(F.lit("A. "), "o_custkey").alias("author"), F.lit("a@example.com").alias("email"), F.lit(1_700_000_000).alias("ts"), parents.alias("parents"), F.col("o_orderpriority").alias("message"), "files", "added", F.lit(0).alias("removed"))
    return repository.commit_documents(c, "demo").select("path", "title", F.array_join("tags", ",").alias("tags"), F.sha2("content", 256).alias("content_sha256"))


def index_documents(spark, sf_dir):
    n = model.table(spark, sf_dir, "nation")
    r = n.select(F.col("n_name").alias("name"), F.concat(F.lit("/srv/"), "n_name").alias("path"), F.lit("main").alias("branch"), F.col("n_nationkey").alias("commits"), F.expr(f"timestamp_ntz'{AS_OF}'").alias("updated_at"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://git.example.com/"), "n_name")).alias("url"))
    return repository.index_documents(r).select("path", "title", F.array_join("tags", ",").alias("tags"), "content")


def recent_documents(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    return d.filter(rules.is_recent(F.col("updated_at"), F.expr(f"timestamp_ntz'{AS_OF}'"), "70 HOURS")).select("id", rules.file_memory(F.col("size"), False).alias("memory"), rules.backoff_ms(F.col("id") % 9).alias("backoff"))


FILTER = {"$and": [{"tags": {"$contains": ["en"]}}, {"$or": [{"size": {"$gte": 900, "$lt": 2500}}, {"path": {"$match": "^src1[0-9]/"}}]}, {"$not": {"id": {"$in": [1, 2, 3, 5, 8, 13]}}}, {"content": {"$exists": True}}]}


def filter_language(spark, sf_dir):
    return model.docs(spark, sf_dir).filter(filters.compile_filter(FILTER)).select("id", "size")


def timeline(spark, sf_dir):
    return filters.timeline(model.measurements(spark, sf_dir), "ts", "week", "operation")


def sequence_pattern(spark, sf_dir):
    """A view that the same user follows by a purchase within six hours."""
    return filters.followed_by(model.measurements(spark, sf_dir), "key", "ts", F.col("operation") == "view", F.col("operation") == "purchase", 6 * 3600).select("id", "key")


def boosted_search(spark, sf_dir):
    return search.boosted(model.docs(spark, sf_dir), "tion").orderBy(F.desc("score"), "id").limit(40)


REQUESTS = ("Who calls main?", "impact of the parser", "list callees of x", "unused code", "find function open", "overview please", "green tea")


def request_intents(spark, sf_dir):
    p = model.table(spark, sf_dir, "part").select(_pick(REQUESTS, "p_partkey").alias("request"))
    return p.groupBy(filters.intent(F.col("request")).alias("intent")).agg(F.count("*").alias("requests"))


def dot_lines(spark, sf_dir):
    return sinks.dot(model.dag(spark, sf_dir).filter("relation = 'part_of'"))


def markdown_lines(spark, sf_dir):
    return sinks.markdown(model.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def prometheus_lines(spark, sf_dir):
    by = model.measurements(spark, sf_dir).groupBy("operation").agg(F.count("*").alias("n"))
    return sinks.prometheus(by, "operations_total", "operation", "n")


def tokens_by_document(spark, sf_dir):
    words = text.tokenize(F.col("content"))
    return model.docs(spark, sf_dir).select("id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"), text.occurrences(F.col("content"), "the").alias("the"))


QUERIES = {f.__name__: f for f in (path_aware_clean, strict_clean, tag_rules, validate_documents, settings_merge, repository_names, owner_names, relation_names, symbol_types, entry_points, symbol_ids, source_files, file_documents, commit_documents, index_documents, recent_documents, filter_language, timeline, sequence_pattern, boosted_search, request_intents, dot_lines, markdown_lines, prometheus_lines, tokens_by_document)}


def _case(key: str, table: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _worded(key: str, words: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({key}, '{w}') OR contains({key}, '{w.capitalize()}') THEN '{v}'" for w, v in words.items()) + f" ELSE {other} END"


_STEPS = sanitize.STEPS
_SQL = _STEPS[0][0].replace("'", "''")
_AWARE = "regexp_replace(x, '{}', '', 'g')"
_TREE = f"""t AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'target' WHEN id % 9 = 1 THEN '.git' ELSE tags[2] END || '/f' || id || '.' || {_pick_sql(EXTENSIONS, "id")} AS path, content, size, id % 6 = 0 AS "binary" FROM docs)"""
_LANGUAGE = "CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for n, es in PARSED_EXTENSIONS.items() for e in es) + " END"
_DESCRIBED = _case("kind", {k: v[1] for k, v in RELATIONS.items()}, "'references'")
_LOW = "length({c}) - length(replace(lower({c}), 'tion', ''))"
ORACLE = {
    "path_aware_clean": f"""WITH a AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN replace(text, ' ', '/') ELSE text END AS raw FROM conversations),
        b AS (SELECT *, {_clean_sql("raw", ())} AS x FROM a), c AS (SELECT *, regexp_replace(x, '{_SQL}', '', 'g') AS y FROM b),
        d AS (SELECT *, CASE WHEN contains(y, '/') THEN y ELSE regexp_replace(y, '{_STEPS[1][0]}', '', 'g') END AS z FROM c), e AS (SELECT conv_id, turn, text, {_clean_sql("z", _STEPS[-2:])} AS x FROM d)
        SELECT conv_id, turn, CASE WHEN strlen(text) > 1024 THEN NULL WHEN len(list_filter(string_split(x, ' '), lambda t: strlen(t) BETWEEN 1 AND 100)) > 0 THEN x ELSE '*' END AS clean FROM e""",
    "strict_clean": f"WITH {DOCS}, r AS (SELECT id, content || ' (select)=drop, ' || path AS raw FROM docs) SELECT id, {_clean_sql('raw', sanitize.STEPS + sanitize.STRICT_STEPS + sanitize.LAST_STEPS)} AS clean FROM r",
    "tag_rules": f"WITH t AS (SELECT o_orderkey AS id, {_pick_sql(TAGS, 'o_orderkey')} AS tag FROM orders) SELECT id, CASE WHEN strlen(tag) <= 50 AND regexp_full_match(tag, '[\\p{{L}}\\p{{N}}_-]*') THEN lower(tag) END AS clean, trim(tag) <> '' AND strlen(tag) < 128 AND regexp_full_match(tag, '[\\p{{L}}\\p{{N}}_ -]*') AS valid FROM t",
    "validate_documents": f"WITH {DOCS} SELECT id, array_to_string(list_filter([CASE WHEN id % 7 = 0 THEN 'title' END, CASE WHEN id % 5 = 0 THEN 'tags' END, CASE WHEN size >= 104857600 THEN 'size' END, CASE WHEN id % 11 = 0 THEN 'updated' END], lambda x: x IS NOT NULL), ',') AS problems FROM docs",
    "settings_merge": f"""WITH {MEASUREMENTS} SELECT id, CASE WHEN id % 4 = 0 THEN 'next' WHEN id % 3 = 0 THEN 'main' WHEN id % 3 = 1 THEN 'dev' END AS branch, CASE WHEN id % 4 = 2 THEN '1' END AS extra,
        CASE WHEN id % 4 = 0 THEN 9 WHEN id % 3 = 0 THEN 3 END::BIGINT AS depth, CASE WHEN id % 4 = 2 THEN false WHEN id % 3 = 0 THEN true END AS fast FROM m""",
    "repository_names": f"""SELECT o_orderkey AS id, {_pick_sql(("tool", "my.app", "b", "--Odd name!--", "***"), "o_orderkey")} AS name, {_pick_sql(("tool", "my-app", "b", "odd name", "repository"), "o_orderkey")} AS folder,
        nullif({_pick_sql(("main", "v1.2", "", "feature/x"), "o_orderkey")}, '') AS branch FROM orders""",
    "owner_names": f"SELECT o_orderkey AS id, 'org' AS owner, {_pick_sql(('tool', 'my.app'), 'o_orderkey')} AS repository FROM orders",
    "relation_names": f"""WITH k AS (SELECT p_partkey AS id, {_pick_sql(KINDS, "p_partkey")} AS kind FROM part), n AS (SELECT id, {_case("kind", {k: v[0] for k, v in RELATIONS.items()}, "'references'")} AS relation, {_DESCRIBED} AS descriptive FROM k)
        SELECT *, {_case("descriptive", {k: v[0] for k, v in RELATION_LABELS.items()}, _worded("descriptive", WORD_VERBS, "'Has custom relationship with'"))} AS verb,
        {_case("descriptive", {k: v[1] for k, v in RELATION_LABELS.items()}, _worded("descriptive", WORD_IMPACTS, "'Custom Relationship Impact (' || descriptive || ')'"))} AS impact FROM n""",
    "symbol_types": f"SELECT CASE WHEN p_size % 17 < 15 THEN {list(SYMBOL_CODES)}[p_size % 17 + 1] END AS type, count(*) AS symbols FROM part GROUP BY 1",
    "entry_points": f"""WITH p AS (SELECT p_partkey AS id, {_pick_sql(NAMES, "p_partkey")} AS name, nullif({_pick_sql([t or "" for t in TYPES], "p_partkey")}, '') AS kind FROM part)
        SELECT * FROM p WHERE (kind IS NULL OR lower(kind) IN ('function', 'method', 'constructor')) AND (name IN {ENTRY_NAMES} OR regexp_full_match(name, '[^:]*::new') OR starts_with(name, 'test_') OR {" OR ".join([f"ends_with(name, '{x}')" for x in ENTRY_SUFFIXES] + [f"contains(name, '{x}')" for x in ENTRY_PARTS])})""",
    "symbol_ids": f"""WITH {SYMBOLS}, h AS (SELECT id, sha256(concat_ws(chr(10), file, '', name, type, line::VARCHAR, id::VARCHAR)) AS h FROM symbols)
        SELECT id, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || '89ab'[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS symbol_id, true AS formed FROM h""",
    "source_files": f"WITH {DOCS}, {_TREE}, l AS (SELECT id, path, size, {_LANGUAGE} AS language FROM t) SELECT * FROM l WHERE language IS NOT NULL AND size <= 4000 AND NOT list_has_any(string_split(path, '/'), {list(SKIPPED_DIRECTORIES)})",
    "file_documents": f"""WITH {DOCS}, {_TREE} SELECT 'repos/demo/files/' || path AS path, 'File: ' || path AS title, 'file,demo,ext_' || regexp_extract(path, '\\.([^.]*)$', 1) AS tags,
        sha256(CASE WHEN "binary" THEN '# Binary File: ' || path || chr(10) || chr(10) || '- **Size**: ' || size || ' bytes' || chr(10) || '- **Type**: Binary' || chr(10) ELSE content END) AS content_sha256 FROM t""",
    "commit_documents": """WITH f AS (SELECT l_orderkey, list_sort(list('src/p' || l_partkey || '.rs')) AS files, sum(l_quantity)::INT AS added FROM lineitem GROUP BY 1), c AS (SELECT *, sha256(o_orderkey::VARCHAR) AS sha FROM orders JOIN f ON o_orderkey = l_orderkey)
        SELECT 'repos/demo/commits/' || sha[1:8] || '.md' AS path, 'Commit: ' || sha[1:8] AS title, 'commit,demo,A_ ' || o_custkey AS tags, sha256(replace('# Commit: ' || sha[1:8] || '~~**Author**: A. ' || o_custkey || ' <a@example.com>~**Date**: 2023-11-14 22:13:20 UTC~~## Message~' || o_orderpriority || '~~## Details~- **SHA**: ' || sha || '~- **Parents**: '
            || CASE WHEN o_orderkey % 4 = 0 THEN 'none (initial commit)' ELSE sha[1:8] END || '~- **Changes**: ' || added || ' insertions(+), 0 deletions(-)~- **Files Modified**: ' || len(files) || '~~## Files Changed~' || array_to_string(list_transform(files, lambda x: '- ' || x || '~'), ''), '~', chr(10))) AS content_sha256 FROM c""",
    "index_documents": f"""SELECT 'repos/' || lower(n_name) || '/index.md' AS path, 'Repository: ' || n_name AS title, 'repository,index,' || n_name AS tags,
        replace('# Repository: ' || n_name || '~~- **Path**: /srv/' || n_name || '~- **Branch**: main~- **Commits**: ' || n_nationkey || '~- **Updated**: {AS_OF} UTC~' || CASE WHEN n_nationkey % 2 = 0 THEN '- **URL**: https://git.example.com/' || n_name || '~' ELSE '' END, '~', chr(10)) AS content FROM nation""",
    "recent_documents": f"WITH {DOCS} SELECT id, size + 200 AS memory, least(100 * pow(2.0, id % 9), 30000.0) AS backoff FROM docs WHERE updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 70 HOURS",
    "filter_language": f"WITH {DOCS} SELECT id, size FROM docs WHERE list_contains(tags, 'en') AND (size >= 900 AND size < 2500 OR regexp_matches(path, '^src1[0-9]/')) AND id NOT IN (1, 2, 3, 5, 8, 13) AND content IS NOT NULL",
    "timeline": f"WITH {MEASUREMENTS} SELECT operation, date_trunc('week', ts)::TIMESTAMP AS at, count(*) AS n FROM m GROUP BY ALL",
    "sequence_pattern": f"WITH {MEASUREMENTS} SELECT id, key FROM m a WHERE operation = 'view' AND EXISTS (SELECT 1 FROM m b WHERE b.key = a.key AND b.operation = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS)",
    "boosted_search": f"""WITH {DOCS}, s AS (SELECT id, 2.0 * ({_LOW.format(c='title')}) / 4 + 1.5 * len(list_filter(tags, lambda t: contains(lower(t), 'tion'))) + ({_LOW.format(c='content')}) / 4 AS score FROM docs)
        SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 40""",
    "request_intents": f"SELECT {_pick_sql(('callers', 'impact', 'callees', 'unused', 'symbol', 'overview', 'search'), 'p_partkey')} AS intent, count(*) AS requests FROM part GROUP BY 1",
    "dot_lines": f"WITH {DAG} SELECT format('  \"{{}}\" -> \"{{}}\" [label=\"{{}}\"];', src, dst, relation) AS value FROM edges WHERE relation = 'part_of'",
    "markdown_lines": "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS value FROM nation",
    "prometheus_lines": f"WITH {MEASUREMENTS} SELECT 'operations_total{{operation=\"' || operation || '\"}} ' || count(*) AS value FROM m GROUP BY operation",
    "tokens_by_document": f"WITH {DOCS}, w AS (SELECT id, content, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM docs) SELECT id, len(w) AS tokens, len(list_distinct(w)) AS distinct_tokens, ((length(content) - length(replace(content, 'the', ''))) / 3)::BIGINT AS the FROM w",
}
