"""Re-ranking and table-change queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rerank, search, tables
from . import model
from .model import DOCS
from .text_queries import SHORT, _ranked_sql

AS_OF = "2024-02-15"


def _r(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _hits(spark, sf_dir):
    return search.text_search(model.docs(spark, sf_dir), SHORT, 40)


def relevance_scores(spark, sf_dir):
    c = F.col("content")
    d = model.docs(spark, sf_dir)
    return _r(d.select("id", rerank.exact_score(c, "the").alias("exact"), rerank.proximity_score(c, "the and of").alias("proximity"), rerank.importance_score(c, "the").alias("importance"), rerank.match_quality(c, "the and").alias("quality"), rerank.freshness(F.col("updated_at"), F.lit(AS_OF).cast("date")).alias("fresh")))


def snippet_window(spark, sf_dir):
    c = F.col("content")
    d = model.docs(spark, sf_dir)
    return d.select("id", F.sha2(rerank.snippet(c, "that", 120), 256).alias("snippet_sha256"), rerank.context_type(rerank.match_window(c, "that")).alias("context"))


def relevance_rerank(spark, sf_dir):
    out = rerank.optimized(model.docs(spark, sf_dir), _hits(spark, sf_dir), SHORT, F.lit(AS_OF).cast("date"), "minimal")
    return _r(out.select("id", "score")).orderBy(F.desc("score"), "id").limit(15)


def token_budget(spark, sf_dir):
    d = model.docs(spark, sf_dir).select("id", (F.col("id") % 97).cast("double").alias("score"), F.col("content").alias("snippet"))
    return rerank.select_within(d, 1200, 10).select("rank", "id", "tokens", "cut")


def token_usage(spark, sf_dir):
    d = model.docs(spark, sf_dir).select("id", (F.col("id") % 97).cast("double").alias("score"), F.col("content").alias("snippet"))
    return _r(rerank.usage(rerank.select_within(d, 1200, 10), 1200))


def _small(spark, sf_dir):
    return model.docs(spark, sf_dir).select("id", "path", "size")


def insert_new(spark, sf_dir):
    d = _small(spark, sf_dir)
    new = d.select((F.col("id") + 500).alias("id"), "path", "size")
    return tables.insert(d, new).groupBy(F.col("path").endswith("7.md").alias("seven")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def update_known(spark, sf_dir):
    d = _small(spark, sf_dir)
    new = d.filter("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.lit("moved").alias("path"), "size")
    return tables.update(d, new)


def upsert_latest(spark, sf_dir):
    d = _small(spark, sf_dir)
    return tables.upsert(d, d.select("id", F.lit("new").alias("path"), (F.col("size") * 2 % 5000).alias("size")), "size")


def delete_anti(spark, sf_dir):
    d = _small(spark, sf_dir)
    return tables.delete(d, d.filter("size < 800").select("id"))


def incremental_changes(spark, sf_dir):
    d = _small(spark, sf_dir)
    changed = d.filter("id % 10 = 1").withColumn("size", F.lit(1).cast("long"))
    return tables.apply_changes(d, changed, d.filter("id % 10 = 2").select("path"))


def change_sets(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    push = F.concat(F.lit('{"commits":[{"added":["a'), F.col("event_id") % 7, F.lit('","b"],"removed":[]},{"added":["b"],"modified":["m'), F.col("user_id"), F.lit('"]}]}'))
    made = tables.change_sets(e.select("event_id", push.alias("payload")))
    return made.select("event_id", F.array_join("added", ",").alias("added"), F.array_join("modified", ",").alias("modified"), F.array_join("removed", ",").alias("removed"))


def front_matter(spark, sf_dir):
    d = model.docs(spark, sf_dir)
    text = tables.with_tags(F.col("content"), F.col("tags"))
    return d.select("id", F.sha2(text, 256).alias("sha256"), F.array_join(tables.front_matter_tags(text), ",").alias("tags"))


QUERIES = {f.__name__: f for f in (relevance_scores, snippet_window, relevance_rerank, token_budget, token_usage, insert_new, update_known, upsert_latest, delete_anti, incremental_changes, change_sets, front_matter)}

_C = "lower(content)"
_TOKENS = "floor(len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')) * 1.3 + len(regexp_extract_all({0}, '[!-/:-@\\[-`{{-~]')) * 0.3 + 1e-9)::BIGINT"
_WHOLE, _SHORT = "n < 10 AND used + a <= 1200", "n < 5 AND used + b <= 1200"
#: The greedy choice, a row a step: what does not fit leaves id null.
_CHOSEN = f"""WITH RECURSIVE {DOCS}, d AS (SELECT row_number() OVER (ORDER BY id % 97 DESC, id) AS r, id, content AS s, CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END AS h FROM docs QUALIFY r <= 20),
        t AS (SELECT r, id AS i, s, h, {_TOKENS.format("s")} AS a, {_TOKENS.format("h")} AS b FROM d),
        f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS tokens, NULL::BOOLEAN AS cut, NULL::VARCHAR AS snippet UNION ALL
              SELECT t.r, used + CASE WHEN {_WHOLE} THEN a WHEN {_SHORT} THEN b ELSE 0 END, n + CASE WHEN {_WHOLE} OR {_SHORT} THEN 1 ELSE 0 END, CASE WHEN {_WHOLE} OR {_SHORT} THEN i END,
                     CASE WHEN {_WHOLE} THEN a WHEN {_SHORT} THEN b END, CASE WHEN {_WHOLE} THEN false WHEN {_SHORT} THEN true END, CASE WHEN {_WHOLE} THEN s WHEN {_SHORT} THEN h END FROM f JOIN t ON t.r = f.r + 1)"""


def _exact(q):
    return f"least((strlen({_C}) - strlen(replace({_C}, '{q}', ''))) / {len(q)} / strlen({_C})::DOUBLE * 1000, 1.0)"


def _near(term, others):
    at = f"instr({_C}, '{term}')"
    start = f"greatest({at} - 100, 1)"
    win = f"substring({_C}, {start}, {at} - {start} + {len(term)} + 100)"
    return f"CASE WHEN {at} > 0 THEN 1.0 + " + " + ".join(f"CASE WHEN contains({win}, '{o}') THEN 0.5 ELSE 0.0 END" for o in others) + " ELSE 0.0 END"


_IMPORTANCE = "least(CASE WHEN contains({c}, 'fn {q}') THEN 0.8 ELSE 0.0 END + CASE WHEN contains({c}, 'pub') AND contains({c}, '{q}') THEN 0.6 ELSE 0.0 END + CASE WHEN contains({c}, 'struct {q}') OR contains({c}, 'enum {q}') THEN 0.4 ELSE 0.0 END, 1.0)::DOUBLE"
_FRESH = f"CASE WHEN date_diff('day', updated_at::DATE, DATE '{AS_OF}') < 0 THEN 0.2 WHEN date_diff('day', updated_at::DATE, DATE '{AS_OF}') <= 7 THEN 1.0 WHEN date_diff('day', updated_at::DATE, DATE '{AS_OF}') <= 30 THEN 0.8 WHEN date_diff('day', updated_at::DATE, DATE '{AS_OF}') <= 90 THEN 0.6 WHEN date_diff('day', updated_at::DATE, DATE '{AS_OF}') <= 365 THEN 0.4 ELSE 0.2 END::DOUBLE"
_SMALL = f"{DOCS}, d AS (SELECT id, path, size FROM docs)"
_AT = f"greatest(instr({_C}, 'that'), 1)"
_ST = f"greatest({_AT} - 60, 1)"
_W = f"CASE WHEN instr({_C}, 'that') > 0 THEN substring(content, greatest(instr({_C}, 'that') - 50, 1), instr({_C}, 'that') - greatest(instr({_C}, 'that') - 50, 1) + 54) ELSE '' END"
ORACLE = {
    "relevance_scores": f"""WITH {DOCS} SELECT id, round({_exact("the")}, 6) AS exact, round(least(greatest({_near("the", ["and", "of"])}, {_near("and", ["the", "of"])}, {_near("of", ["the", "and"])})::DOUBLE / 3, 1.0), 6) AS proximity,
        round({_IMPORTANCE.format(c=_C, q="the")}, 6) AS importance, CASE WHEN contains({_C}, 'the and') THEN 0.9 WHEN contains({_C}, 'the') OR contains({_C}, 'and') THEN 0.6 ELSE 0.1 END::DOUBLE AS quality, {_FRESH} AS fresh FROM docs""",
    "snippet_window": f"""WITH {DOCS}, w AS (SELECT *, {_W} AS w FROM docs) SELECT id, sha256(CASE WHEN length(content) <= 120 THEN content ELSE CASE WHEN {_ST} > 1 THEN '...' ELSE '' END || trim(substring(content, {_ST}, 120)) || CASE WHEN {_ST} + 120 <= length(content) THEN '...' ELSE '' END END) AS snippet_sha256,
        CASE WHEN contains(lower(w), 'fn ') THEN 'function' WHEN contains(lower(w), 'struct ') OR contains(lower(w), 'enum ') THEN 'type' WHEN contains(lower(w), 'let ') OR contains(lower(w), 'const ') THEN 'variable' WHEN contains(w, '//') OR contains(w, '/*') THEN 'comment'
             WHEN contains(w, '"') OR contains(w, '''') THEN 'text' WHEN regexp_matches(w, '[{{}};]') THEN 'code' ELSE 'unknown' END AS context FROM w""",
    "relevance_rerank": f"""WITH h AS ({_ranked_sql(SHORT, "2", 40)}), {DOCS}, j AS (SELECT docs.*, score AS base, max(score) OVER () AS top FROM docs JOIN h ON docs.id = h.id),
        s AS (SELECT id, least(greatest(0.4::DOUBLE * least(greatest(base / top, 0.0), 1.0) + 0.3::DOUBLE * {_exact(SHORT)} + 0.2::DOUBLE * {_IMPORTANCE.format(c=_C, q=SHORT)} + 0.1::DOUBLE * {_FRESH}, 0.0), 1.0) AS score FROM j)
        SELECT id, round(score, 6) AS score FROM s ORDER BY round(s.score, 6) DESC, id LIMIT 15""",
    "token_budget": f"{_CHOSEN} SELECT n AS rank, id, tokens, cut FROM f WHERE id IS NOT NULL",
    "token_usage": f"{_CHOSEN} SELECT coalesce(sum(tokens), 0)::BIGINT AS tokens, round(least(coalesce(sum(tokens), 0) / 1200.0, 1.0), 6)::DOUBLE AS efficiency, count(*) FILTER (ends_with(snippet, '...')) AS truncated FROM f WHERE id IS NOT NULL",
    "insert_new": f"WITH {_SMALL}, u AS (SELECT * FROM d UNION ALL SELECT id + 500, path, size FROM d WHERE id + 500 NOT IN (SELECT id FROM d)) SELECT path LIKE '%7.md' AS seven, count(*) AS n, sum(size)::BIGINT AS size FROM u GROUP BY 1",
    "update_known": f"WITH {_SMALL}, n AS (SELECT id * 2 AS id, 'moved' AS path, size FROM d WHERE id % 3 = 0 AND id * 2 IN (SELECT id FROM d)) SELECT * FROM d WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n",
    "upsert_latest": f"WITH {_SMALL} SELECT id, CASE WHEN size * 2 % 5000 >= size THEN 'new' ELSE path END AS path, greatest(size * 2 % 5000, size) AS size FROM d",
    "delete_anti": f"WITH {_SMALL} SELECT * FROM d WHERE size >= 800",
    "incremental_changes": f"WITH {_SMALL} SELECT id, path, CASE WHEN id % 10 = 1 THEN 1 ELSE size END AS size FROM d WHERE id % 10 <> 2",
    "change_sets": "SELECT event_id, 'a' || event_id % 7 || ',b' AS added, 'm' || user_id AS modified, NULL::VARCHAR AS removed FROM events",
    "front_matter": f"WITH {DOCS} SELECT id, sha256('---' || chr(10) || 'tags:' || chr(10) || '- ' || tags[1] || chr(10) || '- ' || tags[2] || chr(10) || '---' || chr(10) || content) AS sha256, tags[1] || ',' || tags[2] AS tags FROM docs",
}
