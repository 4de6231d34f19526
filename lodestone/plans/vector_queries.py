"""Vector search queries; the query vector is that of the smallest id, read by the plan and not by the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, vector
from . import model
from .model import DOCS, VECTORS
from .text_queries import RANKED, _ranked_sql


def _query(spark, sf_dir):
    return model.vectors(spark, sf_dir).filter("id = 0")


def _rounded(df, name="distance"):
    return df.withColumn(name, F.round(name, 6))


def _knn(metric):
    return lambda spark, sf_dir: _rounded(vector.knn(model.vectors(spark, sf_dir), _query(spark, sf_dir), 20, metric))


def semantic_threshold(spark, sf_dir):
    return _rounded(vector.semantic_search(model.vectors(spark, sf_dir), _query(spark, sf_dir), 20, 0.7))


def find_similar(spark, sf_dir):
    near = vector.find_similar(model.vectors(spark, sf_dir), _query(spark, sf_dir), 10)
    return near.select("id", F.round("distance", 6).alias("distance"), F.round(vector.similarity_percent(F.col("distance")), 4).alias("percent"))


def rrf_hybrid(spark, sf_dir):
    meaning = vector.ranked(vector.knn(model.vectors(spark, sf_dir), _query(spark, sf_dir), 30), "distance", "id")
    words = vector.ranked(search.text_search(model.docs(spark, sf_dir), RANKED, 10), F.desc("score"), "id")
    return vector.fuse([(meaning, 0.7), (words, 0.3)], 20).withColumn("score", F.round("score", 9))


def _embed(make):
    def run(spark, sf_dir):
        e = make(F.col("v"))
        return model.vectors(spark, sf_dir).select("id", F.size(e).cast("long").alias("size"), F.round(vector._sum(e), 6).alias("total"), F.round(F.element_at(e, 5), 6).alias("fifth"), F.round(vector.norm(e), 6).alias("norm"))

    return run


def _embed_sql(e):
    return f"WITH {VECTORS}, e AS (SELECT id, {e} AS e FROM vectors) SELECT id, len(e)::BIGINT AS size, round(list_sum(e), 6) AS total, round(e[5], 6) AS fifth, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM e"


def _interp_sql(n):
    return f"list_transform(range(0, {n}), lambda i: v[(floor(i * (len(v) - 1) / {n - 1}.0::DOUBLE))::INT + 1] + (v[least(floor(i * (len(v) - 1) / {n - 1}.0::DOUBLE)::INT + 1, len(v) - 1) + 1] - v[(floor(i * (len(v) - 1) / {n - 1}.0::DOUBLE))::INT + 1]) * (i * (len(v) - 1) / {n - 1}.0::DOUBLE - floor(i * (len(v) - 1) / {n - 1}.0::DOUBLE)))"


QUERIES = {f.__name__: f for f in (semantic_threshold, find_similar, rrf_hybrid)}
QUERIES |= {"knn_cosine": _knn("cosine"), "knn_euclid": _knn("euclidean"), "knn_dot": _knn("dot")}
QUERIES |= {
    "embed_pad": _embed(lambda v: vector.pad(v, 100)), "embed_repeat": _embed(lambda v: vector.repeat(v, 100)), "embed_truncate": _embed(lambda v: vector.truncate(v, 16)),
    "embed_interp": _embed(lambda v: vector.interpolate(v, 100)), "embed_standard": _embed(lambda v: vector.standard(v, 128)),
}

_DIST = {"cosine": "1 - list_cosine_similarity(a.v, b.v)", "euclidean": "list_distance(a.v, b.v)", "dot": "-list_inner_product(a.v, b.v)"}


def _near(metric, k, own=True):
    return f"SELECT a.id, {_DIST[metric]} AS distance FROM vectors a, vectors b WHERE b.id = 0{'' if own else ' AND a.id <> 0'} ORDER BY 2, 1 LIMIT {k}"


ORACLE = {f"knn_{n}": f"WITH {VECTORS} SELECT id, round(distance, 6) AS distance FROM ({_near(m, 20)})" for n, m in (("cosine", "cosine"), ("euclid", "euclidean"), ("dot", "dot"))}
ORACLE |= {
    "semantic_threshold": f"WITH {VECTORS}, n AS ({_near('cosine', 40)}) SELECT id, round(distance, 6) AS distance FROM n WHERE distance <= 0.7 ORDER BY n.distance, id LIMIT 20",
    "find_similar": f"WITH {VECTORS} SELECT id, round(distance, 6) AS distance, round(greatest(0, 1 - greatest(0, distance)) * 100, 4) AS percent FROM ({_near('cosine', 10, False)})",
    "rrf_hybrid": f"""WITH {VECTORS}, n AS ({_near("cosine", 30)}), t AS ({_ranked_sql(RANKED, "5")}),
        r AS (SELECT id, 0.7::DOUBLE / (60 + row_number() OVER (ORDER BY distance, id)) AS p FROM n UNION ALL SELECT id, 0.3::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM t)
        SELECT id, round(sum(p), 9) AS score FROM r GROUP BY id ORDER BY sum(p) DESC, id LIMIT 20""",
    "embed_pad": _embed_sql("list_concat(v, list_transform(range(0, 100 - len(v)), lambda i: 0::DOUBLE))"),
    "embed_repeat": _embed_sql("list_transform(range(0, 100), lambda i: v[(i % len(v)) + 1])"),
    "embed_truncate": _embed_sql("v[1:16]"),
    "embed_interp": _embed_sql(_interp_sql(100)),
    "embed_standard": _embed_sql("list_concat(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), list_transform(range(0, 128 - len(v)), lambda i: 0::DOUBLE))"),
}
