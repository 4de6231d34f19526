"""Exact vector search, rank fusion and dimension transforms, as higher-order column functions.

A query vector is one row that a join brings to the scan; the k nearest come from TakeOrderedAndProject, so nothing
but k rows of each partition crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero, infinite where their lengths differ."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), float("inf")).when(scale == 0, 1.0).otherwise(1 - dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def negative_dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(-dot(a, b))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean, "dot": negative_dot}


def knn(vectors: DataFrame, query: DataFrame, k: int, metric: str = "cosine", own: bool = True) -> DataFrame:
    """id and distance of the k nearest to query's one row (id, v), nearest first; own: whether that id may be found."""
    one = query.limit(1).select(F.col("id").alias("_q"), F.col("v").alias("_v"))
    pairs = vectors.crossJoin(F.broadcast(one))  # one row
    pairs = pairs if own else pairs.filter(F.col("id") != F.col("_q"))
    return pairs.select("id", DISTANCES[metric](F.col("v"), F.col("_v")).alias("distance")).orderBy("distance", "id").limit(k)


def semantic_search(vectors: DataFrame, query: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The best of 2k within a threshold."""
    near = knn(vectors, query, 2 * k)
    near = near if threshold is None else near.filter(F.col("distance") <= threshold)
    return near.orderBy("distance", "id").limit(k)


def find_similar(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    return knn(vectors, query, k, own=False)


def ranked(hits: DataFrame, *order) -> DataFrame:
    """id and rank from 1. hits are a top-k, so the one partition is small."""
    return hits.select("id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(lists: list[tuple[DataFrame, float]], k: int, damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with weights."""
    parts = [r.select("id", (F.lit(w) / (damping + F.col("rank"))).alias("part")) for r, w in lists]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: The most rows that a search gives.
MOST_SEMANTIC, MOST_HYBRID, MOST_SIMILAR = 50, 50, 20


def check_weights(semantic: float, text: float) -> None:
    if abs(semantic + text - 1.0) > 0.01:
        raise ValueError(f"the weights {semantic} and {text} do not add up to 1")


def hybrid(meaning: DataFrame, words: DataFrame, k: int = 10, semantic: float = 0.7, text: float = 0.3) -> DataFrame:
    """Fusion of two ranked lists by weights that add up to 1; at most MOST_HYBRID rows."""
    check_weights(semantic, text)
    return fuse([(meaning, semantic), (words, text)], min(k, MOST_HYBRID))


def insert(vectors: DataFrame, new: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """The vectors with new ones (id, v), which replace those of their ids; and the new rows that were turned away, for
    another number of dimensions or none at all."""
    fits = F.coalesce(F.size("v") == dimensions, F.lit(False)) & F.col("id").isNotNull()
    taken = new.filter(fits)
    return vectors.join(taken.select("id"), "id", "left_anti").unionByName(taken), new.filter(~fits)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_anti")


def similarity_percent(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), distance)) * 100


def _let(x: Column, make) -> Column:
    """make(x) with x worked out once: a lambda's variable is a value, while a column in it is worked out at each use."""
    return F.element_at(F.transform(F.array(x), make), 1)


def normalized(v: Column) -> Column:
    return _let(v, lambda w: _let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def pad(v: Column, size: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(v))))


def repeat(v: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(v, (i % F.size(v)).cast("int")))


def truncate(v: Column, size: int) -> Column:
    return F.slice(v, 1, size)


def interpolate(v: Column, size: int) -> Column:
    """Linear interpolation at size evenly spaced places from the first component to the last."""

    def at(i: Column) -> Column:
        place = i * (F.size(v) - 1) / F.lit(float(max(size - 1, 1)))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(v) - 1)
        return F.get(v, low) + (F.get(v, high) - F.get(v, low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def standard(v: Column, size: int = 1536) -> Column:
    """Smaller vectors normalised and padded, larger ones interpolated."""
    return F.when(F.size(v) == size, v).when(F.size(v) < size, pad(normalized(v), size)).otherwise(interpolate(v, size))


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """An embedding without a model: signed counts of hashed words, normalised; for tests and offline use."""
    hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("at"), F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    counts = lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(x["at"] == i, x["sign"]).otherwise(0.0)))
    return normalized(_let(hashed, counts))


def hashed_embeddings(rows: DataFrame, size: int = 64) -> DataFrame:
    """id and v: hashed_embedding of each row's words (id, words) by one pass over them; null for null words.

    Ids are unique. What is dealt by id is at most size counts for each id and task."""
    w = F.col("w")
    signed = rows.select("id", F.explode("words").alias("w")).select("id", F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("at"), F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    counts = signed.groupBy("id", "at").agg(F.sum("sign").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("counts"))
    zeros = F.create_map().cast("map<int,double>")
    joined = rows.select("id", F.col("words").isNull().alias("none")).join(counts, "id", "left").withColumn("counts", F.coalesce("counts", zeros))
    v = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0.0)))
    return joined.select("id", F.when(~F.col("none"), normalized(v)).alias("v"))


def stale(docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Documents (id, content) whose content's hash is not the embedded one (id, content_hash)."""
    now = docs.withColumn("content_hash", F.sha2("content", 256))
    return now.join(embedded.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
