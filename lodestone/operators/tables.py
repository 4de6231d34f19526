"""Changes to document tables: inserts, updates, deletes, versions, and incremental change sets.

Plain files have no row updates, so each change is a new version of the table: write_version() writes a directory and then
moves a pointer file, and readers follow the pointer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import cut


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """With the new rows whose id is not there yet."""
    return docs.unionByName(new.join(docs.select("id"), "id", "left_anti"))


def update(docs: DataFrame, new: DataFrame) -> DataFrame:
    """With the rows of ids that are there replaced; others are ignored."""
    known = new.join(docs.select("id"), "id", "left_semi")
    return docs.join(known.select("id"), "id", "left_anti").unionByName(known)


def upsert(docs: DataFrame, new: DataFrame, order: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The last row of each id (or other keys) by an order column; the new rows win ties."""
    both = docs.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.desc("_p"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


def delete_everywhere(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The same delete for a table and all that is derived from it, to be written as one version."""
    return {name: delete(t, ids) for name, t in tables.items()}


def renamed(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """A table of versions (path, ...) after files moved (path, to): a file keeps its history under the new path, and
    renamed_from says where it was. A file that is moved onto another's path takes its place: the other's rows go."""
    there = moves.select(F.col("path").alias("_from"), F.col("to").alias("_to"))
    free = versions.join(there.select(F.col("_to").alias("path")).join(there.select(F.col("_from").alias("path")), "path", "left_anti"), "path", "left_anti")
    moved = free.join(there, F.col("path") == F.col("_from"), "left")
    return moved.withColumn("renamed_from", F.when(F.col("_to").isNotNull(), F.col("path"))).withColumn("path", F.coalesce("_to", "path")).drop("_from", "_to")


def put_all(table: DataFrame, new: DataFrame, order: str, key: str = "key") -> DataFrame:
    """An ordered map with new entries: of one key the last by order stays, and new ones win over old ones."""
    last = new.groupBy(key).agg(F.max(F.struct(order, F.struct(*table.columns).alias("row")))["row"].alias("row")).select("row.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def remove_all(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def entries_between(table: DataFrame, low, high, key: str = "key") -> DataFrame:
    """The entries from low to below high; the bounds reach the scan, which sorted files answer from their statistics."""
    return table.filter((F.col(key) >= low) & (F.col(key) < high))


def nearest_keys(table: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """For each asked key (key) below and above: the greatest key at or below it and the least at or above it; both null
    for a null. One range sort of both tables; each partition learns what the others hold from one row.

    Windows run from the start in both orders: one that ends unbounded is worked out anew for each row."""
    both = table.select(key, F.lit(True).alias("held")).unionByName(asked.select(key, F.lit(False).alias("held"))).filter(F.col(key).isNotNull())
    sorted_ = cut(both.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))  # once: borders come from a sample
    here = F.when(F.col("held"), F.col(key))
    so_far = lambda order: W.partitionBy("_p").orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    marked = sorted_.withColumn("_b", F.max(here).over(so_far(F.asc(key)))).withColumn("_a", F.min(here).over(so_far(F.desc(key))))
    ends = sorted_.groupBy("_p").agg(F.min(here).alias("low"), F.max(here).alias("high"))  # a row for each partition
    before, after = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    others = ends.select("_p", F.max("high").over(before).alias("_before"), F.min("low").over(after).alias("_after"))
    found = marked.filter(~F.col("held")).join(F.broadcast(others), "_p")
    none = F.lit(None).cast(both.schema[key].dataType)
    return found.select(key, F.coalesce("_b", "_before").alias("below"), F.coalesce("_a", "_after").alias("above")).unionByName(asked.filter(F.col(key).isNull()).select(key, none.alias("below"), none.alias("above")))


def apply_changes(docs: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose path changed are replaced or added; removed paths go."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    return docs.join(gone, "path", "left_anti").unionByName(changed.join(removed.select("path"), "path", "left_anti"))


def change_sets(pushes: DataFrame, payload: str = "payload") -> DataFrame:
    """Sorted distinct added, modified and removed paths of JSON pushes, over all their commits; null if there are none."""
    kind = "struct<commits:array<struct<added:array<string>,modified:array<string>,removed:array<string>>>>"
    commits = F.coalesce(F.from_json(payload, kind)["commits"], F.array().cast("array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"))
    empty = F.array().cast("array<string>")
    part = lambda n: F.array_sort(F.array_distinct(F.flatten(F.transform(commits, lambda c: F.coalesce(c[n], empty)))))
    names = ("added", "modified", "removed")
    return pushes.select("*", *(F.when(F.size(part(n)) > 0, part(n)).alias(n) for n in names))


def with_tags(content: F.Column, tags: F.Column) -> F.Column:
    """The text with its front matter replaced by the tags."""
    body = F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n", "")
    lines = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.when(F.size(tags) > 0, F.concat(F.lit("---\ntags:\n"), lines, F.lit("\n---\n"), body)).otherwise(body)


def front_matter_tags(content: F.Column) -> F.Column:
    """The tags of a text's front matter, as a list or in brackets."""
    head = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---\n", 1)
    block = F.regexp_extract(head, r"(?m)^tags:\s*\n((?:\s*-\s*.*(?:\n|$))+)", 1)
    inline = F.regexp_extract(head, r"(?m)^tags:\s*\[?([^\]\n]*)\]?\s*$", 1)
    items = F.when(block != "", F.regexp_extract_all(block, F.lit(r"-\s*([^\n]+)"), F.lit(1))).otherwise(F.split(inline, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def write_version(df: DataFrame, root: str) -> str:
    """A new version of a table: data first, pointer last."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}")
    spark.createDataFrame([(f"{name} {df.schema.json()}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return name


def read_version(spark: SparkSession, root: str) -> DataFrame:
    name, kind = spark.read.text(f"{root}/current").first()[0].split(" ", 1)
    return spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{root}/{name}")
