"""Tables that are written once for many reads: keyed tables, symbol and graph stores, metadata files, an ingest run.

A version is data first and a pointer last, so a run that dies leaves the version before it; what it wrote is not seen.
A keyed table is laid out by the hash of a column: a read of a few keys prunes all other buckets by folder and, inside a
bucket, all other row groups by their sorted keys. Keys that many rows share spread over several files of their bucket.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import tables
from .shared import shared_dir

METADATA = "id string, file_path string, size long, created long, updated long, hash array<int>"


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, root: str) -> bool:
    """Whether a version of a store has been committed."""
    system, path = _path(spark, f"{root}/current/_SUCCESS")
    return system.exists(path)


def _commit(spark: SparkSession, root: str, **about) -> None:
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")


def _current(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/current").first()[0])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, root: str, key: str, order: tuple[str, ...] = (), buckets: int = 64) -> None:
    """A version of df laid out by key, sorted by key and order. Rows are dealt by bucket, and a bucket of many is cut up,
    without a look at them first, which would work them out twice."""
    name, by = uuid.uuid4().hex, ["_bucket", key, *order]
    placed = df.withColumn("_bucket", _bucket(F.col(key), buckets))
    placed.hint("rebalance", "_bucket").sortWithinPartitions(*by).write.partitionBy("_bucket").parquet(f"{root}/{name}")
    _commit(df.sparkSession, root, name=name, key=key, buckets=buckets, schema=json.loads(placed.schema.json()))


def read_keyed(spark: SparkSession, root: str, *values) -> DataFrame:
    """The present version; with values only rows of these keys, by reading their buckets alone."""
    about = _current(spark, root)
    kind = StructType.fromJson(about["schema"])
    rows = spark.read.schema(kind).parquet(f"{root}/{about['name']}")
    if values:
        asked = [F.lit(v).cast(kind[about["key"]].dataType) for v in values]
        rows = rows.filter(F.col("_bucket").isin(*(_bucket(v, about["buckets"]) for v in asked)) & F.col(about["key"]).isin(*asked))
    return rows.drop("_bucket")


def stored(spark: SparkSession, name: str, files: list[str], build: Callable[[str], None]) -> str:
    """The root of a store that is built once for these input files as they are now, and used again by later queries."""
    seen = []
    for f in files:
        system, path = _path(spark, f)
        todo = [system.getFileStatus(path)]
        while todo:
            s = todo.pop()
            todo += list(system.listStatus(s.getPath())) if s.isDirectory() else []
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    root = f"{shared_dir(spark)}/stores/{name}-{hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:32]}"
    if not exists(spark, root):
        build(root)
    return root


class Symbols:
    """Code symbols (id, name, file and more) kept by id, by name and by file."""

    KEYS = ("id", "name", "file")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def write(cls, symbols: DataFrame, root: str, buckets: int = 64) -> Symbols:
        for key in cls.KEYS:
            write_keyed(symbols, f"{root}/{key}", key, tuple(k for k in cls.KEYS if k != key), buckets)
        _commit(symbols.sparkSession, root, keys=cls.KEYS)
        return cls(symbols.sparkSession, root)

    def all(self) -> DataFrame:
        return read_keyed(self.spark, f"{self.root}/id")

    def by(self, key: str, *values) -> DataFrame:
        return read_keyed(self.spark, f"{self.root}/{key}", *values)


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes and edges as one version: readers see both or neither."""
    name = uuid.uuid4().hex
    nodes.write.parquet(f"{root}/{name}/nodes")
    edges.write.parquet(f"{root}/{name}/edges")
    _commit(nodes.sparkSession, root, name=name)


def load_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    name = _current(spark, root)["name"]
    return spark.read.parquet(f"{root}/{name}/nodes"), spark.read.parquet(f"{root}/{name}/edges")


def write_metadata(docs: DataFrame, root: str) -> None:
    """Documents (id, path, content, size, updated_at) as lines of metadata JSON: times in seconds, the hash as bytes."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    at = F.unix_seconds(F.col("updated_at").cast("timestamp"))
    docs.select(F.col("id").cast("string").alias("id"), F.col("path").alias("file_path"), "size", at.alias("created"), at.alias("updated"), numbers.alias("hash")).write.json(root)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """id, path, size, created_at, updated_at and sha256 of the metadata files below a folder, one object in a file or a
    line; files that are no metadata are passed over."""
    raw = spark.read.format("json").schema(METADATA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "false").load(root)
    good = raw.filter("_bad is null and id is not null")
    digits = F.transform("hash", lambda b: F.lower(F.lpad(F.hex(b), 2, "0")))
    return good.select("id", F.col("file_path").alias("path"), "size", F.timestamp_seconds("created").alias("created_at"), F.timestamp_seconds("updated").alias("updated_at"), F.array_join(digits, "").alias("sha256"))


def ingest(spark: SparkSession, tree: DataFrame, repo: str, root: str) -> dict[str, DataFrame]:
    """Documents, symbols and edges of a source tree (repository.files()), written as versioned tables below root.

    Files are read, parsed and written by partitions, so memory is bounded by a partition's files, not by the tree."""
    from . import code, repository

    text = tree.filter("not binary").select("path", F.decode("content", "UTF-8").alias("content"))
    nodes, edges = code.code_graph(text)
    made = {"documents": repository.file_documents(tree, repo), "symbols": nodes, "edges": edges}
    for name, df in made.items():
        tables.write_version(df, f"{root}/{name}")
    return {name: tables.read_version(spark, f"{root}/{name}") for name in made}
