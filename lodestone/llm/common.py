"""What the operators of this subpackage share: shared scratch space, tables, and whole-text Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Rows whose texts are held as Python objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written below the shared folder, so that a lost executor costs no more than its own tasks.

    drop() removes those that no later plan reads. What a result still reads stays until the folder is emptied.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def cut(self, df: DataFrame, name: str) -> Cut:
        at = self.path(name)
        df.write.parquet(at)
        return Cut(self.spark, at, df.schema)

    def close(self) -> None:
        remove(self.spark, self.root)


class Cut:
    """A written table: df reads it again, drop() removes it."""

    def __init__(self, spark: SparkSession, at: str, schema):
        self.spark, self.at = spark, at
        self.df = spark.read.schema(schema).parquet(at)

    def drop(self) -> None:
        remove(self.spark, self.at)


def remove(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that join_hot() broadcasts at most.
HOT = 4096


def join_hot(rows: DataFrame, unique: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined to unique, which has one row for each value of keys, with n: how many of the rows have it.

    No more than HOT values can have over total / HOT rows each. Those are broadcast; the others meet by hash, where one
    value cannot give a task more than that share."""
    few = F.col(n) <= total // HOT
    hot = unique.filter(~few).select(*keys, F.struct(*(c for c in unique.columns if c not in keys)).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    met = marked.filter("_hot is not null").select(*rows.columns, "_hot.*")
    return met.unionByName(marked.filter("_hot is null").drop("_hot").join(unique.filter(few), keys))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def map_texts(df: DataFrame, columns: Iterable[str], make: Callable[[], Callable[..., tuple]], schema: pa.Schema | str, keep: Iterable[str] = ()) -> DataFrame:
    """Each row's columns through a Python function, a slice of an Arrow batch at a time.

    make() runs once in a task and returns the function; its tuples fill schema's columns after those of keep.
    """
    columns, keep = list(columns), list(keep)
    spark_schema = schema if isinstance(schema, str) else None
    kept = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = make(), arrow_types(spark_schema)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
                made = list(zip(*rows, strict=True)) or [()] * len(out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(v, t) for v, (_, t) in zip(made, out, strict=True)], keep + [n for n, _ in out]
                )

    need = list(dict.fromkeys([*keep, *columns]))
    return df.select(*need).mapInArrow(run, ", ".join(x for x in (kept, spark_schema) if x))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def n_words(text: str = "text"):
    """Runs of other characters than ASCII white space; null has none. Linear in the text, without an array of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
