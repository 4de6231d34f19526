"""Results as lines of text: DOT, markdown, Prometheus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(edges: DataFrame) -> DataFrame:
    """A line for each edge, to be written between a graph's braces."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "relation").alias("value"))


def markdown(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("value"))


def prometheus(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    return df.select(F.format_string(f'{metric}{{{label}="%s"}} %s', label, F.col(value).cast("string")).alias("value"))


#: Spaces at the ends of a field stay; a line ends at \n alone, so that a text's own \r stay as they are.
_CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, so that any text comes back as it was."""
    df.write.options(**_CSV, emptyValue='""', nullValue="").csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV, multiLine=True, emptyValue="", nullValue=None).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)
