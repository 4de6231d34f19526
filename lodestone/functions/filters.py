"""A JSON filter language as columns, a timeline, and routing of plain requests to query kinds."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_filter(spec: dict) -> Column:
    """{"field": {"$gte": 3}}, {"$or": [...]}, {"$not": {...}}: a boolean column, so filters reach the scan.

    $contains asks a text for a part, or an array for every item of a list."""
    compare = {
        "$eq": lambda c, v: c.eqNullSafe(v), "$ne": lambda c, v: ~c.eqNullSafe(v), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
        "$in": lambda c, v: c.isin(*v), "$match": lambda c, v: c.rlike(v), "$exists": lambda c, v: c.isNotNull() if v else c.isNull(), "$contains": lambda c, v: c.contains(v) if isinstance(v, str) else F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
    }
    parts = []
    for name, want in spec.items():
        if name in ("$and", "$or"):
            parts.append(reduce(and_ if name == "$and" else or_, map(compile_filter, want)))
        elif name == "$not":
            parts.append(~compile_filter(want))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(want, dict):
            for op, value in want.items():
                if op not in compare:
                    raise ValueError(f"unknown operator {op}")
                parts.append(compare[op](F.col(name), value))
        else:
            parts.append(F.col(name).eqNullSafe(want))
    return reduce(and_, parts) if parts else F.lit(True)


def timeline(df: DataFrame, ts: str, unit: str, *by: str) -> DataFrame:
    return df.groupBy(*by, F.date_trunc(unit, ts).alias("at")).agg(F.count("*").alias("n"))


def followed_by(df: DataFrame, key: str, ts: str, first: Column, then: Column, seconds: int) -> DataFrame:
    """Rows that match first and have a later row of the same key that matches then within some seconds.

    One window by key, whose frame is the interval ahead; the rows of a key need no memory together."""
    from pyspark.sql import Window as W

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ahead = W.partitionBy(key).orderBy(at).rangeBetween(1, seconds * 1_000_000)
    return df.withColumn("_then", F.count_if(then).over(ahead)).filter(first & (F.col("_then") > 0)).drop("_then")


INTENTS = {"callers": r"\b(?:who|what)\s+calls\b|\bcallers?\s+of\b", "impact": r"\bimpact\b|\bwhat\s+breaks\b|\bdepends?\s+on\b", "callees": r"\bcallees?\b|\bcalled\s+by\b", "unused": r"\bunused\b|\bdead\s+code\b", "symbol": r"\b(?:function|class|struct|method)\b", "overview": r"\boverview\b|\bsummary\b"}


def intent(request: Column) -> Column:
    """The query kind that a plain request asks for; search if none."""
    low, out = F.lower(request), None
    for name, pattern in INTENTS.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("search")
