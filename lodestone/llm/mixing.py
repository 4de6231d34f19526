"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

Sources in code-point order (null last) weigh WEIGHTS, repeating, and share SHARE of all words. A target stops at CAP
times its source's size; what it cannot take is shared anew by weight until none is above, which is one level of
target per weight for all sources below their caps. A source's rate (target / size) gives every document whole copies
and a fraction. Fractions are rounded by pivots: two documents compare, one passes as many words' worth of probability
to the other as either can give or hold, the way drawn so that expectations stay, and at least one of them becomes
whole. Each chunk of documents leaves one residual; residuals meet in the chunks of the next level, so a source of n
documents needs log(n) small levels and no task ever holds more than a chunk. The one item left at the top goes to the
nearer whole, so a source misses its target by half of one document's words at most.

Draws are hashes of document keys, so reruns agree whatever the partitioning. Null or empty texts have size 0 and are
never taken. Of rows that agree in doc_id, source and text as many take one copy more as their fractions add up to; what
is left of one row's fraction is rounded like any other, so repeats never make an item heavier than one row. A null
source is a source. An empty table gives an empty result; extra columns are ignored by plan() and kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_hot, n_words, table

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Items that are rounded together; and their least number for another level.
CHUNK = 64
SEED = 20_241
#: Numbers that one row is spread to at once.
SPREAD = 65_536


def sizes(docs: DataFrame) -> DataFrame:
    """One row for each item: its key, the words of one of its rows, and how many rows it has."""
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words().alias("size"))
    return keyed.groupBy("doc_id", "source", "h").agg(F.first("size").alias("size"), F.count("*").alias("rows"))


def targets(items: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target. The windows run over sources, one row each, not over documents."""
    per = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    per = per.select("*", weight.alias("w")).withColumn("full", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    # sources fill up in the order of full / w; the first that does not sets the level of the rest
    final = F.min(F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct(F.col("full") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"]
    return per.select("source", "source_size", "n", F.least(F.col("full"), F.coalesce(final, F.lit(float("inf"))) * F.col("w")).alias("target"))


_ITEM = "struct<h:bigint,key:bigint,size:bigint,mass:double,copies:bigint>"
_STATE = f"struct<open:{_ITEM},done:array<{_ITEM}>>"


def _item(x: Column, mass: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["key"].alias("key"), x["size"].alias("size"), mass.alias("mass"), x["copies"].alias("copies"))


def _pivot(state: Column, b: Column) -> Column:
    """One comparison of the open item a with b; mass is the words that an item's probability stands for."""
    a, done = state["open"], state["done"]
    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    to_b, to_a = F.least(a["mass"], room_b), F.least(b["mass"], room_a)
    draw = (F.pmod(F.xxhash64(a["key"], b["key"], F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    forward = draw * (to_b + to_a) < to_a
    # whole amounts are set, not summed up
    new_a = F.when(forward, F.when(a["mass"] <= room_b, 0.0).otherwise(a["mass"] - room_b)).otherwise(F.when(room_a <= b["mass"], a["size"].cast("double")).otherwise(a["mass"] + b["mass"]))
    new_b = F.when(forward, F.when(room_b <= a["mass"], b["size"].cast("double")).otherwise(b["mass"] + a["mass"])).otherwise(F.when(b["mass"] <= room_a, 0.0).otherwise(b["mass"] - room_a))
    moved = F.struct(_item(a, new_a).alias("a"), _item(b, new_b).alias("b"))

    def settle(m: Column) -> Column:
        x, y = m["a"], m["b"]
        whole = lambda v: (v["mass"] <= 0) | (v["mass"] >= v["size"])
        none = F.lit(None).cast(_ITEM)
        return F.struct(
            F.when(whole(x) & whole(y), none).when(whole(x), y).otherwise(x).alias("open"),
            F.concat(done, F.when(whole(x) & whole(y), F.array(x, y)).when(whole(x), F.array(x)).otherwise(F.array(y))).alias("done"),
        ).cast(_STATE)

    held = F.element_at(F.transform(F.array(moved), settle), 1)
    return F.when(a.isNull(), F.struct(b.alias("open"), done.alias("done")).cast(_STATE)).otherwise(held)


def _level(fractions: DataFrame) -> DataFrame:
    """source, chunk, open (null if nothing is left) and done, for chunks of items."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("key", "h", "size", "mass", "copies"))), lambda x: _item(x, x["mass"]).cast(_ITEM))
    chunks = fractions.groupBy("source", "chunk").agg(items.alias("items"))
    return chunks.select("source", "chunk", F.aggregate("items", start.cast(_STATE), _pivot).alias("s")).select("source", "chunk", "s.*")


def _source_key(source: str = "source") -> Column:
    """A key that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def plan(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, h, size, rows, source_size, target, whole and more, one row for each item: more of its rows are
    taken whole + 1 times, the others whole times."""
    scratch = Scratch(spark, "mix")
    items = scratch.cut(sizes(docs), "items").df
    per = scratch.cut(targets(items, weights, share, cap), "targets").df
    counts = per.agg(F.sum("n").alias("items"), F.max("n").alias("most")).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = per.select(_source_key().alias("_k"), "source_size", "target", "n")
    joined = join_hot(items.withColumn("_k", _source_key()), named, ["_k"], counts["items"] or 0).drop("_k")
    joined = joined.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("all", (F.col("rate") - F.col("whole")) * F.col("rows"))
    joined = joined.withColumn("sure", F.floor("all")).withColumn("p", F.col("all") - F.col("sure"))
    joined = joined.withColumn("key", F.xxhash64("doc_id", "source", "h"))
    # ties between equal keys are broken by h
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
    level = joined.filter(fractional).select("source", F.pmod(F.xxhash64("key", F.lit(SEED)), n_chunks).alias("chunk"), "key", "h", "size", (F.col("p") * F.col("size")).alias("mass"), F.lit(0).cast("bigint").alias("copies"))
    parts, left = [], None
    chunks = max(1, -(-(counts["most"] or 0) // chunk))
    while True:
        out = scratch.cut(_level(level), "level").df
        parts.append(out.select("source", F.explode("done").alias("i")))
        left = out.filter(F.col("open").isNotNull())
        if chunks == 1:
            break
        chunks = -(-chunks // chunk)
        level = left.select("source", F.floor(F.col("chunk") / chunk).alias("chunk"), "open.key", "open.h", "open.size", "open.mass", "open.copies")
    nearer = F.when(2 * F.col("open.mass") >= F.col("open.size"), F.col("open.size")).otherwise(F.lit(0)).cast("double")
    parts.append(left.select("source", F.struct("open.h", "open.key", "open.size", nearer.alias("mass"), "open.copies").alias("i")))
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    rounded = rounded.select(F.col("i.key").alias("k2"), F.col("i.h").alias("h2"), (F.col("i.mass") > 0).cast("bigint").alias("one"))
    kept = joined.filter(~fractional).withColumn("more", F.when(F.col("size") > 0, F.col("sure")).otherwise(F.lit(0)))
    split = joined.filter(fractional).join(rounded, (F.col("key") == F.col("k2")) & (F.col("h") == F.col("h2"))).withColumn("more", F.col("sure") + F.col("one"))
    names = ["doc_id", "source", "h", "size", "rows", "source_size", "target", "whole", "more"]
    return kept.select(*names).unionByName(split.select(*names))


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times, in two steps, so that no row is ever spread to a list of more than SPREAD."""
    outer = df.withColumn("_n", n.cast("bigint")).filter("_n > 0").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / SPREAD))))
    return outer.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(SPREAD), F.col("_n") - F.col("_o") * SPREAD).cast("int")))).drop("_n", "_o", "_i")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = plan(spark, table(spark, sf_dir, "documents"))
    one = made.filter("rows = 1").withColumn("copies", F.col("whole") + F.col("more"))
    many = made.filter("rows > 1")
    extra = _times(many.withColumn("copies", F.col("whole") + 1), F.col("more"))
    plain = _times(many.withColumn("copies", F.col("whole")), F.col("rows") - F.col("more"))
    return one.unionByName(extra).unionByName(plain).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The same columns, each row as often as it is taken. Equal rows go through as one row and their number."""
    scratch = Scratch(spark, "mixed")
    made = scratch.cut(plan(spark, docs, **how).filter("size > 0 and whole + more > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("whole").alias("_w"), F.col("more").alias("_m"), F.col("rows").alias("_r")), "copies").df
    # the row travels as one column, so that its names meet no others
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", F.xxhash64("text").alias("_k"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_h"))
    once = rows.join(made.filter("_r = 1").hint("merge"), same).select("row", (F.col("_w") + F.col("_m")).alias("_c"))
    if not made.filter("_r > 1").take(1):
        return _times(once, F.col("_c")).select("row.*")
    many = rows.groupBy("row", "doc_id", "source", "_k").agg(F.count("*").alias("_rows")).join(made.filter("_r > 1").hint("merge"), same)
    before = W.partitionBy("_d", "_s", "_h").orderBy(F.xxhash64("row")).rowsBetween(W.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least(F.col("_rows"), F.col("_m") - F.coalesce(F.sum("_rows").over(before), F.lit(0))))
    many = many.withColumn("_c", F.col("_w") * F.col("_rows") + more).select("row", "_c")
    return _times(once.unionByName(many), F.col("_c")).select("row.*")
