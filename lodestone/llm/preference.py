"""Preference formatting: one prompt for two conversations' common turns, and two masked completions.

Turns of a pair are aligned by their number (and, where a conversation repeats a number, by role and text order). The
prompt is the longest common prefix: the turns before the first place at which either side lacks a turn or they
differ. It is rendered once with mask 0; what follows on each side is a completion, whose assistant turns have mask 1
(they are learnt) and others 0. The result has a row for each rendered turn, so a conversation of any length is never
gathered; render() joins short ones.

pair_by_opening() makes pairs from a table of conversations: those that share their first turn, two by two in conv_id
order within blocks of ids; odd ones meet in blocks of blocks. A conversation without partner is chosen, with an empty
rejected side.

Null roles and texts equal themselves and render as empty. Rows without conv_id are left out; a null turn comes before
the others. Repeated rows are turns of their own, in a row. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

LEARNT = "assistant"
#: Conversation ids in a block, and levels of blocks of so many blocks.
BLOCK, LEVELS = 1024, 6


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (turn, k), role and text; k tells repeated turn numbers apart."""
    same = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.withColumn("place", F.struct("turn", (F.row_number().over(same) - 1).alias("k"))).drop("turn")


def pair_by_opening(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """chosen and rejected (null without partner), each conversation in one pair. A level is written once: its pairs and
    what it leaves to the next are read from there."""
    first = turns.groupBy("conv_id").agg(F.min(F.struct("place", F.xxhash64("role", "text").alias("h")))["h"].alias("opening"))
    left, pairs = first, None
    for level in range(1, LEVELS + 1):
        block = F.floor(F.col("conv_id") / BLOCK**level) if level < LEVELS else F.lit(0)
        here = W.partitionBy("opening", block).orderBy("conv_id")
        n = F.row_number().over(here)
        marked = left.select("*", n.alias("n"), F.lead("conv_id").over(here).alias("next"))
        odd = scratch.cut(marked.filter(F.col("n") % 2 == 1).drop("n"), "level").df
        made = odd.filter(F.col("next").isNotNull()).select(F.col("conv_id").alias("chosen"), F.col("next").alias("rejected"))
        pairs = made if pairs is None else pairs.unionByName(made)
        left = odd.filter(F.col("next").isNull()).select("conv_id", "opening")
    return pairs.unionByName(left.select(F.col("conv_id").alias("chosen"), F.lit(None).cast(left.schema["conv_id"].dataType).alias("rejected")))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id (the chosen conversation's), rejected_id, part, turn, k, role, rendered and mask for every turn."""
    a = pairs.join(turns, F.col("chosen") == F.col("conv_id")).select("chosen", "place", F.struct("role", "text").alias("a"))
    b = pairs.filter(F.col("rejected").isNotNull()).join(turns, F.col("rejected") == F.col("conv_id")).select("chosen", "place", F.struct("role", "text").alias("b"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("chosen", "place").agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    split = both.groupBy("chosen").agg(F.min(F.when(differs, F.col("place"))).alias("split"))
    rows = both.join(split, "chosen").join(pairs.select(F.col("chosen").alias("c"), "rejected"), F.col("chosen") == F.col("c")).drop("c")
    common = F.col("split").isNull() | (F.col("place") < F.col("split"))
    side = lambda part, x: F.struct(F.lit(part).alias("part"), F.col(x).alias("t"))
    parts = F.when(common, F.array(side("prompt", "a"))).otherwise(F.array_compact(F.array(F.when(F.col("a").isNotNull(), side("chosen", "a")), F.when(F.col("b").isNotNull(), side("rejected", "b")))))
    out = rows.select("chosen", "rejected", "place", F.explode(parts).alias("p"))
    mask = ((F.col("p.part") != "prompt") & F.coalesce(F.col("p.t.role") == LEARNT, F.lit(False))).cast("int")
    return out.select(F.col("chosen").alias("pair_id"), F.col("rejected").alias("rejected_id"), F.col("p.part").alias("part"), "place.turn", "place.k", F.col("p.t.role").alias("role"), rendered(F.col("p.t.role"), F.col("p.t.text")).alias("rendered"), mask.alias("mask"))


def render(formatted: DataFrame) -> DataFrame:
    """One row for each pair: prompt, chosen and rejected texts. Only for pairs that fit in a row."""
    part = lambda name: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("part", "turn", "k", "rendered")), lambda x: x["part"] == name)), lambda x: x["rendered"]), "")
    return formatted.groupBy("pair_id", "rejected_id").agg(part("prompt").alias("prompt"), part("chosen").alias("chosen"), part("rejected").alias("rejected"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "preference")
    turns = numbered(table(spark, sf_dir, "conversations"))
    pairs = scratch.cut(pair_by_opening(scratch, turns), "pairs").df
    return format_pairs(turns, pairs)


def _levels() -> str:
    """The pairing's levels in SQL, one common table for each."""
    out, left = "", "opening"
    for level in range(1, LEVELS + 1):
        block = f"floor(conv_id / {BLOCK**level}.0)" if level < LEVELS else "0"
        out += f"""
             m{level} AS (SELECT conv_id, r, x, row_number() OVER w AS n, lead(conv_id) OVER w AS next FROM {left}
                          WINDOW w AS (PARTITION BY r, x, {block} ORDER BY conv_id)),
             l{level} AS (SELECT conv_id, r, x FROM m{level} WHERE n % 2 = 1 AND next IS NULL),"""
        left = f"l{level}"
    return out


ORACLE_SQL = {
    "op8_preference": f"""
        WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS k, role, text
                   FROM conversations WHERE conv_id IS NOT NULL),
             opening AS (SELECT conv_id, role AS r, text AS x FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) = 1),
             {_levels().strip()}
             pairs AS ({" UNION ALL ".join(f"SELECT conv_id AS c, next AS j FROM m{i} WHERE n % 2 = 1 AND next IS NOT NULL" for i in range(1, LEVELS + 1))}
                       UNION ALL SELECT conv_id, NULL FROM l{LEVELS}),
             a AS (SELECT c, turn, k, role, text, 1 AS has FROM pairs JOIN t ON c = conv_id),
             b AS (SELECT c, turn, k, role, text, 1 AS has FROM pairs JOIN t ON j = conv_id),
             f AS (SELECT coalesce(a.c, b.c) AS c, coalesce(a.turn, b.turn) AS turn, coalesce(a.k, b.k) AS k, a.has AS ha, b.has AS hb,
                          a.role AS ra, a.text AS xa, b.role AS rb, b.text AS xb
                   FROM a FULL JOIN b ON a.c = b.c AND a.turn IS NOT DISTINCT FROM b.turn AND a.k = b.k),
             s AS (SELECT *, sum(CASE WHEN ha IS NULL OR hb IS NULL OR ra IS DISTINCT FROM rb OR xa IS DISTINCT FROM xb THEN 1 ELSE 0 END)
                               OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS bad FROM f),
             u AS (SELECT c, 'prompt' AS part, turn, k, ra AS role, xa AS text FROM s WHERE bad = 0
                   UNION ALL SELECT c, 'chosen', turn, k, ra, xa FROM s WHERE bad > 0 AND ha = 1
                   UNION ALL SELECT c, 'rejected', turn, k, rb, xb FROM s WHERE bad > 0 AND hb = 1)
        SELECT u.c AS pair_id, j AS rejected_id, part, turn, k, role,
               '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS rendered,
               CASE WHEN part <> 'prompt' AND role = '{LEARNT}' THEN 1 ELSE 0 END AS mask
        FROM u JOIN pairs ON u.c = pairs.c"""
}
