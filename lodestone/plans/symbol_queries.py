"""Symbol queries over parts as symbols; the supplier of a part is what it depends on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import symbols as S
from . import model
from .model import SYMBOLS

NAME = "green"
RETURNED = ("bool", "Option<i64>", "Result<u32, Error>", "usize", "Vec<f64>")


def _s(spark, sf_dir):
    return model.symbols(spark, sf_dir)


def symbol_exact(spark, sf_dir):
    first = _s(spark, sf_dir).agg(F.min("name").alias("name"))
    return _s(spark, sf_dir).join(F.broadcast(first), "name").select("id", "name", "type", "file", "line")


def symbol_fuzzy(spark, sf_dir):
    return S.fuzzy(_s(spark, sf_dir), NAME, 200).select("id", "name", F.round("score", 6).alias("score"))


def symbol_wildcard(spark, sf_dir):
    return S.by_pattern(_s(spark, sf_dir), "*e*n*")


def symbol_contains_type(spark, sf_dir):
    return S.by_pattern(_s(spark, sf_dir), "re", ["STANDARD", "PROMO", "ECONOMY"])


def signature_search(spark, sf_dir):
    returned = F.get(F.array(*map(F.lit, RETURNED)), (F.col("id") % len(RETURNED)).cast("int"))
    sig = F.concat(F.lit("fn "), F.replace("name", F.lit(" "), F.lit("_")), F.lit("(x: &str) -> "), returned)
    return S.signature_search(_s(spark, sf_dir), sig, "fn (bool) -> Option<i64>", 300).select("id", F.round("relevance", 6).alias("relevance"))


def dependency_search(spark, sf_dir):
    s = _s(spark, sf_dir)
    deps = s.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("ext_"), "name")).otherwise(F.reverse(F.reverse("name"))).alias("dep"))
    return S.dependency_search(s, deps, s.filter("line <= 10"))


def pattern_search(spark, sf_dir):
    return S.pattern_search(_s(spark, sf_dir), F.col("name"), r"(?:^|\s)[a-m]\w*e", "all", 400).select("id", "name")


def combine_and(spark, sf_dir):
    s = _s(spark, sf_dir)
    return S.combine_and(S.by_pattern(s, "e"), s.filter("line > 20"), s.filter("price > 950")).select("id")


def combine_or(spark, sf_dir):
    s = _s(spark, sf_dir)
    return S.combine_or(S.fuzzy(s, NAME, 150), s.filter("line = 7").withColumn("score", F.lit(0.5))).withColumn("score", F.round("score", 6))


def combine_not(spark, sf_dir):
    s = _s(spark, sf_dir)
    return S.combine_not(S.by_pattern(s, "*"), s.filter("line > 20"), s.filter("price < 950")).select("id")


def token_index(spark, sf_dir):
    return S.token_index(_s(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("symbols"))


def name_resolution(spark, sf_dir):
    names = _s(spark, sf_dir).select("id", F.concat_ws("::", F.lower("type"), "name").alias("qualified"))
    return S.resolve_name(names, "standard").select("id", "qualified", "how")


def overview(spark, sf_dir):
    s = _s(spark, sf_dir)
    part = lambda what, c: s.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    total = s.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit("symbols").alias("value"), "n")
    top = s.groupBy(F.col("name").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10).select(F.lit("top").alias("what"), "value", "n")
    return total.unionByName(part("type", "type")).unionByName(part("file", "file")).unionByName(top)


QUERIES = {f.__name__: f for f in (symbol_exact, symbol_fuzzy, symbol_wildcard, symbol_contains_type, signature_search, dependency_search, pattern_search, combine_and, combine_or, combine_not, token_index, name_resolution, overview)}

_LETTERS = "list_distinct(string_split(lower(name), ''))"
_Q = "list_distinct(string_split('green', ''))"
_OVERLAP = f"len(list_intersect({_LETTERS}, {_Q}))::DOUBLE / len(list_distinct(list_concat({_LETTERS}, {_Q})))"
_FUZZY = f"CASE WHEN lower(name) = 'green' THEN 1.0 WHEN lower(name) LIKE 'green%' THEN 0.8 WHEN contains(lower(name), 'green') THEN 0.6 WHEN {_OVERLAP} > 0.5 THEN {_OVERLAP} * 0.5 END"
_SIG = f"'fn ' || replace(name, ' ', '_') || '(x: &str) -> ' || ({list(RETURNED)}::VARCHAR[])[id % {len(RETURNED)} + 1]"
_TOK = "string_split_regex(lower(sig), '[^\\p{L}\\p{N}_]+')"
ORACLE = {
    "symbol_exact": f"WITH {SYMBOLS} SELECT id, name, type, file, line FROM symbols WHERE name = (SELECT min(name) FROM symbols)",
    "symbol_fuzzy": f"WITH {SYMBOLS}, f AS (SELECT id, name, ({_FUZZY})::DOUBLE AS score FROM symbols) SELECT id, name, round(score, 6) AS score FROM f WHERE score IS NOT NULL ORDER BY f.score DESC, id LIMIT 200",
    "symbol_wildcard": f"WITH {SYMBOLS} SELECT name, file, line, min(id) AS id FROM symbols WHERE lower(name) LIKE '%e%n%' GROUP BY ALL",
    "symbol_contains_type": f"WITH {SYMBOLS} SELECT name, file, line, min(id) AS id FROM symbols WHERE contains(lower(name), 're') AND type IN ('STANDARD', 'PROMO', 'ECONOMY') GROUP BY ALL",
    "signature_search": f"WITH {SYMBOLS}, g AS (SELECT id, {_SIG} AS sig FROM symbols), r AS (SELECT id, len(list_filter(['fn', 'bool', 'option', 'i64'], lambda t: list_contains({_TOK}, t))) / 4.0 AS relevance FROM g WHERE contains(sig, 'i64') OR contains(sig, 'bool') OR contains(sig, 'Option')) SELECT id, round(relevance, 6) AS relevance FROM r ORDER BY r.relevance DESC, id LIMIT 300",
    "dependency_search": f"""WITH {SYMBOLS}, d AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'ext_' || name ELSE name END AS dep FROM symbols WHERE line <= 10), f AS (SELECT name, min(id) AS target FROM symbols GROUP BY name)
        SELECT d.id, dep, target, CASE WHEN target IS NULL THEN 'import' ELSE 'symbol' END AS kind, CASE WHEN target IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS relevance FROM d LEFT JOIN f ON dep = name""",
    "pattern_search": f"WITH {SYMBOLS} SELECT id, name FROM symbols WHERE regexp_matches(name, '(?:^|\\s)[a-m]\\w*e') ORDER BY id LIMIT 400",
    "combine_and": f"WITH {SYMBOLS}, p AS (SELECT name, file, line, min(id) AS id FROM symbols WHERE contains(lower(name), 'e') GROUP BY ALL) SELECT id FROM p WHERE id IN (SELECT id FROM symbols WHERE line > 20) AND id IN (SELECT id FROM symbols WHERE price > 950)",
    "combine_or": f"WITH {SYMBOLS}, f AS (SELECT id, ({_FUZZY})::DOUBLE AS score FROM symbols), t AS (SELECT * FROM f WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 150), u AS (SELECT * FROM t UNION ALL SELECT id, 0.5 FROM symbols WHERE line = 7) SELECT id, round(max(score), 6) AS score FROM u GROUP BY id",
    "combine_not": f"WITH {SYMBOLS}, p AS (SELECT name, file, line, min(id) AS id FROM symbols GROUP BY ALL) SELECT id FROM p WHERE id NOT IN (SELECT id FROM symbols WHERE line > 20) AND id NOT IN (SELECT id FROM symbols WHERE price < 950)",
    "token_index": f"WITH {SYMBOLS}, t AS (SELECT DISTINCT id, unnest(string_split_regex(lower(name), '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM symbols) SELECT token, count(*) AS symbols FROM t WHERE token <> '' GROUP BY token",
    "name_resolution": f"WITH {SYMBOLS}, q AS (SELECT id, lower(type) || '::' || name AS qualified FROM symbols) SELECT id, qualified, 2 AS how FROM q WHERE contains(qualified, 'standard::') ORDER BY length(qualified), qualified, id LIMIT 1",
    "overview": f"""WITH {SYMBOLS} SELECT 'total' AS what, 'symbols' AS value, count(*) AS n FROM symbols UNION ALL SELECT 'type', type, count(*) FROM symbols GROUP BY type UNION ALL SELECT 'file', file, count(*) FROM symbols GROUP BY file
        UNION ALL SELECT * FROM (SELECT 'top', name, count(*) AS n FROM symbols GROUP BY name ORDER BY n DESC, name LIMIT 10)""",
}
