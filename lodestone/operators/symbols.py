"""Code-symbol search over symbols(id, name, type, file, line, ...), and what can be read off source lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import CODE_PATTERNS, PRIMITIVE_TYPES, SIGNATURE_TYPES, SYMBOL_CODES
from ..functions.paths import any_of, wildcard
from ..functions.text import tokenize
from ..sources.shared import cut


def _letters(x: Column) -> Column:
    return F.array_distinct(F.split(F.lower(x), ""))


def fuzzy_score(name: Column, query: str) -> Column:
    """1 for the name, .8 for a prefix, .6 for a part, half the letters' overlap where that is over a half, else null."""
    q, low = query.lower(), F.lower(name)
    mine, his = _letters(name), F.array(*(F.lit(c) for c in dict.fromkeys(q)))
    overlap = F.size(F.array_intersect(mine, his)) / F.size(F.array_union(mine, his))
    return F.when(low == q, 1.0).when(low.startswith(q), 0.8).when(low.contains(q), 0.6).when(overlap > 0.5, overlap * 0.5)


def fuzzy(symbols: DataFrame, query: str, limit: int = 100, types: list[str] | None = None) -> DataFrame:
    kept = symbols if types is None else symbols.filter(F.col("type").isin(types))
    return kept.withColumn("score", fuzzy_score(F.col("name"), query)).filter("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def by_pattern(symbols: DataFrame, pattern: str, types: list[str] | None = None) -> DataFrame:
    """Wildcard or part of the lower-cased name, one row for each name, file and line."""
    low = F.lower("name")
    hit = wildcard(low, pattern.lower()) if "*" in pattern else low.contains(pattern.lower())
    kept = symbols.filter(hit) if types is None else symbols.filter(hit & F.col("type").isin(types))
    return kept.groupBy("name", "file", "line").agg(F.min("id").alias("id"))


def code_search(symbols: DataFrame, pattern: str, limit: int = 10, offset: int = 0, types: list[str] | None = None) -> DataFrame:
    """A page of by_pattern()'s rows in id order, each with score 1; total counts all of them."""
    found = by_pattern(symbols, pattern, types)
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("id").offset(offset).limit(limit).select("id", "name", "file", "line", F.lit(1.0).alias("score")).crossJoin(F.broadcast(total))


def type_of(code: Column) -> Column:
    """The name of a symbol type's stored code; null for other codes."""
    return F.get(F.array(*map(F.lit, SYMBOL_CODES)), code.cast("int"))


def signature_tokens(text: Column) -> Column:
    """The type words, in lower case, that stand in a signature."""
    return F.array_compact(F.array(*(F.when(text.contains(t), t.lower()) for t in SIGNATURE_TYPES)))


def signature_search(symbols: DataFrame, signature: Column, pattern: str, limit: int = 1000) -> DataFrame:
    """Symbols whose signature holds a type word of the pattern, by the share of the pattern's tokens that they hold."""
    asked = [t for t in re.split(r"[^\w]+", pattern.lower()) if t]
    held = F.size(F.filter(F.array(*map(F.lit, asked)), lambda t: F.array_contains(tokenize(signature), t)))
    found = any_of(signature.contains(t) for t in SIGNATURE_TYPES if t.lower() in asked)
    return symbols.filter(found).withColumn("relevance", held / float(max(1, len(asked)))).orderBy(F.desc("relevance"), "id").limit(limit)


def dependency_search(symbols: DataFrame, deps: DataFrame, of: DataFrame) -> DataFrame:
    """deps (id, dep: a name) of the symbols of, each with the first symbol of that name; an import if there is none."""
    first = symbols.groupBy("name").agg(F.min("id").alias("target"))
    named = deps.join(of.select("id"), "id", "left_semi").join(first, deps["dep"] == first["name"], "left")
    found = F.col("target").isNotNull()
    return named.select("id", "dep", "target", F.when(found, "symbol").otherwise("import").alias("kind"), F.when(found, 1.0).otherwise(0.5).alias("relevance"))


def pattern_search(symbols: DataFrame, text: Column, pattern: str, scope: str = "all", limit: int = 1000) -> DataFrame:
    """A built-in or own regular expression over functions, comments, imports or everything."""
    scopes = {"functions": F.col("type").isin("function", "method"), "imports": F.col("type") == "import", "comments": F.col("type") == "comment", "all": F.lit(True)}
    return symbols.filter(scopes[scope] & text.rlike(CODE_PATTERNS.get(pattern, pattern))).orderBy("id").limit(limit)


def combine_and(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.join(o.select("id"), "id", "left_semi")
    return first


def combine_or(*parts: DataFrame) -> DataFrame:
    """Each id once, with its best score (id, score)."""
    out = parts[0].select("id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("id", "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))


def combine_not(first: DataFrame, *without: DataFrame) -> DataFrame:
    for w in without:
        first = first.join(w.select("id"), "id", "left_anti")
    return first


def token_index(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.explode(F.array_distinct(tokenize(F.col("name")))).alias("token"), "id")


def replace_file(symbols: DataFrame, file: str, new: DataFrame) -> DataFrame:
    """The symbols with one file's replaced."""
    return symbols.filter(F.col("file") != file).unionByName(new)


def name_similarity(a: Column, b: Column) -> Column:
    """Share of a common prefix, with bonuses for having one and for containment; 1 for equal, .95 but for case."""
    la, lb = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    n = F.least(F.length(la), F.length(lb))
    common = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(la, i, F.lit(1)) == F.substring(lb, i, F.lit(1))), i).otherwise(s))
    common = F.when(n > 0, common).otherwise(0)
    score = common / longest + F.when(common > 0, 0.1).otherwise(0.0) + F.when(la.contains(lb) | lb.contains(la), 0.2).otherwise(0.0)
    return F.when(a == b, 1.0).when(la == lb, 0.95).otherwise(F.least(score, F.lit(1.0)))


def resolve_name(names: DataFrame, query: str, least: float = 0.3) -> DataFrame:
    """The one symbol (id, qualified) that a loose name means, with how it was found."""
    q, low = F.col("qualified"), query.lower()
    simple = F.element_at(F.split(q, "::"), -1)
    score = name_similarity(F.lit(query), simple)
    loose = (F.lower(simple).contains(low) | F.lit(low).contains(F.lower(simple))) & (score > least)
    how = F.when(q == query, 0).when(q.endswith(f"::{query}"), 1).when(q.contains(f"{query}::"), 2).when(F.lower(q) == low, 3).when(loose, 4)
    ranked = names.withColumn("how", how).filter("how is not null").withColumn("similarity", score)
    return ranked.orderBy("how", F.when(F.col("how") == 4, -F.col("similarity")).otherwise(0.0), F.length("qualified"), "qualified", "id").limit(1)


def import_target(line: Column) -> Column:
    """What an import line names: Rust's first segment, JavaScript's quoted module, Python's module; null for others."""
    x = F.trim(line)
    pick = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    word = pick(r"^import (\s*\S+)")
    quoted = F.when(x.contains(" from "), pick(r"^import .*? from [^'\"]*['\"]([^'\"]*)['\"]")).otherwise(pick(r"^import [^'\"]*['\"]([^'\"]*)['\"]"))
    return F.trim(F.when(x.startswith("use "), pick(r"^use ([^:]*)")).otherwise(F.coalesce(quoted, word, pick(r"^from (\s*\S+)"))))


def simple_reference(line: Column) -> Column:
    """The last word before a line's first opening bracket, without signs in front of it; null if there is none."""
    before = F.regexp_extract(F.trim(line), r"^([^(]+)\(", 1)
    return F.nullif(F.regexp_replace(F.regexp_extract(before, r"(\S+)\s*$", 1), r"^[^\p{L}\p{N}_]+", ""), F.lit(""))


IDENTIFIER = r"[\p{L}_][\p{L}\p{N}_:]*"


def is_identifier(x: Column) -> Column:
    return x.rlike(f"^{IDENTIFIER}$")


def is_primitive(x: Column) -> Column:
    return x.isin(*PRIMITIVE_TYPES)


def text_dependencies(text: Column) -> Column:
    """Sorted distinct names that a symbol's text calls, uses as a type, or runs as a macro, by its lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    plain = F.filter(lines, lambda line: ~line.startswith("//") & ~line.startswith("/*"))

    def last_word(line: Column, mark: str, ends: str) -> Column:
        return F.regexp_extract(line, rf"^(?:[^{mark}]*[{ends}])?([^{ends}{mark}]*){mark}", 1)

    def annotated(line: Column, mark: str) -> Column:
        after = F.trim(F.when(line.contains(mark), F.substring(line, F.instr(line, mark) + len(mark), F.length(line))).otherwise(""))
        generic = F.when(after.contains("<"), F.substring_index(after, "<", 1)).otherwise("")
        bare = F.regexp_replace(F.regexp_extract(after, r"^(\S+)", 1), r"[,;{)}]+$", "")
        return F.when(is_identifier(generic), generic).when(~is_primitive(bare), bare).otherwise("")

    calls = F.transform(plain, lambda line: last_word(line, r"\(", r" \t={;,!"))
    types = F.flatten(F.array(F.transform(plain, lambda line: annotated(line, ":")), F.transform(plain, lambda line: annotated(line, "->"))))
    macros = F.transform(lines, lambda line: last_word(line, "!", r" \t({;"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(calls, types, macros), is_identifier)))


def visibility(text: Column) -> Column:
    return F.when(text.startswith("pub("), "internal").when(text.startswith("pub ") | text.startswith("export ") | text.startswith("public "), "public").when(text.startswith("protected "), "protected").when(text.startswith("private ") | text.startswith("_"), "private").otherwise("unknown")


def parents(spans: DataFrame) -> DataFrame:
    """Spans (id, file, start, end) with parent: the narrowest one that encloses them; among equal spans the smaller id.

    No two spans are paired. A span lies in a cell of 2 ** level starts on each level; what starts before another fills
    some of those cells, one a level at the most. In a cell, read from the greatest end down, the narrowest span so far is
    the narrowest that ends no earlier. What starts at the same place is nested by its ends alone."""
    known = spans.select("id", "file", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).dropna().distinct()
    wide = F.col("end") - F.col("start")
    one = known.groupBy("file", "start", "end").agg(F.max("id").alias("p")).withColumn("b", F.struct((-wide).alias("w"), "p")).drop("p")
    range_ = one.agg(F.min("start").alias("base"), F.max("start").alias("last"))  # one row
    placed = one.crossJoin(F.broadcast(range_)).withColumn("at", F.expr("start - base"))
    levels = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("last") - F.col("base"))) - 1)).alias("level")
    dealt = placed.select("file", "start", "end", "b", "at", levels).withColumn("cell", F.expr("shiftright(at, level)"))
    # what comes before a place: at each level where its cell is odd, the cell in front of it
    holders = dealt.filter(F.expr("cell & 1") == 0).groupBy("file", "level", "cell", "end").agg(F.max("b").alias("b"))
    asked = dealt.filter(F.expr("cell & 1") == 1).select("file", "level", (F.col("cell") - 1).alias("cell"), "start", "end")
    both = holders.withColumn("start", F.lit(None).cast("bigint")).unionByName(asked.withColumn("b", F.lit(None).cast(holders.schema["b"].dataType)))
    down = W.partitionBy("file", "level", "cell").orderBy(F.desc("end"), F.asc_nulls_first("start")).rowsBetween(W.unboundedPreceding, 0)
    before = both.withColumn("b", F.max("b").over(down)).filter("start is not null and b is not null").select("file", "start", "end", "b")
    beside = one.select("file", "start", "end", F.lead("b").over(W.partitionBy("file", "start").orderBy("end")).alias("b")).filter("b is not null")
    outer = before.unionByName(beside).groupBy("file", "start", "end").agg(F.max("b").alias("b"))
    equal = known.withColumn("_e", F.lag("id").over(W.partitionBy("file", "start", "end").orderBy("id")))
    found = F.when(F.col("_e").isNotNull(), F.struct((-wide).alias("w"), F.col("_e").alias("p"))).otherwise(F.col("b"))
    best = equal.join(outer, ["file", "start", "end"], "left").groupBy("id").agg(F.max(found)["p"].alias("parent"))
    return spans.join(best, "id", "left")


def qualified(nested: DataFrame) -> DataFrame:
    """parents()'s rows with a name each, and qualified: the names from the outermost level on, by ::, however deep.

    Each round doubles the levels that are joined: a name so far, and the symbol above it. Whole names are written once and
    ask for nothing more."""
    at = cut(nested.select("id", F.col("name").alias("qualified"), F.col("parent").alias("up")))
    done, left = [at.filter("up is null")], at.filter("up is not null")
    while left.take(1):
        above = reduce(DataFrame.unionByName, done, left).select(F.col("id").alias("up"), F.col("qualified").alias("q"), F.col("up").alias("next"))
        made = cut(left.join(above, "up", "left").select("id", F.concat_ws("::", "q", "qualified").alias("qualified"), F.col("next").alias("up")))
        done.append(made.filter("up is null"))
        left = made.filter("up is not null")
    return nested.join(reduce(DataFrame.unionByName, done).select("id", "qualified"), "id")


def any_term(symbols: DataFrame, terms: list[str], limit: int = 100) -> DataFrame:
    """The ids that a fuzzy search for any of the terms finds."""
    out = fuzzy(symbols, terms[0], limit).select("id")
    for t in terms[1:]:
        out = out.unionByName(fuzzy(symbols, t, limit).select("id"))
    return out.distinct()


def symbol_id(path: Column, parent: Column, name: Column, kind: Column, line: Column, column: Column) -> Column:
    """An id that is the same for the same symbol at the same place, in the form of a random UUID."""
    h = F.sha2(F.concat_ws("\n", path, F.coalesce(parent, F.lit("")), name, kind, line, column), 256)
    digit = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))
