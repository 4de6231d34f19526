"""Where a query stands in code: places of its matches, and the definitions around them."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rerank import context_type, snippet

# How definitions begin, the lines looked at before a match and after a definition's begin, how many
# definitions a snippet holds, its bytes at the most, and what stands between them.
DEFINITION = re.compile(r"(?:pub )?(?:fn|struct|enum|impl|trait) ")
COMMENT = ("//", "/*", "*")
BEFORE, AFTER, MOST_DEFINITIONS, MOST_BYTES, BETWEEN = 21, 100, 3, 4096, "\n\n// ---\n\n"
TERM_MATCHES = 10

_QUOTED = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|\'(?:\\.|[^\'\\])*(?:\'|$)', re.S)


class Braces:
    """A text's lines with the depth of braces before each; strings and comment lines have none."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        bare = ["" if x.strip().startswith(COMMENT) else _QUOTED.sub("", x.strip()) for x in self.lines]
        self.opens = ["{" in x for x in bare]
        self.depth = list(accumulate((x.count("{") - x.count("}") for x in bare), initial=0))
        self.begins = [bool(DEFINITION.match(x.strip())) for x in self.lines]

    def around(self, line: int) -> str | None:
        """The nearest definition that begins at or before a line and is not closed before it, with its lines' numbers."""
        start = next((i for i in range(line, max(-1, line - BEFORE - 1), -1) if self.begins[i] and self.depth[line + 1] >= self.depth[i]), None)
        if start is None:
            return None
        opened, end = False, line
        for i in range(start, len(self.lines)):
            opened = opened or self.opens[i]
            if opened and self.depth[i + 1] <= self.depth[start]:
                end = i
                break
            if i - start > AFTER:
                end = start + AFTER
                break
        if end < start:
            return None
        numbers = f"Line {start + 1}" if start == end else f"Lines {start + 1}-{end + 1}"
        return f"// {numbers}\n" + "\n".join(self.lines[start : end + 1])


def definitions(text: str | None, query: str) -> str | None:
    """The definitions around the first matches of a query; null if there are none."""
    if not text or not query:
        return None
    low, braces, found, at = text.lower(), None, [], 0
    while len(found) < MOST_DEFINITIONS and (at := low.find(query.lower(), at)) >= 0:
        braces = braces or Braces(text)
        line = low.count("\n", 0, at)
        one = braces.around(line) if line < len(braces.lines) else None
        found += [one] if one else []
        at += len(query)
    return BETWEEN.join(found) or None


def code_snippet(content: Column, query: str, most: int = 200) -> Column:
    """The whole text if it fits; else the definitions around the matches if they are short enough; else a window."""

    @F.pandas_udf("string")
    def around(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: definitions(t, query), na_action="ignore")

    code = F.when(F.length(content) > most, around(content))
    return F.when(F.octet_length(code) <= min(2 * most, MOST_BYTES), code).otherwise(snippet(content, query, most))


def _places(low: Column, part: str) -> Column:
    """Starts (from 0) of a text's matches, from left to right without overlaps."""
    gaps = F.split(low, "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    sizes = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.length(g))
    none = F.array().cast("array<int>")
    step = lambda s, n: F.struct((s["at"] + n + len(part)).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all"))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda s: s["all"])


def match_locations(content: Column, query: str, window: int = 50) -> Column:
    """kind (exact or term), start, end, context and context_type of a query's matches: all of the whole query, and of
    its terms up to TERM_MATCHES, but one of each term that stands in the text at all."""
    low, q = F.lower(content), query.lower()

    def matches(kind: str, part: str) -> Column:
        return F.transform(_places(low, part), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("start"), (p + len(part)).alias("end")))

    terms = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    for term in q.split():
        terms = F.concat(terms, F.slice(matches("term", term), F.lit(1), F.greatest(F.lit(1), F.lit(TERM_MATCHES) - F.size(terms))))

    def described(m: Column) -> Column:
        begin = F.greatest(m["start"] - window, F.lit(0))
        near = F.substring(content, begin + 1, m["end"] + window - begin)
        kind = F.substring(content, F.greatest(m["start"] - 50, F.lit(0)) + 1, m["start"] + 50 - F.greatest(m["start"] - 50, F.lit(0)))
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("..."), F.trim(near), F.lit("...")).alias("context"), context_type(kind).alias("context_type"))

    return F.transform(F.concat(matches("exact", q), terms), described)


def match_type(locations: Column) -> Column:
    exact = F.exists(locations, lambda m: m["kind"] == "exact")
    return F.when(exact, "exact_phrase").when(F.size(locations) > 1, "proximity").otherwise("term")
