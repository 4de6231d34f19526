"""Search-query sanitising, as column expressions over whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import COMMAND_PATTERN, DIRECTORY_PATTERN, ENCODED_DOT_PATTERN, QUERY_BYTES, QUERY_TERMS, RESERVED_CHARS_PATTERN, SQL_PATTERN, STOP_WORDS, STRICT_PATTERN, TERM_BYTES, TRAVERSAL_PATTERN

CONTROL = r"[\x00-\x1f\x7f\x{80}-\x{9f}]"
SPACES = r"[\s\p{Z}]+"
#: What is taken out of a plain query, in turn, and what comes in its place.
STEPS = ((SQL_PATTERN, ""), (COMMAND_PATTERN, ""), (TRAVERSAL_PATTERN, ""), (DIRECTORY_PATTERN, " "), (RESERVED_CHARS_PATTERN, " "))
LAST_STEPS = ((r"\.\.", " "), (ENCODED_DOT_PATTERN, " "))
STRICT_STEPS = ((STRICT_PATTERN, " "), (r"[()\\,=]", " "))


def _replaced(x: Column, steps) -> Column:
    for pattern, by in steps:
        x = F.regexp_replace(x, pattern, by)
    return x


def _even(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def clean(query: Column, strict: bool = False) -> Column:
    """The query with white space evened out and injection syntax taken out."""
    x = _replaced(_even(F.regexp_replace(query, CONTROL, " ")), STEPS)
    return _even(_replaced(_replaced(x, STRICT_STEPS) if strict else x, LAST_STEPS))


def terms(query: Column, strict: bool = False) -> Column:
    """Up to QUERY_TERMS terms: those with a letter, and wildcard terms with something beside stars, or one star."""

    def good(t: Column) -> Column:
        bare = F.replace(t, F.lit("*"))
        starred = (t == "*") | F.octet_length(bare).between(1, TERM_BYTES)
        return F.when(t.contains("*"), starred).otherwise(F.octet_length(t).between(1, TERM_BYTES) & t.rlike(r"\p{L}"))

    return F.slice(F.filter(F.split(clean(query, strict), " "), good), 1, QUERY_TERMS)


def _allowed(query: Column) -> Column:
    return (F.octet_length(query) <= QUERY_BYTES) & ~query.contains("\0")


def sanitized(query: Column, strict: bool = False) -> Column:
    """The terms in one text; null for queries that are too long, hold a NUL or have no term left."""
    text = F.array_join(terms(query, strict), " ")
    return F.when(_allowed(query) & (text != ""), text)


def path_aware(query: Column) -> Column:
    """For queries that may be paths: slashes and traversal stay, shell syntax goes only where there is no slash; one
    star where no term is left, null for queries that are too long or hold a NUL."""
    x = F.regexp_replace(_even(F.regexp_replace(query, CONTROL, " ")), SQL_PATTERN, "")
    x = F.when(x.contains("/"), x).otherwise(F.regexp_replace(x, COMMAND_PATTERN, ""))
    x = _even(_replaced(x, STEPS[-2:]))
    any_term = F.exists(F.split(x, " "), lambda t: F.octet_length(t).between(1, TERM_BYTES))
    return F.when(_allowed(query), F.when(any_term, x).otherwise("*"))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))


def tag(text: Column) -> Column:
    """The tag in lower case; null if it is too long or holds other signs than letters, digits, dash and underscore."""
    return F.when((F.octet_length(text) <= 50) & text.rlike(r"^[\p{L}\p{N}_-]*$"), F.lower(text))
