"""Text expressions: trigrams, tokens, previews, token estimates. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{L}\p{N}]"


def trigrams(text: Column) -> Column:
    """Overlapping three-character windows of the lower-cased text that hold a letter or digit; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)), lambda t: t.rlike(ALNUM))


def query_trigrams(query: str) -> list[str]:
    q = query.lower()
    return [t for t in (q[i : i + 3] for i in range(len(q) - 2)) if any(map(str.isalnum, t))]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def preview(text: Column, bytes_: int = 500, keep: int = 497) -> Column:
    return F.when(F.octet_length(text) > bytes_, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def word_preview(text: Column, chars: int = 200) -> Column:
    """The text, or its first characters up to the last space."""
    head = F.substring(text, 1, chars)
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("...")))


def token_estimate(text: Column) -> Column:
    """Words at 1.3 tokens and ASCII punctuation at 0.3, cut to a whole number."""
    marks = F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))
    return F.floor(word_count(text) * 1.3 + marks * 0.3 + 1e-9).cast("long")


def occurrences(text: Column, part: str) -> Column:
    """How often a fixed, not empty text stands in another, without overlaps."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part)))) / len(part.encode())).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
