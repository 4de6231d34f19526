"""Validation of document rows, settings, and small rules about files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a title, a tag and a document stay below or at.
TITLE_BYTES, TAG_BYTES, DOCUMENT_BYTES = 1024, 128, 100 * 1024 * 1024
LAST_SECOND = 32_503_680_000


def named(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def tag_ok(tag: Column) -> Column:
    return (F.trim(tag) != "") & (F.octet_length(tag) < TAG_BYTES) & tag.rlike(r"^[\p{L}\p{N}_ -]*$")


def document_problems(title: Column, tags: Column, size: Column, created: Column, updated: Column) -> Column:
    """Names of the rules that a document's fields break; its path has rules of its own."""
    seconds = F.unix_timestamp(created)
    return named(
        {
            "title": ~F.octet_length(F.trim(title)).between(1, TITLE_BYTES),
            "tags": F.exists(tags, lambda t: ~tag_ok(t)),
            "size": size >= DOCUMENT_BYTES,
            "created": (seconds <= 0) | (seconds >= LAST_SECOND),
            "updated": updated < created,
        }
    )


def _over(a: Column, b: Column) -> Column:
    """Map a with b's entries in place of its own; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def merged_settings(base: Column, overrides: Column) -> Column:
    """JSON settings with the overrides' keys replaced; their options are merged key by key."""
    top = "map<string,string>"
    a, b = F.from_json(base, top), F.from_json(overrides, top)
    both, options = _over(a, b), _over(F.from_json(a["options"], top), F.from_json(b["options"], top))
    return F.when(F.map_contains_key(both, F.lit("options")), _over(both, F.create_map(F.lit("options"), F.to_json(options)))).otherwise(both)


def option(settings: Column, key: str, kind: str) -> Column:
    """One typed option of merged settings; null if it is not there or of another type."""
    return F.get_json_object(settings["options"], f"$.{key}").try_cast(kind)


def backoff_ms(attempt: Column, base: float = 100.0, most: float = 30_000.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def file_memory(size: Column, parsed: bool = True) -> Column:
    return size * (3 if parsed else 1) + 200


def is_recent(ts: Column, as_of: Column, interval: str) -> Column:
    return ts >= as_of - F.expr(f"INTERVAL {interval}")
