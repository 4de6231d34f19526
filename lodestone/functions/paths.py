"""Path expressions: wildcards, validation, languages, roles of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ENTRY_NAMES, ENTRY_PARTS, ENTRY_PREFIX, ENTRY_SUFFIXES, ENTRY_TYPES, GRAPH_PREFIXES, LANGUAGE_EXTENSIONS, PARSED_EXTENSIONS, RESERVED_NAMES, TEST_DIRECTORIES, TEST_PREFIXES, TEST_SUFFIXES
from .text import basename, extension


def wildcard(path: Column, pattern: str) -> Column:
    """Stars match anything. The first part is anchored unless a star leads, the last unless one trails; the last is
    tested alone, so it may overlap what came before; without a star the pattern is a prefix."""
    if pattern == "*":
        return path.isNotNull()
    parts = pattern.split("*")
    tests, rest = [], path
    for i, part in enumerate(parts):
        if not part:
            continue
        if i == 0:
            tests.append(path.startswith(part))
            rest = F.substring(path, len(part) + 1, F.length(path))
        elif i == len(parts) - 1:
            tests.append(path.endswith(part))
        else:
            at = F.instr(rest, part)
            tests.append(at > 0)
            rest = F.substring(rest, at + len(part), F.length(rest))
    out = F.lit(True) & path.isNotNull()
    for t in tests:
        out = out & t
    return out


def _looked_up(extensions: dict[str, tuple[str, ...]], key: Column) -> Column:
    names = F.create_map(*(F.lit(x) for name, all_ in extensions.items() for e in all_ for x in (e, name)))
    return F.try_element_at(names, key)


def language(path: Column) -> Column:
    return F.coalesce(_looked_up(LANGUAGE_EXTENSIONS, extension(path)), F.lit("Other"))


def parsed_language(path: Column) -> Column:
    """The language by which a file is parsed; null if it is not."""
    return _looked_up(PARSED_EXTENSIONS, F.lower(extension(path)))


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_test_file(path: Column) -> Column:
    name = basename(path)
    return any_of([*map(path.contains, TEST_DIRECTORIES), *map(name.startswith, TEST_PREFIXES), *map(name.endswith, TEST_SUFFIXES)])


def is_entry_point(name: Column, kind: Column) -> Column:
    """Whether a program may start at a symbol; kind in any case, null if it is not known."""
    new = name.endswith("::new") & (F.size(F.split(name, "::")) == 2)
    named = any_of([name.isin(*ENTRY_NAMES), new, *map(name.endswith, ENTRY_SUFFIXES), *map(name.contains, ENTRY_PARTS), name.startswith(ENTRY_PREFIX)])
    return named & (kind.isNull() | F.lower(kind).isin(*ENTRY_TYPES))


def path_problems(path: Column) -> Column:
    """Names of the rules that a relative storage path breaks."""
    rules = {
        "empty": path == "",
        "too_long": F.octet_length(path) >= 4096,
        "nul": path.contains("\0"),
        "absolute": path.startswith("/") | path.startswith("\\"),
        "drive": path.rlike("(?s)^.:"),
        "scheme": path.contains("://"),
        "encoded": path.rlike("(?i)%2e|%2f|%5c"),
        "doubled": path.contains("//") | path.contains("\\\\") | path.contains("...."),
        "parent": path.contains("..\\") | path.contains("\\..") | path.rlike(r"(?:^|/)\.\.(?:/|$)"),
        "reserved": F.upper(F.regexp_extract(basename(path), r"^(.+?)(?:\.[^.]*)?$", 1)).isin(*RESERVED_NAMES),
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def normalize(path: Column) -> Column:
    """Forward slashes, no leading ./ and no doubled or trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(?:\./)+", ""), "(?<=.)/$", "")


def same_path(a: Column, b: Column) -> Column:
    x, y = normalize(a), normalize(b)
    return (x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x))


def suspicious(path: Column) -> Column:
    """Whether a part of a path holds signs that file systems refuse."""
    return path.rlike('[<>:"|?*\\x00\\r\\n]')


def storage_safe(path: Column) -> Column:
    """The path's parts without other signs than letters, digits, dash, underscore and dot; null if a part leads up, or
    holds none of these, or there is no part."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}._-]", ""))
    bad = F.array_contains(parts, "..") | F.array_contains(bare, "") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(bare, "/"))


def route(path: Column) -> Column:
    """The store that keeps a path: graph for symbols and their relations, both for a nested symbol's text, else document.

    Hidden parts and parts with two dots do not count."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.contains("..") & ~p.startswith("."))
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(any_of(map(clean.startswith, GRAPH_PREFIXES)), "graph").when(clean.contains("/symbols/") & clean.endswith(".md"), "both").otherwise("document")
