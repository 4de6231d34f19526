"""Source trees and commit logs as tables, and their documents."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed_values import SKIPPED_DIRECTORIES
from ..functions.text import basename, extension

SOURCES = ("rs", "py", "js", "jsx", "ts", "tsx", "mjs", "cjs")


def files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = (), max_bytes: int = 10_000_000, skip: tuple[str, ...] = SKIPPED_DIRECTORIES) -> DataFrame:
    """path (below root), size, content and binary for the files of a tree; a NUL in the first 8 KB means binary."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    base = root.rstrip("/")
    base = "/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    rel = F.regexp_replace(F.substring_index("path", f"{base}/", -1), "^/+", "")
    out = raw.select(rel.alias("path"), F.col("length").alias("size"), "content", F.contains(F.substring("content", 1, 8192), F.lit(b"\0")).alias("binary"))
    out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))
    for part in exclude:
        out = out.filter(~F.col("path").contains(part))
    return out.filter(extension(F.col("path")).isin(*extensions)) if extensions else out


def only(tree: DataFrame, paths: DataFrame) -> DataFrame:
    return tree.join(paths.select(F.regexp_replace("path", r"^\./", "").alias("path")), "path", "left_semi")


def _safe(text: Column, by: str) -> Column:
    """With by for every sign that a tag may not hold."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_ -]", by)


def safe_name(name: Column) -> Column:
    """A repository's name as a tag and a folder: lower case, dashes for other signs, none at the ends."""
    bare = F.lower(F.regexp_replace(_safe(name, "-"), "^-+|-+$", ""))
    return F.when(bare == "", "repository").otherwise(bare)


def file_documents(tree: DataFrame, repo: str, prefix: str = "repos") -> DataFrame:
    """A document for each file: path below the repository, tags, and the text (a note for binary files)."""
    ext = extension(F.col("path"))
    note = F.format_string("# Binary File: %s\n\n- **Size**: %d bytes\n- **Type**: Binary\n", "path", "size")
    tags = F.array_compact(F.array(F.lit("file"), F.lit(repo), F.when(ext != "", F.concat(F.lit("ext_"), ext))))
    return tree.select(
        F.sha2(F.concat_ws("/", F.lit(repo), "path"), 256).alias("id"), F.concat_ws("/", F.lit(prefix), F.lit(repo), F.lit("files"), "path").alias("path"), F.concat(F.lit("File: "), "path").alias("title"),
        F.when(F.col("binary"), note).otherwise(F.decode("content", "UTF-8")).alias("content"), tags.alias("tags"), "size",
    )


def commit_documents(commits: DataFrame, repo: str, prefix: str = "repos") -> DataFrame:
    """A markdown document for each commit (sha, author, email, ts, parents, message, files, added, removed)."""
    short = F.substring("sha", 1, 8)
    parents = F.when(F.size("parents") > 0, F.array_join(F.transform("parents", lambda p: F.substring(p, 1, 8)), ", ")).otherwise("none (initial commit)")
    when = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    files = F.when(F.size("files") > 0, F.concat(F.lit("\n## Files Changed\n"), F.array_join(F.transform("files", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""))).otherwise("")
    head = F.format_string("# Commit: %s\n\n**Author**: %s <%s>\n**Date**: %s\n\n## Message\n%s\n\n## Details\n- **SHA**: %s\n- **Parents**: %s\n", short, "author", "email", when, "message", "sha", parents)
    details = F.format_string("- **Changes**: %d insertions(+), %d deletions(-)\n- **Files Modified**: %d\n", "added", "removed", F.size("files"))
    return commits.select(F.col("sha").alias("id"), F.concat(F.concat_ws("/", F.lit(prefix), F.lit(repo), F.lit("commits"), short), F.lit(".md")).alias("path"), F.concat(F.lit("Commit: "), short).alias("title"), F.concat(head, details, files).alias("content"), F.array(F.lit("commit"), F.lit(repo), _safe(F.col("author"), "_")).alias("tags"))


def index_documents(repositories: DataFrame, prefix: str = "repos") -> DataFrame:
    """A document for each repository (name, path, branch, commits, updated_at, url)."""
    when = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss 'UTC'")
    body = F.format_string("# Repository: %s\n\n- **Path**: %s\n- **Branch**: %s\n- **Commits**: %d\n- **Updated**: %s\n", "name", "path", "branch", "commits", when)
    url = F.coalesce(F.concat(F.lit("- **URL**: "), "url", F.lit("\n")), F.lit(""))
    return repositories.select(F.concat_ws("/", F.lit(prefix), safe_name(F.col("name")), F.lit("index.md")).alias("path"), F.concat(F.lit("Repository: "), "name").alias("title"), F.concat(body, url).alias("content"), F.array(F.lit("repository"), F.lit("index"), F.col("name")).alias("tags"))


def repository_name(url: Column) -> Column:
    """The last part of a repository's address or path, without sign-in, query, fragment and .git."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(F.element_at(F.filter(F.split(bare, r"[/:\\]"), lambda x: x != ""), -1), r"\.git$", "")


def owner_and_repository(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"[/:]([^/:]+/[^/]+?)/?$", 1), r"\.git$", ""), F.lit(""))


def branch(ref: Column) -> Column:
    """The branch or tag that a full reference names; null for others."""
    return F.nullif(F.regexp_extract(ref, "^refs/(?:heads|tags)/(.+)$", 1), F.lit(""))


COMMIT = "sha string, author string, email string, ts long, parents array<string>, message string, files array<string>, added int, removed int"


def _record(text: str) -> tuple:
    """A record of the log's format: fields between unit separators, the changes of files last."""
    sha, author, email, ts, parents, message, stats = text.split("\x1f")
    rows = [x.split("\t") for x in stats.strip().splitlines() if x.count("\t") == 2]
    number = lambda x: int(x) if x.isdigit() else 0
    return sha, author, email, int(ts), parents.split(), message.strip(), [r[2] for r in rows], sum(number(r[0]) for r in rows), sum(number(r[1]) for r in rows)


def parsed_log(records: DataFrame) -> DataFrame:
    """The commits of a log that was written elsewhere (record: one commit's text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_record(x) for x in b["record"]], columns=[x.split()[0] for x in COMMIT.split(", ")])

    return records.select("record").mapInPandas(run, COMMIT)


class _Log(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("limit", 1000))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        mark = "\x1e%H\x1f%an\x1f%ae\x1f%at\x1f%P\x1f%B\x1f"
        run = subprocess.run(["git", "-C", self.path, "log", f"-n{self.limit}", "--numstat", "-m", "--first-parent", f"--format={mark}"], capture_output=True, text=True, check=True)
        yield from map(_record, run.stdout.split("\x1e")[1:])


class CommitLog(DataSource):
    """spark.read.format("commit_log").option("path", ...): the commits of a local repository, newest first."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Log(self.options)


def commits(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    spark.dataSource.register(CommitLog)
    return spark.read.format("commit_log").option("path", path).option("limit", limit).load()
