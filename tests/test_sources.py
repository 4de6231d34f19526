"""Source trees, parsing and streams on files made here."""

import subprocess

from lodestone.functions.text import basename
from lodestone.sources import code, repository, sinks
from lodestone.streaming import streams
from pyspark.sql import functions as F

RUST = """use std::fmt;
pub struct Point {
    x: i32,
}
impl Point {
    pub fn norm(&self) -> i32 {
        square(self.x)
    }
}
fn square(x: i32) -> i32 {
    x * x
}
fn main() {
    println!("{}", square(2));
    helper();
}
fn helper() {}
"""
PYTHON = '''import os


class Reader:
    def read(self):
        return load("x")


def load(p):
    return os.stat(p)
'''


def _tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/lib.rs").write_text(RUST)
    (tmp_path / "src/io.py").write_text(PYTHON)
    (tmp_path / "src/bad.py").write_text("def (:")
    (tmp_path / "target/x.rs").write_text("fn no() {}")
    (tmp_path / "blob.bin").write_bytes(b"\0\1")
    return f"file://{tmp_path}"


def test_tree_to_graph(spark, tmp_path):
    tree = repository.files(spark, _tree(tmp_path))
    assert {r["path"]: r["binary"] for r in tree.collect()} == {"src/lib.rs": False, "src/io.py": False, "src/bad.py": False, "blob.bin": True}
    docs = repository.file_documents(tree, "demo")
    assert docs.filter(basename(F.col("path")) == "blob.bin").first()["content"] == "# Binary File: blob.bin\n\n- **Size**: 2 bytes\n- **Type**: Binary\n"
    text = tree.filter("not binary").select("path", F.decode("content", "UTF-8").alias("content"))
    nodes, edges = code.code_graph(text)
    names = {r["id"]: r["name"] for r in nodes.collect()}
    assert {"Point", "norm", "square", "main", "helper", "Reader", "read", "load"} <= set(names.values())
    calls = {(names[r["src"]], names[r["dst"]]) for r in edges.collect()}
    assert {("norm", "square"), ("main", "square"), ("main", "helper"), ("read", "load")} <= calls
    assert sinks.dot(edges).count() == edges.count()


def test_commit_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for n in range(2):
        (tmp_path / f"f{n}.txt").write_text("a\nb\n")
        git("add", "-A")
        git("commit", "-qm", f"Change {n}")
    log = repository.commits(spark, str(tmp_path)).collect()
    assert [(r["message"], r["files"], r["added"]) for r in log] == [("Change 1", ["f1.txt"], 2), ("Change 0", ["f0.txt"], 2)]
    made = repository.commit_documents(repository.commits(spark, str(tmp_path)), "demo").collect()
    assert [r["tags"] for r in made] == [["commit", "demo", "T"]] * 2 and all(r["path"] == f"repos/demo/commits/{r['id'][:8]}.md" for r in made)
    assert "**Author**: T <t@example.com>" in made[0]["content"] and "- **Changes**: 2 insertions(+), 0 deletions(-)" in made[0]["content"] and made[0]["content"].endswith("## Files Changed\n- f1.txt\n")
    assert "- **Parents**: none (initial commit)" in made[1]["content"]


def _stream(spark, tmp_path, rows):
    at = f"{tmp_path}/in"
    spark.createDataFrame(rows, "id long, key long, ts timestamp").coalesce(1).write.parquet(at)
    return spark.readStream.schema("id long, key long, ts timestamp").parquet(at)


def _run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    from datetime import datetime

    t = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    rows = [(1, 1, t(0)), (2, 1, t(0, 30)), (3, 2, t(0, 10)), (4, 1, t(2)), (5, 1, t(2))]
    s = _stream(spark, tmp_path, rows)
    made = {(r["key"], r["start"].minute): r["n"] for r in _run(spark, streams.windowed_counts(s, "key", "ts", "1 minute", "0 seconds"), "complete", "windows").collect()}
    assert made == {(1, 0): 2, (2, 0): 1, (1, 2): 2}
    bucket = {r["key"]: (r["n"], r["allowed"]) for r in _run(spark, streams.token_bucket(s, "key", "ts", 1.0), "update", "bucket").collect()}
    assert bucket == {1: (4, 3), 2: (1, 1)}
    assert _run(spark, streams.distinct_deliveries(s, "key", "ts", "1 hour"), "append", "deliveries").count() == 2
    seen = []
    streams.each_batch(s, lambda df, n: seen.append(df.count()), f"{tmp_path}/ck").awaitTermination(120)
    assert sum(seen) == 5
