"""Every query without a training-data operator against its DuckDB SQL on the smallest tables."""

import pytest
from lodestone.plans import registry
from oracle import connect, rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    made, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_token_bucket_by_hand(spark, sf):
    from lodestone.plans import model

    made = {r["key"]: (r["allowed"], r["n"]) for r in registry.queries()["token_bucket"](spark, sf).collect()}
    want = {}
    for key, g in model.measurements(spark, sf).select("key", "ts", "id").toPandas().groupby("key"):
        tokens, last, ok = 1.0, None, 0
        for t in g.sort_values(["ts", "id"]).ts:
            tokens, last = min(1.0, tokens + (t - last).total_seconds()) if last is not None else tokens, t
            ok, tokens = (ok + 1, tokens - 1) if tokens >= 1 else (ok, tokens)
        want[key] = (ok, len(g))
    assert made == want


def test_stream_token_bucket_by_hand(spark, sf):
    """The stream's buckets of one batch are those of the rows in order."""
    import pandas as pd

    made = {r["key"]: (r["n"], r["allowed"]) for r in registry.queries()["stream_token_bucket"](spark, sf).collect()}
    events, want = pd.read_parquet(f"{sf}/events.parquet"), {}
    for key, g in events.groupby("user_id"):
        tokens, last, ok = 1.0, None, 0
        for t in g.ts.sort_values():
            tokens, last = min(1.0, tokens + (t - last).total_seconds()) if last is not None else tokens, t
            ok, tokens = (ok + 1, tokens - 1) if tokens >= 1 else (ok, tokens)
        want[key] = (len(g), ok)
    assert made == want


def test_budget_by_hand(spark):
    from lodestone.operators import rerank

    texts = {1: "w " * 50, 2: "w " * 400, 3: "w " * 30, 4: "w " * 20}
    hits = spark.createDataFrame([(i, 10.0 - i, t) for i, t in texts.items()], "id long, score double, snippet string")
    made = [(r["id"], r["cut"]) for r in rerank.select_within(hits, 300, 4).orderBy("rank").collect()]
    assert made == [(1, False), (2, True), (3, False), (4, False)]
    assert [r["id"] for r in rerank.select_within(hits, 300, 2).orderBy("rank").collect()] == [1, 3]


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "matched", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__._llm("nothing_of_that_name") is None
