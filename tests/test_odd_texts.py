"""Texts with spaces, line ends, quotes and nothing at all."""

import random

import duckdb
from lodestone.plans import registry
from lodestone.sources import sinks
from oracle import rows as oracle_rows


def test_csv_brings_any_text_back(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " ", "  lead", "trail\t", "\r", "a\r\nb\r", "\n", "\x00", "\x0b\x0c", '"\n', "\\", "#", "﻿x", *("".join(rng.choice('", \n\r\\\ta#') for _ in range(rng.randint(1, 9))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert dict(sinks.read_csv(spark, f"{tmp_path}/csv", df.schema).collect()) == dict(enumerate(texts))


def test_relevance_of_texts_without_a_byte(spark, tmp_path):
    """As in the query's SQL, where a share of nothing is no number and the bound of 1 stays."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([None, "", " ", "the and of", "x" * 5000 + " the"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle_rows(registry.queries()["relevance_scores"](spark, str(tmp_path)).toPandas()) == oracle_rows(con.execute(registry.oracle_sql()["relevance_scores"]).df())
