"""Queries that read whole tables and whole texts, against plain programs."""

import math
import re

import pytest
from lodestone.functions import sanitize
from lodestone.operators import graph, vector
from lodestone.plans import registry


def test_change_sets_of_every_event(spark, sf):
    made = sorted(tuple(r) for r in registry.queries()["change_sets"](spark, sf).select("event_id", "added", "modified", "removed").collect())
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id").collect()
    assert len(events) > 500 and made == sorted((r["event_id"], f"a{r['event_id'] % 7},b", f"m{r['user_id']}", None) for r in events)


def _tokens(text):
    return math.floor(len(re.findall(r"[^ \t\n\v\f\r]+", text)) * 1.3 + len(re.findall(r"[!-/:-@\[-`{-~]", text)) * 0.3 + 1e-9)


def test_budget_of_whole_texts(spark, sf):
    """Greedy choice by a plain program: the documents' whole texts count, not their beginnings."""
    docs = sorted(((-(r["doc_id"] % 97), r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda x: x[:2])[:20]
    assert any(t and len(t) > 1500 for _, _, t in docs)
    used, want, texts = 0, [], []
    for _, i, t in docs:
        for text, cut in ((t, False), (t[:200] + "..." if t and len(t) > 200 else t, True)):
            if t is not None and len(want) < 10 and used + _tokens(text) <= 1200 and (not cut or len(want) < 5):
                used += _tokens(text)
                want.append((len(want) + 1, i, _tokens(text), cut))
                texts.append(text)
                break
    queries = registry.queries()
    assert [tuple(r) for r in queries["token_budget"](spark, sf).orderBy("rank").select("rank", "id", "tokens", "cut").collect()] == want
    row = queries["token_usage"](spark, sf).first()
    assert (row["tokens"], row["efficiency"], row["truncated"]) == (used, round(min(used / 1200, 1), 6), sum(t.endswith("...") for t in texts))


def test_embeddings_of_all_words(spark, tmp_path):
    """Two words that cancel out fill the first 200 places; the 201st decides. Counts are by a plain program."""
    names = [f"w{i}" for i in range(400)]
    places = {r["w"]: (r["at"], r["sign"]) for r in spark.createDataFrame([(w,) for w in names], "w string").selectExpr("w", "pmod(xxhash64(w), 16) AS at", "IF(xxhash64(w, 1) % 2 = 0, 1, -1) AS sign").collect()}
    a = names[0]
    b = next(w for w in names if places[w] == (places[a][0], -places[a][1]))
    c = next(w for w in names if places[w][0] != places[a][0])
    texts = {1: f"{a} {b} " * 100 + c, 2: f"{a} {b} " * 100, 3: "", 4: None, 5: " ".join(names * 3)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["id"]: (r["dimensions"], r["norm"]) for r in registry.queries()["hashed_embeddings"](spark, str(tmp_path)).collect()}
    assert {i: n for i, (_, n) in made.items()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: None, 5: 1.0}
    words = spark.createDataFrame([(i, None if t is None else t.split()) for i, t in texts.items()], "id long, words array<string>")
    for r in vector.hashed_embeddings(words, 16).collect():
        if texts[r["id"]] is None:
            assert r["v"] is None
            continue
        counts = [0.0] * 16
        for w in texts[r["id"]].split():
            counts[places[w][0]] += places[w][1]
        length = math.sqrt(sum(x * x for x in counts))
        assert r["v"] == [pytest.approx(x / length if length else 0.0) for x in counts]


def test_strict_cleaning_of_whole_texts(spark, tmp_path):
    def clean(x):
        for p, by in ((r"[\x00-\x1f\x7f-\x9f]", " "), (r"\s+", " "), *sanitize.STEPS, *sanitize.STRICT_STEPS, *sanitize.LAST_STEPS, (r"\s+", " ")):
            x = re.sub(p, by, x, flags=re.ASCII if "\\w" in p or "\\b" in p else 0).strip(" ")
        return x

    far = "plain words " * 20
    texts = [far + "drop table x ../../etc <script>alert(1)</script> a..b, c=d", far + "SELECT name FROM users; delete from y", "union select", far * 40 + "%2e%2e [tail]"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["id"]: r["clean"] for r in registry.queries()["strict_clean"](spark, str(tmp_path)).collect()}
    assert made == {i: clean(f"{t} (select)=drop, s/en/doc_{i}.md") for i, t in enumerate(texts)}
    assert "etc" in made[0] and "drop" not in made[0] and "tail" in made[3]


def test_strong_components_of_many_levels(spark):
    """56 nodes, each with edges to all of lower names, and a cycle at the far end: by falling names one settles a round."""
    names = [f"n{i:02}" for i in range(56)]
    edges = spark.createDataFrame([*((a, b) for a in names for b in names if a > b), ("n00", "n01")], "src string, dst string")
    made = sorted(tuple(r) for r in graph.strong_components(edges).select("id", "component").collect())
    assert made == sorted((n, "n01" if n == "n00" else n) for n in names)
