"""Trigrams counted in batches, against plain programs."""

import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from lodestone.functions import grams
from lodestone.operators import search

TEXTS = ["", None, "a", "ab", "abc", "ABCabcabc", "…—…", "a\nb\r\nc", "日本語テキスト", "𝔸𝔹ℂ x𐐀y", "éÉ ß ẞ İ", "²³½ _-_", " . ", "x" * 50]


def _docs(spark, texts):
    return spark.createDataFrame([(i, f"a/{i}.md", t) for i, t in enumerate(texts)], "id long, path string, content string").coalesce(1)


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_postings_by_a_plain_program(spark, monkeypatch, most):
    monkeypatch.setattr(grams, "MOST_CHARS", most)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab é\n.9日𝔸") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    d = _docs(spark, texts)
    want = Counter()
    for i, t in enumerate(texts):
        low = f"{i}.md {(t or '')}".replace("İ", "i\u0307").lower()
        want.update((i, low[j : j + 3]) for j in range(len(low) - 2) if any(unicodedata.category(c)[0] in "LN" for c in low[j : j + 3]))
    made = search.postings(d)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["trigram"]): r["tf"] for r in made.collect()} == want
    assert tuple(search.index_stats(d).first()) == (len({i for i, _ in want}), sum(want.values()), len(want), len({g for _, g in want}))


def test_halves_are_joined():
    texts = ["abcabc", "xyz", "日本語日本語"]
    doc, gram, times, names = grams._joined(grams._count(texts[:1]), grams._count(texts[1:]), 1)
    made = Counter({(d, names[g].as_py()): t for d, g, t in zip(doc.tolist(), gram.tolist(), times.tolist(), strict=True)})
    assert made == Counter((i, t[j : j + 3]) for i, t in enumerate(texts) for j in range(len(t) - 2))


def test_summed_and_blocks_agree():
    b = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "words": [1, 2, 3], "text": ["abab", "bab", None]})
    made = pa.Table.from_batches(grams.summed([b])).to_pylist()
    assert {r["trigram"]: (r["docs"], r["occurrences"]) for r in made} == {"aba": (1, 1), "bab": (2, 2), None: (2, 0)}
    lists = pa.Table.from_batches(grams.blocks(pa.int64())([b])).to_pylist()
    assert {r["trigram"]: (r["ids"], r["words"], r["tfs"]) for r in lists} == {"aba": ([1], [1], [1]), "bab": ([1, 2], [1, 2], [1, 1])}


def test_index_holds_lists_and_finds_the_same(spark, tmp_path):
    from lodestone.sources import stores

    d = _docs(spark, ["with the " * n + "other" for n in range(60)])
    search.write_index(d, f"{tmp_path}/index")
    held = stores.read_keyed(spark, f"{tmp_path}/index")
    assert held.groupBy("trigram").count().filter("count > 60").count() == 0 and held.count() < search.postings(d).count() / 4
    found = lambda df: [tuple(r) for r in df.collect()]
    assert found(search.search_index(spark, f"{tmp_path}/index", "with the", 20)) == found(search.text_search(d, "with the", 20))
