"""Edge cases that every operator has to define: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import math
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from lodestone.llm import bpe, html_text, mixing, near_dup, neighbours, pii, preference, quality_model, quality_rules, warc  # noqa: E402

LONG = "word " * 30_000 + "tail"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, size string, spans string, node string"
ROWS = [(1, None), (2, ""), (3, "a b c"), (4, LONG), (5, "mail me at bob@example.com or +1 (555) 123-4567 now"), (5, "mail me at bob@example.com or +1 (555) 123-4567 now"), (None, "no id here at all " * 9), (7, " \t\n ")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else f"s{(i or 0) % 2}", len(t or ""), "k", "h", "x", "y", "z") for i, t in rows], DOCS)


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edge", "empty"])
def test_document_queries(spark, tmp_path, rows):
    sf = save(spark, tmp_path, documents=docs(spark, rows), labels=spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (9, 5, 0)] if rows else [], LABELS))
    for query in (pii.op1_pii, quality_model.op5_quality_model, quality_rules.op6_quality_rules, mixing.op7_mixing, near_dup.op9_near_dup, bpe.op10_bpe):
        made = query(spark, sf).collect()
        assert Counter(r["doc_id"] for r in made) == Counter(i for i, _ in rows), query.__name__


def test_defined_results(spark, tmp_path):
    sf = save(spark, tmp_path, documents=docs(spark))
    by = lambda q: {r["doc_id"]: r for r in q(spark, sf).collect()}
    p = by(pii.op1_pii)
    assert p[5]["spans"] == "email:11:26,phone:30:47" and p[5]["n_phone"] == 1 and p[1]["spans"] == ""
    q = by(quality_rules.op6_quality_rules)
    assert q[1]["n_words"] == 0 and not q[1]["kept"] and q[4]["n_words"] == 30_001 and q[4]["base_failed"]
    n = by(near_dup.op9_near_dup)
    assert n[1]["n_shingles"] == 0 and n[1]["component_id"] == 1 and n[3]["n_shingles"] == 1 and n[None]["component_id"] is None and n[4]["n_shingles"] == 2
    b = by(bpe.op10_bpe)
    assert b[1]["n_tokens"] == b[2]["n_tokens"] == 0


def test_transforms_keep_columns(spark):
    d = docs(spark)
    for f in (near_dup.deduplicate, pii.sanitise, mixing.mix):
        assert f(spark, d).columns == d.columns
        assert f(spark, d.limit(0)).count() == 0
    kept = near_dup.deduplicate(spark, d)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"]) == [(False, i) for i in (1, 2, 3, 4, 5, 7)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, d).collect()}
    assert clean[5] == "mail me at [EMAIL] or [PHONE] now" and clean[1] is None and clean[4] == LONG


def test_pages(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "x, y " * 500), (4, "u\r\nv", "<p>" + "x, y " * 500), (4, "u", "<p>" + "x, y " * 500), (None, "u", "<p>" + "x, y " * 500)]
    pages = "page_id long, url string, html string, member string, size string"
    sf = save(spark, tmp_path, pages=spark.createDataFrame([(*r, "m", "s") for r in rows], pages))
    made = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op2_warc(spark, sf).collect()}
    assert made == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None)}
    assert warc.op2_warc(spark, sf).count() == 6
    assert {r["page_id"]: r["n_chars"] for r in html_text.op4_html_text(spark, sf).collect()}[1] == 0
    empty = save(spark, tmp_path / "e", pages=spark.createDataFrame([], pages))
    assert warc.op2_warc(spark, empty).count() == html_text.op4_html_text(spark, empty).count() == 0


def test_vectors(spark, tmp_path):
    good = [1.0, 0.0]
    rows = [(0, good), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, good), (5, good), (6, [0.5, 0.5]), (20, [0.0, 1.0]), (None, good), (7, [1.0, 2.0, 3.0])]
    kind = "vec_id long, embedding array<float>, label int, block string, size string"
    sf = save(spark, tmp_path, embeddings=spark.createDataFrame([(*r, 0, "b", "s") for r in rows], kind))
    made = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.op3_neighbours(spark, sf).orderBy("query_id", "rank").collect()]
    assert made == [(0, 1, 5, 1.0), (0, 2, 6, 0.5), (0, 3, 20, 0.0), (20, 1, 6, 0.5), (20, 2, 0, 0.0), (20, 3, 5, 0.0)]
    assert neighbours.op3_neighbours(spark, save(spark, tmp_path / "e", embeddings=spark.createDataFrame([], kind))).count() == 0


def test_preferences(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "x"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "y"), (2, 3, "assistant", None), (3, 0, "user", "q"), (4, None, None, None), (4, None, None, None), (None, 0, "user", "q")]
    kind = "conv_id long, turn long, role string, text string, part string, place string"
    sf = save(spark, tmp_path, conversations=spark.createDataFrame([(*r, "p", "q") for r in turns], kind))
    made = preference.op8_preference(spark, sf)
    rows = {(r["pair_id"], r["rejected_id"], r["part"], r["turn"], r["k"], r["mask"]) for r in made.collect()}
    assert rows == {(1, 2, "prompt", 0, 0, 0), (1, 2, "prompt", 1, 0, 0), (1, 2, "chosen", 2, 0, 0), (1, 2, "rejected", 2, 0, 0), (1, 2, "rejected", 3, 0, 1), (3, None, "chosen", 0, 0, 0), (4, None, "chosen", None, 0, 0), (4, None, "chosen", None, 1, 0)}
    one = {r["pair_id"]: r for r in preference.render(made).collect()}[1]
    assert one["prompt"] == "<|user|>\nq\n<|assistant|>\na\n" and one["chosen"] == "<|user|>\nx\n" and one["rejected"] == "<|user|>\ny\n<|assistant|>\n\n"
    assert preference.op8_preference(spark, save(spark, tmp_path / "e", conversations=spark.createDataFrame([], kind))).count() == 0


def test_disclosing_terms(spark):
    """A term that stands only beside one address gives it away; common words do not."""
    rows = [(i, f"the zanzibarite bob@example.com wrote about things number {i}") for i in range(6)] + [(i, f"things that people wrote about in general number {i}") for i in range(6, 60)]
    found = {r["doc_id"]: r["extra"] for r in pii.find(spark, docs(spark, rows)).collect()}
    assert [(s["start"], s["end"]) for s in found[0]] == [(4, 15)] and found[30] is None
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs(spark, rows)).collect()}
    assert clean[0] == "the  [EMAIL] wrote about things number 0" and clean[30] == rows[30][1]
    assert not {r["doc_id"]: r["extra"] for r in pii.find(spark, docs(spark, rows[:2] + rows[6:])).collect()}[0]


def test_targets_fill_up(spark):
    d = docs(spark, [(i, "w " * n) for i, n in enumerate([10, 1000, 10, 10, 500, 90])])
    made = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(mixing.sizes(d)).collect()}
    assert made["s0"] == (510, 1020.0) and sum(t for _, t in made.values()) == pytest.approx(1.5 * 1620)
    assert {None, "s0", "s1"} == set(made) and all(t <= 2 * s for s, t in made.values())


def test_disclosing_terms_anywhere(spark):
    """A name far from the address goes wherever it stands in the address's documents, a short one too; others' texts stay."""
    far = "things that people wrote about in general " * 5
    rows = [(i, f"zanzibarite {far} and Ann wrote {far} bob@example.com {far} Zanzibarite") for i in range(6)] + [(i, f"{far} number {i}") for i in range(6, 60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs(spark, rows)).collect()}
    assert clean[0] == f" {far} and  wrote {far} [EMAIL] {far} " and clean[30] == rows[30][1]


def test_disclosing_terms_of_few_documents(spark):
    """Two documents in 200 are an estimate, though a cautious one; a term as often elsewhere is none."""
    rows = [(i, "zanzibarite people bob@example.com") for i in range(2)] + [(i, f"things that people wrote in general {'quokka' if i < 6 else ''}") for i in range(2, 200)] + [(200, "quokka amy@example.com")]
    found = {r["doc_id"]: r["extra"] for r in pii.find(spark, docs(spark, rows)).collect()}
    (one,) = found[0]
    ic, a = math.log2(201 / 2), 9 / 2**1.5
    assert (one["start"], one["end"]) == (0, 11) and one["share"] == pytest.approx(1 + math.log2((2 + a * 2 / 201) / (2 + a)) / ic) and 0.75 <= one["share"] < 0.95
    assert not found[200] and found[50] is None
