"""Personal data: patterns, and terms that disclose it, by DataFrame functions alone.

Four patterns find e-mail addresses, IP addresses, card and telephone numbers (base spans). Then the corpus tells which
terms give them away: for each protected entity e and each term t of the documents that hold e, wherever it stands,
counts over all documents estimate

    disclosure(t, e) = PMI(e, t) / IC(e) = 1 + log2 P(e|t) / IC(e),   IC = log2(N / n(e)),

the share of e's information that t reveals. From GENERALISE on a term is replaced by a general word, from REMOVE on
it goes, everywhere in the documents that hold e. n(t), n(e) and n(e,t) count the documents that hold t, e and both.
P(e|t) = (n(e,t) + a n(e) / N) / (n(t) + a) draws few documents towards independence: a = SUPPORT^2 / n(e,t)^1.5 is the
weight of that prior, in documents. No pair is left out for its count: a pair of one document needs 13.3 bits of e.

Null and empty texts have no spans (sanitise leaves them as they are). Texts are read whole; positions are code
points. Repeated rows have equal results, one each. Rows without doc_id are kept. An empty table gives an empty
result. Extra columns are ignored by find() and kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table

#: In the order of kinds. They match what the plain patterns match; possessive loops need no stack for long runs, and the
#: looks behind start a search at a run's beginning or where the last match ended, since it fails elsewhere.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: A text without any of these has no base span; each is a cheap test.
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}
#: Words of four letters or more, and shorter ones that may be names: of two or three letters, capitalised or of a script
#: without case.
TERM = r"\p{L}{4,}|(?<!\p{L})[\p{Lu}\p{Lt}\p{Lo}]\p{L}{1,2}(?!\p{L})"
SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.95
#: Terms of more than this share of all documents, and of too many to disclose anything, are few and never dealt by term.
COMMON = 0.005
#: Matches whose positions are summed in one go; keeps the work linear in the number of matches.
BLOCK = 256


def _maybe(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.rlike(MAYBE[kind])


def maybe_any(text: Column) -> Column:
    """True for every text with a base span, and for few others; false for null."""
    found = _maybe("email", text)
    for kind in ("ip", "card", "phone"):
        found = found | _maybe(kind, text)
    return F.coalesce(found, F.lit(False))


def _placed(text: Column, pattern: str) -> Column:
    """Every match with its start and end (code points)."""
    return _running(_gapped(text, pattern), lambda x: x["gap"] + x["size"], lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("match")))


def _gapped(text: Column, pattern: str) -> Column:
    """Every match with its size and the number of code points between it and the one before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))


def _running(items: Column, width, make) -> Column:
    """make(item, sum of width over the items before it) for each item; blocks keep it near linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK)).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))
    widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + width(x)))
    bases = F.aggregate(widths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])

    def block(b: Column, base: Column) -> Column:
        ends = F.aggregate(b, F.struct(base.alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct((s["at"] + width(x)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.zip_with(b, ends, make)

    return F.flatten(F.zip_with(blocks, bases, block))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _base(text: Column, rank: int, kind: str) -> Column:
    """The valid spans of one kind, with the hash of what they name."""

    def span(x: Column) -> Column:
        name = F.lower(x["match"]) if kind == "email" else F.regexp_replace(x["match"], "[^0-9.]", "")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.xxhash64(F.lit(rank), name).alias("entity"))

    return F.transform(F.filter(_placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"])), span)


def _count(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def detect(docs: DataFrame, keep: list[str], terms: bool = True) -> DataFrame:
    """keep's columns and spans (start, rank, end; base ones in order) for every row; with terms also entities, and
    places (term, start, end) of all terms of the rows that have spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, text.alias("_t"))
    for rank, kind in enumerate(PATTERNS):
        found = found.withColumn(f"_{kind}", F.when(_maybe(kind, F.col("_t")), _base(F.col("_t"), rank, kind)).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,entity:bigint>>")))
    found = found.select(*keep, "_t", F.concat(*(f"_{kind}" for kind in PATTERNS)).alias("_all"))
    spans = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))).alias("spans")
    if not terms:
        return found.select(*keep, spans)
    # a column of its own, so that blocks of it do not match again
    found = found.withColumn("_g", F.when(F.size("_all") > 0, _gapped(F.col("_t"), TERM)).otherwise(F.array().cast("array<struct<gap:int,size:int,match:string>>")))
    place = lambda x, at: F.struct(F.xxhash64(F.lower(x["match"])).alias("term"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"))
    return found.select(*keep, spans, F.array_distinct(F.transform("_all", lambda s: s["entity"])).alias("entities"), _running(F.col("_g"), lambda x: x["gap"] + x["size"], place).alias("places"))


def term_counts(docs: DataFrame) -> DataFrame:
    """n_t: in how many documents a term stands; over every document and whole texts."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(F.lower(t))))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing(scratch: Scratch, docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """term and share for each _id, _h with an entity of which the term tells generalise or more: its largest share."""
    by_doc = found.filter(F.size("entities") > 0)
    counts = scratch.cut(term_counts(docs), "counts").df
    total = docs.agg(F.count("*").alias("n"))
    postings = counts.agg(F.sum("n_t")).first()[0] or 0
    entities = by_doc.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    entities = scratch.cut(entities.crossJoin(F.broadcast(total)).filter(F.col("n_e") < F.col("n")), "entities").df  # total is one row
    # P(e|t) is below n(e) / n(t), so a term of more documents than this tells too little of any entity, whatever n(e,t)
    most = entities.agg(F.max("n").alias("n"), F.max(F.col("n_e") * F.pow(F.col("n") / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)).alias("most"))
    counts = counts.crossJoin(F.broadcast(most))  # one row
    common = counts.filter(F.col("n_t") > F.greatest("most", F.col("n") * COMMON)).select("term")
    rare = counts.filter(F.col("n_t") <= F.col("most")).select("term", "n_t")
    held = by_doc.select("_id", "_h", "entities", F.explode(F.array_distinct(F.transform("places", lambda p: p["term"]))).alias("term")).join(F.broadcast(common), "term", "left_anti")
    # a term of very many documents, or a pair of them, is met by broadcast
    held = scratch.cut(join_hot(held, rare, ["term"], postings, "n_t"), "held").df.withColumn("entity", F.explode("entities")).drop("entities")
    pairs = held.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.min("n_t").alias("n_t")).join(entities, "entity")
    p, a = F.col("n_e") / F.col("n"), F.lit(float(support) ** 2) / F.pow("n_et", F.lit(1.5))
    share = 1 - F.log2((F.col("n_et") + a * p) / (F.col("n_t") + a)) / F.log2(p)
    flagged = scratch.cut(pairs.select("entity", "term", share.alias("share"), "n_et").filter(F.col("share") >= generalise), "pairs").df
    rows = flagged.agg(F.sum("n_et")).first()[0] or 0
    return scratch.cut(join_hot(held, flagged, ["entity", "term"], rows, "n_et").groupBy("_id", "_h", "term").agg(F.max("share").alias("share")), "flagged").df


def _key(docs: DataFrame) -> DataFrame:
    """Rows of equal _id and _h have equal texts, so equal spans."""
    return docs.withColumns({"_id": F.col("doc_id"), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def term_spans(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """extra: the flagged terms' spans (start, rank, end, share) for each _id, _h that has any."""
    docs = flagged.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).distinct()
    flagged = flagged.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("term").alias("_term2"), "share")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))
    once = found.filter(F.size("entities") > 0).join(docs, same, "left_semi").dropDuplicates(["_id", "_h"])
    hits = once.select("_id", "_h", F.explode("places").alias("t")).select("_id", "_h", "t.*").join(flagged, same & (F.col("term") == F.col("_term2")))
    rank = F.lit(KINDS.index("term"))
    return hits.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "share"))).alias("extra"))


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """rows with extra, without the terms that a base span covers; null if none is left."""
    extra = extra.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "extra")
    rows = rows.join(extra, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left").drop("_id2", "_h2")
    rows = rows.withColumn("extra", F.filter("extra", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))))
    return rows.withColumn("extra", F.when(F.size("extra") > 0, F.col("extra")))


def find(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, spans (base) and extra (terms, null if none) for every document."""
    scratch = Scratch(spark, "pii")
    found = scratch.cut(detect(_key(docs), ["doc_id", "_id", "_h"]), "found").df
    extra = scratch.cut(term_spans(found, disclosing(scratch, docs, found, support, generalise)), "extra").df
    plain = found.filter(F.size("entities") == 0).withColumn("extra", F.lit(None).cast(extra.schema["extra"].dataType))
    return plain.select("doc_id", "spans", "extra").unionByName(_with_extra(found.filter(F.size("entities") > 0), extra).select("doc_id", "spans", "extra"))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, table(spark, sf_dir, "documents"))
    counts = [_count("spans", rank).alias(f"n_{kind}") for rank, kind in enumerate(PATTERNS)]
    extra = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,share:double>>")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(_named(F.col("spans")), 256).alias("base_sha256"), _named(F.array_sort(F.concat("spans", extra))).alias("spans"), F.size(extra).cast("long").alias("n_term"))


def _replace(text: Column, spans: Column, remove: float) -> Column:
    """Overlapping spans go as one, under the first one's name."""
    kind = "array<struct<start:int,end:int,rank:int,share:double>>"
    item = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["share"].alias("share")))
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        spans,
        F.array().cast(kind),
        lambda a, s: F.when(F.size(a) == 0, item(s)).when(
            s["start"] < last(a)["end"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["rank"].alias("rank"), last(a)["share"].alias("share")))),
        ).otherwise(F.concat(a, item(s))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    parts = F.zip_with(F.slice(starts, 1, F.size(merged)), merged, lambda a, s: F.concat(F.substring(text, a + 1, s["start"] - a), F.when(F.coalesce(s["share"], F.lit(0.0)) >= remove, "").otherwise(F.get(names, s["rank"]))))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(text, last(starts) + 1, F.length(text)))).otherwise(text)


def sanitise(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The same rows and columns; texts without base spans pass by untouched and unshuffled."""
    scratch = Scratch(spark, "pii-text")
    columns = docs.columns
    # the row travels as one column, so that its names meet no others
    maybe = docs.filter(maybe_any(F.col("text"))).select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "doc_id", "text")
    found = scratch.cut(detect(_key(maybe), ["_id", "_h"]), "found")
    extra = scratch.cut(term_spans(found.df, disclosing(scratch, docs, found.df, support, generalise)), "extra").df
    found.drop()
    here = _with_extra(detect(_key(maybe), ["row", "_id", "_h"], False), extra)
    spans = F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(None).cast("double").alias("share"))), F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,share:double>>"))))
    text = _replace(F.col("row.text"), spans, remove)
    changed = here.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns))
    return docs.filter(~maybe_any(F.col("text"))).unionByName(changed)
