"""From raw documents to token ids: quality rules, near-duplicate removal, personal data, source mixing, encoding.

Each stage takes all that its predecessor kept, with the columns of documents, and returns them too; the last returns
the encoded corpus. A null or empty text goes with the quality rules; see the operators for their other edge cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, near_dup, pii, quality_rules
from lodestone.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep_good(docs, quality_rules.fit_cascade(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    return near_dup.deduplicate(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it replaced in the texts; n_chars follows the text."""
    clean = pii.sanitise(spark, docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of what the ids decode to."""
    return bpe.encode_corpus(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing", mixed), ("BPE", encoded)]

#: Pivotal rounding and byte-pair merges have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            last.drop()
        docs, last = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
