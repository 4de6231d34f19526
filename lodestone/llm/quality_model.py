"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a dozen transformed counts. Each class gets its mean and a covariance shrunk twice: towards the pooled
covariance, then towards a multiple of the identity. A score is the posterior of label 1 from the difference of the
two Mahalanobis log densities, with the Cholesky factors' inverses and log determinants computed once.

The moments are sums over every labelled row outside the held-out fold, so fitting needs no sample and two small rows
reach the driver. A document with contradicting labels trains nothing; repeated labels count once. With fewer than two
classes every score is the share of label 1, or 0.5 without labels.

Null and empty texts have the statistics of no words and are scored like others. Texts are read whole. Rows without
doc_id are scored, never held out, and train nothing. Repeated rows have equal scores, one each. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_texts, table

FOLDS, THRESHOLD = 5, 0.3
#: Shares of the pooled covariance and of the identity in a class's covariance.
POOLED, IDENTITY = 0.1, 0.01
FEATURES = ("log_words", "word_chars", "word_spread", "symbols", "shouts", "bangs", "bars", "digits", "distinct", "stutter", "same_lines", "line_words", "letters", "top_word")


def _rate(part: float, whole: float) -> float:
    return math.sqrt(part / whole) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics; square roots of rates and logarithms of counts keep their tails short."""
    text = text or ""
    words = text.split()
    n, count = len(words), text.count
    if not n:
        return [0.0] * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    shouts = sum([w.isupper() for w in words if len(w) > 1])
    stutter = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    letters = sum([w[0].isalpha() for w in words])
    return [
        math.log1p(n), math.log(sizes.mean()), math.log1p(sizes.std()), _rate(sum(map(count, "#*$%&<>")), n), _rate(shouts, n), _rate(count("!"), n), _rate(count("|"), n),
        _rate(sum(map(count, "0123456789")), len(text)), len(tally) / math.sqrt(n * min(n, 200)), _rate(stutter, n), _rate(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)), _rate(letters, n), _rate(max(tally.values()), n),
    ]


def features(docs: DataFrame) -> DataFrame:
    return map_texts(docs, ["text"], lambda: lambda text: (statistics(text),), "x array<double>", ["doc_id"])


@dataclass
class Discriminant:
    prior: float
    means: np.ndarray | None = None
    roots: np.ndarray | None = None  # inverses of the Cholesky factors
    log_dets: np.ndarray | None = None

    @classmethod
    def fitted(cls, counts: dict[int, float], sums: dict[int, np.ndarray], squares: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
        total = sum(counts.values())
        prior = counts.get(1, 0) / total if total else 0.5
        if min(counts.get(0, 0), counts.get(1, 0)) < 2:
            return cls(prior)
        means = np.array([sums[c] / counts[c] for c in (0, 1)])
        covs = [squares[c] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        shared = sum(counts[c] * covs[c] for c in (0, 1)) / total
        spread = max(np.trace(shared) / len(shared), 1e-9)
        roots, dets = [], []
        for c in (0, 1):
            cov = (1 - pooled) * covs[c] + pooled * shared
            factor = np.linalg.cholesky((1 - identity) * cov + identity * spread * np.eye(len(cov)))
            roots.append(np.linalg.inv(factor))
            dets.append(2 * np.log(np.diag(factor)).sum())
        return cls(prior, means, np.array(roots), np.array(dets))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        log = [-0.5 * ((((x - self.means[c]) @ self.roots[c].T) ** 2).sum(axis=1) + self.log_dets[c]) for c in (0, 1)]
        gap = log[1] - log[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(found: DataFrame, labels: DataFrame) -> Discriminant:
    """From features (doc_id, x) and labels (doc_id, quality) outside the held-out fold."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2").select("doc_id", "y")
    rows = found.filter(~held_out()).join(known, "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    rows = rows.select("y", *(c.alias(f"x{i}") for i, c in enumerate(x)))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    counts, first, second = {}, {}, {}
    for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums).collect():  # two rows at most
        c = int(r["y"])
        counts[c], first[c], second[c] = r["n"], np.array([r[f"s{i}"] for i in range(d)]), np.zeros((d, d))
        for i, j in pairs:
            second[c][i, j] = second[c][j, i] = r[f"q{i}_{j}"]
    return Discriminant.fitted(counts, first, second)


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scratch(spark, "quality").cut(features(table(spark, sf_dir, "documents")), "features").df
    return score(found, fit(found, table(spark, sf_dir, "labels")))
