"""Regularised quadratic discriminant over transformed document statistics.

Per class: mean and covariance of the statistics, from sums and cross products that Spark adds up over every labelled
row; the covariance is shrunk towards the pooled one and towards a multiple of the identity. A score is the logistic
of the difference of the two log densities plus the log odds of the classes; the Mahalanobis terms use Cholesky
factors that are computed once.

Statistics read the whole text as UTF-8 bytes; a null text counts as empty. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

THRESHOLD = 0.3
SHRINK_POOLED = 0.2
SHRINK_IDENTITY = 0.05
FOLDS = 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STATISTICS = ("log_bytes", "word_length", "upper", "digits", "spaces", "symbols", "stops", "marks", "wide", "own_words", "own_lines", "line_length")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text: logarithms of sizes, smoothed log odds of shares."""
    b = (text or "").encode()
    n = len(b)
    seen = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    many = lambda chars: int(seen[list(chars)].sum())
    odds = lambda k, of: math.log((k + 0.5) / (of - k + 0.5))
    words = _WORD.findall(b)
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return [
        math.log1p(n),
        math.log1p(n / max(1, len(words))),
        odds(upper, upper + lower),
        odds(int(seen[48:58].sum()), n),
        odds(many(b" \t\n\v\f\r"), n),
        odds(many(b"#*$%&<>=+~^_/\\@"), n),
        odds(many(b".,;:?"), n),
        odds(many(b"!|"), n),
        odds(int(seen[128:].sum()), n),
        odds(len(set(words)), len(words)),
        odds(len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(x) for x in texts], dtype=object)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor and half the log determinant."""

    log_prior: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    half_log_det: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(self.log_prior[k] - self.half_log_det[k] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo the folds; fold 0 is held out. A null identifier is in fold 0."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % FOLDS, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Fit on every labelled row outside fold 0. One row of sums per class reaches the driver."""
    p = len(STATISTICS)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & (fold("_id") != 0))
    x = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(fold("_id") != 0)
    x = x.select("_id", statistics_of("_text").alias("_x")).join(marked, "_id")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    at = lambda i: F.col("_x")[i]
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(p)] + [F.sum(at(i) * at(j)).alias(f"c{i}_{j}") for i, j in pairs]
    rows = {r["_y"]: r for r in x.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    count, mean, cov = [], [], []
    for k in (0, 1):
        r = rows.get(k)
        n = r["n"] if r else 0
        m = np.array([r[f"s{i}"] for i in range(p)]) / n if n else np.zeros(p)
        c = np.zeros((p, p))
        for i, j in pairs:
            c[i, j] = c[j, i] = (r[f"c{i}_{j}"] / n - m[i] * m[j]) if n else 0.0
        count.append(n), mean.append(m), cov.append(c)
    pooled = (cov[0] * count[0] + cov[1] * count[1]) / max(1, sum(count))
    whiten, half = [], []
    for k in (0, 1):
        own = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
        own = (1 - SHRINK_IDENTITY) * own + (SHRINK_IDENTITY * np.trace(own) / p + 1e-6) * np.eye(p)
        low = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(low)), half.append(float(np.log(np.diag(low)).sum()))
    prior = tuple(math.log((n + 1) / (sum(count) + 2)) for n in count)
    return Discriminant(prior, tuple(mean), tuple(whiten), tuple(half))


def score_of(model: Discriminant):
    """Column function text -> score of ``model``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([statistics(x) for x in texts])))

    return score


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; repeated rows get equal scores."""
    score = score_of(fit(docs, labels))
    out = docs.select("doc_id", (fold() == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged."""
    score = score_of(fit(docs, labels))
    return docs.filter(score(F.col("text")) >= THRESHOLD)
