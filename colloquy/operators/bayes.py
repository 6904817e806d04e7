"""Multinomial naive Bayes over counted tokens: a text classifier whose model is two tables.

Logarithms are kept as whole millionths, so a score is a sum of integers: it does not depend on the order of
rows or partitions, and SQL gives the same one. No vocabulary is folded, cut or collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.lookups import spread_join
from colloquy.operators.staging import stage

MAX_LABELS = 10_000  # labels of a model lie in one row; more are an error
NEVER = -(10**15)  # prior of a label without weight


@dataclass
class Model:
    """``labels(label, prior, base)`` and ``tokens(token, gains)``, where ``gains`` is an array of (label, gain)."""

    labels: DataFrame
    tokens: DataFrame


def _millionths(x) -> Column:
    return F.round(F.log(x) * 1e6).cast("bigint")


def fit(train: DataFrame, tokens: str, label: str, weights: DataFrame | None = None) -> Model:
    """Weighted counts with add-one smoothing over the tokens of ``train``.

    ``weights(label, weight)`` multiplies the rows of a label (1 without it). Rows without a label are left out;
    a null or empty token array counts for the prior only.
    """
    rows = train.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(tokens).alias("_tokens"))
    counts = stage(rows.select("label", F.explode("_tokens").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    if weights is not None:
        sizes = sizes.join(weights.select(F.col(label).alias("label"), F.col("weight").cast("double").alias("w")), "label", "left")
    else:
        sizes = sizes.withColumn("w", F.lit(1.0))
    sizes = sizes.withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("share", F.col("rows") * F.col("w"))
    seen = counts.groupBy("label").agg(F.sum("n").alias("said"))
    sums = sizes.agg(F.sum("share").alias("all")).crossJoin(counts.agg(F.count_distinct("token").alias("types")))
    labels = stage(
        sizes.join(seen, "label", "left").crossJoin(F.broadcast(sums)).select(
            "label", "w",
            F.when(F.col("share") > 0, _millionths(F.col("share") / F.col("all"))).otherwise(F.lit(NEVER)).alias("prior"),
            _millionths(F.coalesce("said", F.lit(0)) * F.col("w") + F.greatest("types", F.lit(1))).alias("base"),
        )
    )
    # labels are few: gains carry their names, and one token is one row
    gains = counts.join(labels.select("label", "w"), "label").select("token", "label", _millionths(F.col("n") * F.col("w") + 1).alias("gain"))
    known = gains.groupBy("token").agg(F.collect_list(F.struct("label", "gain")).alias("gains"))
    return Model(labels.drop("w"), known)


def scores(model: Model, test: DataFrame, tokens: str, key) -> DataFrame:
    """Rows of ``test`` plus ``scores``, an array of (label, score) by label, and ``pred``, the label of the largest score.

    A score is the logarithm of prior and likelihood in millionths; tokens the model never saw are passed over, ties
    go to the smaller label. ``key`` names the columns that tell rows apart; they must not be null.
    """
    keys = list(key)
    said = test.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    met = spread_join(said, model.tokens, "token", keys)
    # one entry without a label counts the known tokens
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(1).cast("bigint").alias("gain"))), "gains")
    sums = (
        met.select(*keys, "n", F.inline(entries)).groupBy(*keys, "label").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
        .groupBy(*keys).agg(F.max(F.when(F.col("label").isNull(), F.col("gain"))).alias("_known"), F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "gain"))).alias("_gains"))
    )
    held = F.array_sort(F.collect_list(F.struct("label", "prior", "base")))
    row = model.labels.agg(F.when(F.count(F.lit(1)) > MAX_LABELS, F.raise_error(F.lit("too many labels for one row"))).otherwise(held).alias("_labels"))
    known = F.coalesce("_known", F.lit(0).cast("bigint"))
    gain = lambda c: F.coalesce(F.get(F.filter("_gains", lambda g: g["label"] == c["label"]), F.lit(0))["gain"], F.lit(0).cast("bigint"))
    out = test.join(sums, keys, "left").crossJoin(F.broadcast(row))
    out = out.withColumn("scores", F.transform("_labels", lambda c: F.struct(c["label"].alias("label"), (c["prior"] + gain(c) - known * c["base"]).alias("score"))))
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    best = F.get(F.filter("scores", lambda s: s["score"] == top), F.lit(0))["label"]
    return out.withColumn("pred", best).drop("_known", "_gains", "_labels")
