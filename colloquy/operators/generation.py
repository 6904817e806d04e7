"""Scores of generated utterances: BLEU and slot error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.staging import stage


def _ngrams(tokens, n):
    t = F.col(tokens)
    size = F.size(t)
    at = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, F.lit(n)), " ").alias("gram")))


def _gram_counts(df, keys, tokens, most):
    grams = F.flatten(F.array(*[_ngrams(tokens, n) for n in range(1, most + 1)]))
    return df.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))


def bleu_counts(df: DataFrame, key: str, hyp: str, ref: str, row_key, most=4) -> DataFrame:
    """Clipped matches and totals per n, hypothesis length and closest reference length.

    Every reference of a key serves all hypotheses of that key. The references are
    reduced to the largest count per (key, n-gram) and the distinct lengths per key
    before they meet any hypothesis, and equal hypotheses of a key are counted once with
    their multiplicity, so a popular key costs its distinct content, not its pairs.
    The joins are merged: the n-grams are many times the staged file that Spark would judge them by.
    """
    rows = df.select(key, F.md5(F.array_join(hyp, "\u0001")).alias("_h"), F.md5(F.array_join(ref, "\u0001")).alias("_r"), hyp, ref)
    hyps = stage(rows.groupBy(key, "_h").agg(F.count(F.lit(1)).alias("copies"), F.first(hyp).alias("tokens")))
    refs = stage(rows.groupBy(key, "_r").agg(F.first(ref).alias("tokens")))
    most_seen = _gram_counts(refs, [key, "_r"], "tokens", most).groupBy(key, "n", "gram").agg(F.max("c").alias("limit"))
    mine = _gram_counts(hyps.select(key, "_h", "copies", "tokens"), [key, "_h", "copies"], "tokens", most)
    clipped = (
        mine.join(most_seen.hint("merge"), [key, "n", "gram"], "left")
        .groupBy("n")
        .agg(
            F.sum(F.col("copies") * F.least("c", F.coalesce("limit", F.lit(0)))).alias("hit"),
            F.sum(F.col("copies") * F.col("c")).alias("total"),
        )
    )
    hyp_lengths = hyps.groupBy(key, F.size("tokens").alias("hl")).agg(F.sum("copies").alias("copies"))
    ref_lengths = refs.select(key, F.size("tokens").alias("rl")).distinct()
    closest = (
        hyp_lengths.join(ref_lengths.hint("merge"), key)
        .groupBy(key, "hl", "copies")
        .agg(F.min(F.struct(F.abs(F.col("hl") - F.col("rl")), "rl")).alias("m"))
    )
    lengths = closest.agg(
        F.sum(F.col("copies") * F.col("hl")).alias("hyp_len"), F.sum(F.col("copies") * F.col("m.rl")).alias("ref_len")
    )
    by_n = clipped.agg(
        *[F.sum(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in range(1, most + 1) for c in ("hit", "total")]
    )
    zero = {f"{c}{n}": 0 for n in range(1, most + 1) for c in ("hit", "total")}
    return by_n.fillna(zero).crossJoin(F.broadcast(lengths))


def bleu(counts: DataFrame, weights=(0.25, 0.25, 0.25, 0.25), style="smoothed", digits=6) -> DataFrame:
    """Corpus BLEU from :func:`bleu_counts`.

    ``smoothed`` counts 0.1 for an n-gram order without a match (and is 0 without any
    unigram match); ``plain`` uses a log of -9999999999 for a zero precision and
    reports percent.
    """
    hl, rl = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(hl >= rl, F.lit(1.0)).when(hl == 0, F.lit(0.0)).otherwise(F.exp(1 - rl / hl))
    terms = []
    for i, w in enumerate(weights, 1):
        hit, total = F.col(f"hit{i}"), F.col(f"total{i}")
        if style == "smoothed":
            p = F.when(hit == 0, F.lit(0.1)).otherwise(hit.cast("double")) / F.greatest(total, F.lit(1))
            terms.append(F.lit(w) * F.log(p))
        else:
            log = F.when((total == 0) | (hit == 0), F.lit(-9999999999.0)).otherwise(F.log(hit / total))
            terms.append(F.lit(w) * log)
    score = bp * F.exp(sum(terms[1:], terms[0]))
    if style == "smoothed":
        score = F.when(F.col("hit1") == 0, F.lit(0.0)).otherwise(score)
    else:
        score = score * 100
    return counts.withColumn("bleu", F.round(score, digits))


def placeholder_counts(df: DataFrame, keys, text: str) -> DataFrame:
    """(keys, slot, got): how often each ``[placeholder]`` occurs in the text."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return df.select(*keys, F.explode(found).alias("slot")).groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("got"))


def slot_error(wanted: DataFrame, got: DataFrame, keys, by=()) -> DataFrame:
    """Redundant and missing slots over requested ones: ``wanted(keys, slot, want)``, ``got(keys, slot, got)``."""
    j = wanted.join(got, [*keys, "slot"], "full_outer")
    d = F.coalesce("got", F.lit(0)) - F.coalesce("want", F.lit(0))
    return j.groupBy(*by).agg(
        F.sum(F.coalesce("want", F.lit(0))).alias("total"),
        F.sum(F.greatest(d, F.lit(0))).alias("redundant"),
        F.sum(F.greatest(-d, F.lit(0))).alias("missing"),
    ).withColumn("slot_error", F.round(F.try_divide(F.col("redundant") + F.col("missing"), F.col("total")) * 100, 6))


def slot_error_mean(df: DataFrame, want: str, got: str) -> DataFrame:
    """Mean and deviation over turns of (missing + extra)/requested slot sets, and the pooled ratio."""
    w, g = F.array_distinct(want), F.array_distinct(got)
    bad = F.size(F.array_except(w, g)) + F.size(F.array_except(g, w))
    per = df.select(F.size(w).alias("n"), bad.alias("bad")).withColumn("err", F.when(F.col("n") > 0, F.col("bad") / F.col("n")))
    return per.agg(
        F.count("err").alias("turns"),
        F.round(F.avg("err"), 6).alias("mean"),
        F.round(F.stddev_pop("err"), 6).alias("std"),
        F.round(F.sum("bad") / F.sum("n"), 6).alias("pooled"),
    )
