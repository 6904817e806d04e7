"""Seeded orders, batches, draws and n-best shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.encode import pad_or_cut
from colloquy.operators.ordered import dense_position, global_rank, order_rank, running_sum, seeded_order


def seeded_shuffle(df: DataFrame, key, seed=42, out="rank") -> DataFrame:
    """Rank of every row in a seeded permutation (the same on every run and engine)."""
    keys = [key] if isinstance(key, str) else list(key)
    return global_rank(df.withColumn("_k", seeded_order(seed, *keys)), "_k", *keys, out=out).drop("_k")


def batch_assign(df: DataFrame, key, batch: int, epochs: int = 1, shuffle=True, seed=0, chunk: Column | None = None) -> DataFrame:
    """(epoch, batch) per row, with a possibly short last batch; every epoch has its own permutation.

    Without ``shuffle`` all epochs follow the key order, which needs a ``chunk`` that never decreases along the keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), *[F.col(k).cast("string") for k in keys]))
    ranked = order_rank(rows, keys, draw if shuffle else None, chunk, groups=["epoch"], out="_r")
    return ranked.withColumn("batch", F.floor((F.col("_r") - 1) / batch)).drop("_r")


def sort_batch_by_length(df: DataFrame, batch: str, length: str, ties, part: Column | None = None) -> DataFrame:
    """Longest first inside a batch: rows of longer lengths are counted, only those of one length are ordered.

    With ``part``, an expression that never decreases along the second and later ``ties`` of equal first ones, rows of one
    length are cut by the first tie and ``part`` as well. Keys must not be null; a null length comes last.
    """
    falling = -F.coalesce(F.col(length).cast("bigint"), F.lit(-1))
    chunk = F.struct(falling.alias("l")) if part is None else F.struct(falling.alias("l"), F.col(ties[0]).alias("t"), part.alias("p"))
    return dense_position(df, [batch], [F.col(length).desc(), *ties], chunk, out="rank", start=1)


def balanced_resample(df: DataFrame, label: str, n: int, key, seed=0) -> DataFrame:
    """n draws with replacement, labels equally likely and members of a label equally likely.

    A draw picks a label and a member number; both meet the rows in an equi-join on
    (label, number), so the cost is spread over the members drawn.
    """
    keys = [key] if isinstance(key, str) else list(key)
    members = global_rank(df.withColumn("_k", seeded_order(seed, *keys)), "_k", *keys, groups=[label], out="_m").drop("_k")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    labels = sizes.select(F.sort_array(F.collect_list(F.struct(label, "_size"))).alias("_labels"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(labels))
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{tag}"), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    pick = F.get(F.col("_labels"), F.floor(u("a") * F.size("_labels")).cast("int"))
    d = draws.withColumn("_p", pick).select("draw", F.col("_p")[label].alias(label), (F.floor(u("b") * F.col("_p._size")) + 1).alias("_m"))
    return d.join(members, [label, "_m"]).drop("_m")


def weighted_choice(weights: DataFrame, draws: DataFrame, item="item", weight="weight", draw="draw", seed=0) -> DataFrame:
    """One category per draw, proportional to its weight; null where no category has any.

    Categories lie side by side on a line in their own order, each as long as its weight (kept to nine decimals, so that
    sums are exact). The line is cut into as many equal cells as there are categories. A category is listed in every
    cell it touches, at most two a category on average, and a draw looks only at those of its cell.
    """
    kept = weights.filter(F.col(item).isNotNull() & (F.col(weight) > 0)).select(F.col(item).cast("string").alias(item), F.col(weight).cast("decimal(28,9)").alias("_w"))
    kept = kept.withColumn("_all", F.lit(0))
    upto = running_sum(kept, ["_all"], item, F.substring(item, 1, 16), "_w", "_hi")
    line = upto.select(item, (F.col("_hi") - F.col("_w")).cast("double").alias("_lo"), F.col("_hi").cast("double").alias("_hi"))
    size = kept.agg(F.sum("_w").cast("double").alias("_total"), F.count(F.lit(1)).alias("_cells"))
    cell = lambda x: F.least(F.floor(F.col(x) / F.col("_total") * F.col("_cells")), F.col("_cells") - 1)
    listed = line.crossJoin(F.broadcast(size)).select(item, "_lo", "_hi", F.explode(F.sequence(cell("_lo"), cell("_hi"))).alias("_cell"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(draw).cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    aimed = draws.crossJoin(F.broadcast(size)).withColumn("_goal", u * F.col("_total")).withColumn("_cell", cell("_goal")).drop("_total", "_cells")
    inside = (F.col("_goal") >= F.col("_lo")) & (F.col("_goal") < F.col("_hi"))
    hit = aimed.join(listed.withColumnRenamed("_cell", "_at"), (F.col("_cell") == F.col("_at")) & inside, "left")
    return hit.drop("_goal", "_cell", "_at", "_lo", "_hi")


def top_hypotheses(nbest: DataFrame, n: int, utt="utt_id", rank="rank") -> DataFrame:
    """First n hypotheses per utterance; ``rank`` is dense from 0, so this is a filter."""
    return nbest.filter(F.col(rank) < n)


def flatten_nbest(nbest: DataFrame, rows: int, width: int, pad, utt="utt_id", rank="rank", tokens="tokens") -> DataFrame:
    """rows x width tokens per utterance in one array, missing hypotheses padded."""
    kept = top_hypotheses(nbest, rows, utt, rank).select(utt, F.struct(rank, pad_or_cut(tokens, width, pad).alias("row")).alias("h"))
    got = kept.groupBy(utt).agg(F.array_sort(F.collect_list("h")).alias("h"))
    return got.select(utt, pad_or_cut(F.flatten(F.transform("h", lambda x: x["row"])), rows * width, pad).alias("flat"))
