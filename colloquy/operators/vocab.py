"""Vocabularies, distributions and class weights.

Every operator counts with a partial aggregation first; ordering and numbering then
run on the vocabulary, never on the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.constants import EXPERIMENT_DOMAINS, GENERATOR_SPECIALS
from colloquy.functions.acts import delexicalize
from colloquy.operators.lookups import spread_join, token_maps
from colloquy.operators.ordered import dense_position


def numbered(vocab: DataFrame, *order, chunk, out="id", start=0, groups=()) -> DataFrame:
    """Consecutive ids over distinct vocabulary entries, chunk by chunk.

    A vocabulary is one row per distinct entry, so the numbering handles type counts,
    not token counts. ``chunk`` never decreases along the order.
    """
    staged = vocab if groups else vocab.withColumn("_all", F.lit(0))
    return dense_position(staged, list(groups) or ["_all"], order, chunk, out=out, start=start).drop("_all")


def act_vocabulary(turns: DataFrame, acts="acts", side="role") -> DataFrame:
    """Sorted distinct delexicalised acts per side with ids."""
    rows = turns.select(side, F.explode(delexicalize(acts)).alias("act")).distinct()
    return numbered(rows, "act", groups=[side], chunk=F.substring("act", 1, 16))


def act_ids(turns: DataFrame, vocab: DataFrame, key, acts="acts", side="role", out="act_ids", names="act_names") -> DataFrame:
    """Vocabulary ids of each turn's delexicalised acts and a map from those ids back to the acts.

    ``vocab(role, act, id)`` as :func:`act_vocabulary` makes it; acts outside it have no id. ``key`` tells turns apart.
    """
    of = lambda act: F.concat_ws("\u0001", F.col(side), act)
    entries = vocab.select(of(F.col("act")).alias("token"), F.struct(F.col("id").cast("int").alias("id"), "act").alias("value"))
    said = turns.withColumn("_acts", F.transform(delexicalize(acts), of))
    found = F.filter(F.transform("_acts", lambda t: F.try_element_at("_m", t)), lambda x: x.isNotNull())
    back = F.map_from_entries(F.transform(F.map_values("_m"), lambda v: F.struct(v["id"], v["act"])))
    return token_maps(said, "_acts", entries, key).withColumn(out, F.transform(found, lambda x: x["id"])).withColumn(names, back).drop("_acts", "_m")


def act_dims(vocab: DataFrame, side="role") -> DataFrame:
    """One row: the number of acts of the user and of the system."""
    of = lambda r: F.coalesce(F.sum((F.col(side) == r).cast("int")), F.lit(0)).cast("int")
    return vocab.agg(of("usr").alias("user_dim"), of("sys").alias("system_dim"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(col, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def token_counts(df: DataFrame, tokens: str, by=()) -> DataFrame:
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("freq"))


def token_vocabulary(df: DataFrame, tokens: str, min_freq=3, specials=GENERATOR_SPECIALS) -> DataFrame:
    """Tokens seen more than ``min_freq`` times, rarest first, after the special tokens."""
    spark = df.sparkSession
    kept = token_counts(df, tokens).filter((F.col("freq") > min_freq) & (F.trim("token") != ""))
    chunk = F.struct("freq", F.substring("token", 1, 2))
    body = numbered(kept, "freq", "token", start=len(specials), chunk=chunk).select("id", "token", "freq")
    head = spark.range(len(specials)).select(
        F.col("id"), F.get(F.array(*[F.lit(s) for s in specials]), F.col("id").cast("int")).alias("token"),
        F.lit(None).cast("bigint").alias("freq"),
    )
    return head.unionByName(body)


def first_seen_vocabulary(df: DataFrame, items: str, order, specials=(), span=1024) -> DataFrame:
    """Item -> next free id in order of first appearance along ``order`` and the array position.

    The leading order column is numeric; numbering is split into spans of it.
    """
    rows = df.select(*order, F.posexplode(items).alias("_i", "item"))
    first = rows.groupBy("item").agg(F.min(F.struct(*order, "_i")).alias("first"), F.count(F.lit(1)).alias("freq"))
    if specials:
        first = first.filter(~F.col("item").isin(*specials))
    chunk = F.floor(F.col("first")[order[0]] / F.lit(span))
    return numbered(first, "first", start=len(specials), chunk=chunk).select("item", "id", "freq")


def length_histogram(df: DataFrame, length: str, by=()) -> DataFrame:
    """Counts of lengths and, per group, the largest one."""
    by = list(by)
    counts = df.groupBy(*by, F.col(length).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    longest = counts.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.max("length").alias("longest"))
    if not by:
        return counts.crossJoin(F.broadcast(longest))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return counts.join(longest, same).drop(*[f"_{b}" for b in by])


def intent_pos_weight(df: DataFrame, intents: str, vocab: DataFrame | None = None) -> DataFrame:
    """log10((N-c)/c) with c = 1 + occurrences; entries of ``vocab`` never seen get c = 1."""
    counts = df.select(F.explode(intents).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    if vocab is not None:
        counts = vocab.select("intent").join(counts, "intent", "left")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    c = F.coalesce(F.col("n"), F.lit(0)) + 1
    return counts.crossJoin(F.broadcast(total)).select(
        "intent", c.alias("c"), F.round(F.log10((F.col("_total") - c) / c), 6).alias("weight")
    )


def label_weight(df: DataFrame, label: str, power=1) -> DataFrame:
    """(1 - share)^power per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(
        label, "n", F.round(F.pow(1 - F.col("n") / F.col("_t"), F.lit(power)), 6).alias("weight")
    )


def domain_counter(df: DataFrame, domain="domain", domains=EXPERIMENT_DOMAINS) -> DataFrame:
    """Dialogues per experiment domain, from one row per (dialogue, domain)."""
    return df.filter(F.col(domain).isin(*domains)).groupBy(domain).agg(F.count(F.lit(1)).alias("dialogues"))


def feature_cardinality(names: DataFrame, col="name") -> DataFrame:
    """Distinct feature strings, descending, with their line id."""
    d = names.select(col).distinct()
    rising = numbered(d, col, chunk=F.substring(col, 1, 16))
    size = d.agg(F.count(F.lit(1)).alias("_size"))
    return rising.crossJoin(F.broadcast(size)).withColumn("id", F.col("_size") - 1 - F.col("id")).drop("_size")


def feature_offsets(cardinality: DataFrame, col="name") -> DataFrame:
    """Entries and start offset of the d:, d-a: and d-a-s-v: blocks (cumulative in that order)."""
    kind = (
        F.when(F.col(col).startswith("d:"), 1).when(F.col(col).startswith("d-a:"), 2).otherwise(3)
    )
    one = cardinality.agg(*[F.sum((kind == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3)])
    return one.select(
        F.lit(0).cast("bigint").alias("d_start"),
        F.col("n1").alias("da_start"),
        (F.col("n1") + F.col("n2")).alias("dasv_start"),
        (F.col("n1") + F.col("n2") + F.col("n3")).alias("end"),
    )


def unknown_sentence_ratio(df: DataFrame, tokens: str, vocab: DataFrame, key) -> DataFrame:
    """Share of sentences with at least one token outside ``vocab(token)``."""
    keys = list(key)
    rows = df.select(*keys, F.explode(F.array_distinct(tokens)).alias("token"))
    unknown = rows.select("token").distinct().join(vocab.select("token"), "token", "left_anti")
    hit = spread_join(rows, unknown, "token", keys).select(*keys).distinct()
    bad = hit.agg(F.count(F.lit(1)).alias("bad"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(bad).select("total", "bad", F.round(F.col("bad") / F.col("total"), 6).alias("ratio"))
