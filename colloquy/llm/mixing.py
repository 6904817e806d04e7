"""Mix sources to target weights by weighted fair queueing.

Each source gets a target: the budget is shared by weight, a source takes at most ``max_epochs`` times its size, and
what it cannot take is shared among the others. Its shuffled documents queue one after another, as often as epochs
are allowed; a document's virtual finish time is the source's words up to its end divided by the source's target. All
sources reach the budget at virtual time 1, so ranging documents by that time and cutting there gives the mix.

A source with a third of all rows is no window of its own: the shuffled order is cut into slices by a hash, each
slice is summed alone, and only slice sums are accumulated along a source. A null source is a source; documents
without words are never taken. Equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy.llm.quality_rules import words_of

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_SLICE = 4_000


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words per source, from one row per (source, source_size).

    Sources fill up in the order of cap over weight; those before the level where the rest can share what is left get
    their cap. One row per source is all that meets in a task here.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    filled = W.orderBy(F.col("_cap") / F.col("_weight"), "_at")
    upto = filled.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    s = sizes.withColumn("_at", F.row_number().over(by_name) - 1).withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    s = s.withColumn("_budget", F.sum(F.col("source_size").cast("double")).over(every) * budget_share)
    s = s.withColumn("_caps_before", F.sum("_cap").over(upto) - F.col("_cap"))
    s = s.withColumn("_weights_left", F.sum("_weight").over(every) - F.sum("_weight").over(upto) + F.col("_weight"))
    level = (F.col("_budget") - F.col("_caps_before")) / F.col("_weights_left")
    # The level of the first source that does not fill up holds for all after it; the levels fall from there on.
    open_level = F.max(F.when(level * F.col("_weight") < F.col("_cap"), level)).over(every)
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(open_level * F.col("_weight"), F.col("_cap")))).select(*sizes.columns, "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry=(), **rules) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``finish`` (virtual time of its first copy).

    ``taken`` counts words: whole copies up to the cut, and the part of the document in service when it comes.
    ``carry`` names further columns to keep, as the struct ``_carry``.
    """
    epochs = rules.get("max_epochs", MAX_EPOCHS)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("none")).alias("_key"),  # a null source joins too
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("_draw"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] if carry else []),
    )
    n_slices = max(1, sized.count() // ROWS_PER_SLICE)
    sized = sized.withColumn("_slice", F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") * n_slices / F.lit(2**32)).withColumn("_slice", F.floor("_slice"))
    slices = sized.groupBy("_key", "source", "_slice").agg(F.sum("size").alias("_words"))
    along = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = slices.select("_key", "_slice", (F.sum("_words").over(along) - F.col("_words")).alias("_before"))
    goal = targets(slices.groupBy("_key", "source").agg(F.sum("_words").alias("source_size")), **rules).drop("source")
    inside = W.partitionBy("_key", "_slice").orderBy("_draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    # The window and the join share one partitioning, so rows move once.
    queued = sized.withColumn("_inside", F.sum("size").over(inside)).join(before.join(goal, "_key"), ["_key", "_slice"])
    queued = queued.withColumn("_end", F.col("_before") + F.col("_inside"))
    start = F.col("_end") - F.col("size")
    served = lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start - F.col("source_size") * e))
    taken = served(0)
    for e in range(1, epochs):
        taken = taken + served(e)
    finish = F.when(F.col("target") > 0, F.col("_end") / F.col("target"))
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish"), *(["_carry"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents in serving order: every copy is a row, with the columns of ``docs``.

    Documents stay whole: the one in service at the cut is taken when at least half of it fits.
    """
    columns = list(docs.columns)
    rows = mix(docs, carry=columns, **options)
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(0).cast("int")
    numbered = rows.withColumn("_copies", copies).filter("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    at = F.col("finish") + F.col("_epoch") * F.col("source_size") / F.col("target")
    return numbered.orderBy(at, "doc_id").select(*[F.col(f"_carry.`{c}`").alias(c) for c in columns])


def report(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
                  md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) AS draw FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
 w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][k % 3 + 1] AS weight, source_size::DOUBLE * 2 AS cap, sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE AS budget FROM s),
 f AS (SELECT *, (budget - (sum(cap) OVER f - cap)) / (sum(weight) OVER () - sum(weight) OVER f + weight) AS level
       FROM w WINDOW f AS (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING)),
 t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight < cap THEN level END) OVER () * weight, cap)) AS target FROM f),
 q AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.r ROWS UNBOUNDED PRECEDING) - d.size AS start
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM q
"""
