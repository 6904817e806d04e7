"""Order-sensitive building blocks that never put a whole key into one task.

A plain window over a session sends all of that session's rows to one task. When
one session can hold a large share of all rows that is the bottleneck, so each
helper takes a *chunk*: an expression that never decreases along the order. Work
is partitioned by (key, chunk); only one summary row per chunk is combined along
the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def dense_position(df: DataFrame, keys, order, chunk: Column, out="pos", start=0) -> DataFrame:
    """Running row number per key (``start`` for the first row). Keys must not be null."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(
            F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    local = cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)))
    return (
        local.join(before, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_rn") + F.lit(start - 1))
        .drop("_chunk", "_before", "_rn")
    )


def with_preceding(df: DataFrame, keys, pos: str, k: int, make, chunk_rows: int = 1024) -> DataFrame:
    """Window functions that look back at most ``k`` rows.

    ``pos`` is dense per key. The last ``k`` rows of a chunk are also sent to the
    next one as context, so a window over (key, chunk) sees every row it needs;
    ``make(window)`` returns the new columns as a dict.
    """
    keys = list(keys)
    chunk_rows = max(chunk_rows, k)  # the context of a row then lies in its own chunk and the one before
    chunk = F.floor(F.col(pos) / F.lit(chunk_rows))
    spill = F.col(pos) % chunk_rows >= chunk_rows - k
    staged = df.withColumn("_chunk", chunk).withColumn("_own", F.lit(True))
    context = df.filter(spill).withColumn("_chunk", chunk + 1).withColumn("_own", F.lit(False))
    window = W.partitionBy(*keys, "_chunk").orderBy(pos)
    both = staged.unionByName(context)
    for name, column in make(window).items():
        both = both.withColumn(name, column)
    return both.filter("_own").drop("_own", "_chunk")


def carry_last(df: DataFrame, keys, order: str, chunk: Column, value: str, out: str, inclusive=True) -> DataFrame:
    """Last non-null ``value`` at (or strictly before) each row, along ``order`` per key."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    upto = 0 if inclusive else -1
    local = cut.withColumn(
        "_local",
        F.last(value, ignorenulls=True).over(
            W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, upto)
        ),
    )
    seen = F.when(F.col(value).isNotNull(), F.col(order))
    chunks = cut.groupBy(*keys, "_chunk").agg(F.max_by(value, seen).alias("_tail"))
    carried = chunks.select(
        *keys,
        "_chunk",
        F.last("_tail", ignorenulls=True)
        .over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
        .alias("_carried"),
    )
    return (
        local.join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_chunk", "_local", "_carried")
    )


def carry_around(df: DataFrame, keys, order: str, chunk: Column, values, prefix="prev_", following=None) -> DataFrame:
    """Several columns carried in one pass: ``values`` become their last non-null value up to each row.

    ``prefix`` + name holds the one strictly before it; ``following`` names the next row's ``order``. Null where there is none.
    """
    keys, values = list(keys), list(values)
    cut = df.withColumn("_chunk", chunk)
    within = W.partitionBy(*keys, "_chunk").orderBy(order)
    here, before = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(W.unboundedPreceding, -1)
    rest = [c for c in df.columns if c not in values]
    local = cut.select(
        *rest, "_chunk", F.lead(order).over(within).alias("_next"),
        *[F.last(v, ignorenulls=True).over(here).alias(f"_h_{v}") for v in values], *[F.last(v, ignorenulls=True).over(before).alias(f"_b_{v}") for v in values],
    )
    along = W.partitionBy(*keys).orderBy("_chunk")
    tails = cut.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"), *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_t_{v}") for v in values])
    tails = tails.select(
        *keys, "_chunk", F.lead("_first").over(along).alias("_later"),
        *[F.last(f"_t_{v}", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{v}") for v in values],
    )
    out = local.join(tails, [*keys, "_chunk"])
    return out.select(
        *rest, *[F.coalesce(f"_h_{v}", f"_c_{v}").alias(v) for v in values], *[F.coalesce(f"_b_{v}", f"_c_{v}").alias(prefix + v) for v in values],
        *([F.coalesce("_next", "_later").alias(following)] if following else []),
    )


def running_sum(df: DataFrame, keys, order: str, chunk: Column, value, out, inclusive=True) -> DataFrame:
    """Sum of ``value`` up to (or strictly before) each row, along ``order`` per key; lists of both give several sums."""
    if not isinstance(value, str):
        return _running_sums(df, list(keys), order, chunk, list(value), list(out), inclusive)
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    upto = 0 if inclusive else -1
    local = F.sum(value).over(W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, upto))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    chunks = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_n")).select(
        *keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before")
    )
    return (
        cut.withColumn("_local", F.coalesce(local, F.lit(0)))
        .join(chunks, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_local", "_before")
    )


def _running_sums(df, keys, order, chunk, values, outs, inclusive) -> DataFrame:
    cut = df.withColumn("_chunk", chunk)
    within = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = cut.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    chunks = chunks.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_p{i}") for i in range(len(values))])
    local = cut.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_l{i}") for i, v in enumerate(values)])
    added = {o: F.col(f"_l{i}") + F.col(f"_p{i}") for i, o in enumerate(outs)}
    return local.join(chunks, [*keys, "_chunk"]).select(*[c for c in df.columns if c not in added], *[c.alias(o) for o, c in added.items()])


def seeded_order(seed, *cols) -> Column:
    """Portable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def global_rank(df: DataFrame, order_key: str, *ties, groups=(), out="rank", prefix=3) -> DataFrame:
    """1-based rank over a hex string key without a single-partition window.

    The first ``prefix`` hex digits split the rows into up to ``16**prefix`` chunks.
    """
    return dense_position(
        df if groups else df.withColumn("_all", F.lit(0)),
        list(groups) or ["_all"],
        [order_key, *ties],
        F.substring(order_key, 1, prefix),
        out=out,
        start=1,
    ).drop("_all")


def order_rank(df: DataFrame, keys, draw: Column | None = None, chunk: Column | None = None, groups=(), out="rank") -> DataFrame:
    """1-based rank by the hex string ``draw``, or by the keys themselves cut by ``chunk``."""
    if draw is not None:
        return global_rank(df.withColumn("_k", draw), "_k", *keys, groups=groups, out=out).drop("_k")
    if chunk is None:
        raise ValueError("key order needs a chunk")
    whole = df if groups else df.withColumn("_all", F.lit(0))
    return dense_position(whole, list(groups) or ["_all"], list(keys), chunk, out=out, start=1).drop("_all")
