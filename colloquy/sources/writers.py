"""Sinks: prepared corpora, resources and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def prepared_corpus(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows as part T and every test row twice, as D and as E."""
    twice = test.withColumn("part", F.explode(F.array(F.lit("D"), F.lit("E"))))
    return train.withColumn("part", F.lit("T")).unionByName(twice)


def write_prepared_corpus(train, test, path, mode="overwrite"):
    prepared_corpus(train, test).write.mode(mode).partitionBy("part").option("sep", "\t").csv(path)


def write_json_document(entries: DataFrame, path: str, entry: str, order, brackets="{}", parts=1, mode="overwrite"):
    """JSON documents of many entries: one object or array per part, each of its own file.

    ``entry`` is the text of a member (``"key": value``) or item, ``order`` the columns they are sorted by in a part.
    """
    opening, closing = brackets
    keys = F.struct(*order)
    rows = entries.select(F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int").alias("part"), keys.alias("_k"), F.col(entry).alias("value"))
    rows = rows.withColumn("value", F.concat(F.lit(","), "value")).withColumn("_ord", F.lit(1))
    # an entry follows its comma; the part's smallest one gets the opening bracket instead
    first = rows.groupBy("part").agg(F.min("_k").alias("_k")).withColumn("_first", F.lit(True))
    rows = rows.join(first, ["part", "_k"], "left")
    rows = rows.withColumn("value", F.when(F.col("_first"), F.concat(F.lit(opening), F.substring("value", 2, 2**31 - 1))).otherwise(F.col("value")))
    ends = first.select("part", "_k", F.lit(closing).alias("value"), F.lit(2).alias("_ord"))
    both = rows.select("part", "_k", "value", "_ord").unionByName(ends)
    both.repartition(parts, "part").sortWithinPartitions("part", "_ord", "_k").select("part", "value").write.mode(mode).partitionBy("part").text(path)


def json_member(key, value) -> Column:
    """``"key": value`` of one entry of an object."""
    text = F.to_json(F.create_map(key, value))
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def write_report(df: DataFrame, path: str, mode="overwrite"):
    """Small report tables as headerless TSV."""
    df.write.mode(mode).option("sep", "\t").csv(path)


def word_ids(vocab: DataFrame) -> DataFrame:
    """(token, id + 1) as exported next to a model."""
    return vocab.select("token", (F.col("id") + 1).alias("id"))


def run_metrics(metrics: DataFrame, run_id: str, e1: float, e2: float, e3: float) -> DataFrame:
    """Metric rows of one run tagged with its loss weights."""
    return metrics.select(
        F.lit(run_id).alias("run_id"), F.lit(float(e1)).alias("e1"), F.lit(float(e2)).alias("e2"), F.lit(float(e3)).alias("e3"), *metrics.columns
    )


def append_run(metrics, path, run_id, e1=1.0, e2=1.0, e3=1.0):
    run_metrics(metrics, run_id, e1, e2, e3).write.mode("append").parquet(path)
