"""Windowed streaming jobs over acts, sessions and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.operators.metrics import argmax

COMPACT_EVERY = 50


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state on disk (RocksDB); the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # no space reserved by every partition's store
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch saves its changes, not its files
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")  # counting rows reads every key before it is written
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def act_distribution(events: DataFrame, kind="event_type", ts="ts", width="1 hour", delay="1 day") -> DataFrame:
    """Acts per kind and window of event time."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, delay) if e.isStreaming else e
    return e.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), kind, "n"
    )


def session_summary(events: DataFrame, key="user_id", kind="event_type", success="purchase", failure="error", ts="ts", gap="30 minutes", delay="1 day") -> DataFrame:
    """Length and success of sessions closed by an idle gap."""
    e = events
    if delay is not None:  # without one the stream carries its watermark already
        e = e.withColumn(ts, F.col(ts).cast("timestamp"))
        e = e.withWatermark(ts, delay) if e.isStreaming else e
    s = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.max((F.col(kind) == success).cast("int")).alias("succeeded"),
        F.max((F.col(kind) == failure).cast("int")).alias("failed"),
    )
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "succeeded", "failed")


def label_metrics(predictions: DataFrame, scores="scores", label="label", ts="ts", width="1 hour", delay="1 day") -> DataFrame:
    """Right and total predictions per label and window."""
    p = predictions.withColumn(ts, F.col(ts).cast("timestamp"))
    p = p.withWatermark(ts, delay) if p.isStreaming else p
    return p.groupBy(F.window(ts, width).alias("w"), label).agg(
        F.count(F.lit(1)).alias("n"), F.sum((argmax(scores) == F.col(label)).cast("bigint")).alias("right")
    ).select(F.col("w.start").alias("start"), label, "n", "right")


def report_sink(path: str, keys=None, compact_every: int = COMPACT_EVERY):
    """``foreachBatch`` writer that upserts by (batch id, key): a replayed batch replaces itself, later batches win.

    Every batch writes its changed rows only. With ``keys`` given, each ``compact_every``-th batch also folds all rows so
    far into one per key, and what an earlier fold holds already is removed.
    """

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if keys and (batch_id + 1) % compact_every == 0:
            spark = batch.sparkSession
            older = _batches(spark, f"{path}/folded")
            _latest(spark, path, keys, batch_id).write.mode("overwrite").parquet(f"{path}/folded/batch={batch_id}")
            done = max((b for b in older if b < batch_id), default=-1)
            for kind, last in (("changes", done), ("folded", done - 1)):
                for b in _batches(spark, f"{path}/{kind}"):
                    if b <= last:
                        _fs(spark, path)[0].delete(_fs(spark, f"{path}/{kind}/batch={b}")[1], True)

    return write


def _fs(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _batches(spark, folder) -> list[int]:
    """Ids of the completely written batches of a folder."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    done = [n for n in names if n.startswith("batch=") and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def _latest(spark, path, keys, upto=None) -> DataFrame:
    base = max((b for b in _batches(spark, f"{path}/folded") if upto is None or b < upto), default=-1)
    parts = [("changes", b) for b in _batches(spark, f"{path}/changes") if b > base and (upto is None or b <= upto)]
    parts += [("folded", base)] if base >= 0 else []
    if not parts:
        raise FileNotFoundError(f"no batch was written to {path}")
    read = [spark.read.parquet(f"{path}/{kind}/batch={b}").withColumn("_batch", F.lit(b)) for kind, b in sorted(parts, key=lambda p: p[1])]
    rows = read[0]
    for more in read[1:]:
        rows = rows.unionByName(more)
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def report_table(spark, path: str, keys=("start", "label")) -> DataFrame:
    """Latest row per key over all batches of :func:`report_sink`."""
    return _latest(spark, path, keys)


def dedup_turns(turns: DataFrame, keys=("session_id", "pos"), ts="ts", delay="1 hour") -> DataFrame:
    """Drop repeated deliveries of a turn that fall within the watermark."""
    t = turns.withColumn(ts, F.col(ts).cast("timestamp"))
    if not t.isStreaming:
        return t.dropDuplicates(list(keys))
    return t.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
