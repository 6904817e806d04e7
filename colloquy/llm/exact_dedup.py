"""Exact duplicates by stateful streaming.

Rows flow through a streaming aggregation keyed by the text's digest. Its state never expires and is held on disk
(RocksDB): per digest the largest stable identifier, the locator of that row and the number of rows seen. Digests
seen once are settled. On a hit the whole texts are compared: rows whose digest was met more than once are grouped by
their full text, so two texts with one digest stay apart. Copies are combined before each shuffle, so a text with a
third of all rows costs one row per task.

A null text counts as empty; null identifiers rank below all others; among equal identifiers one row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.staging import stage, stage_path

FILES_PER_BATCH = 10_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(rows: DataFrame, path: str) -> DataFrame:
    """Final state (digest, keep, n) of the stream over the staged ``rows`` at ``path``."""
    spark = rows.sparkSession
    session = spark.newSession()  # the state store and its partitions are set for this stream alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # no space reserved by every partition's store
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    source = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    state = source.groupBy("digest").agg(F.max(F.struct("key", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
    out = stage_path(spark, "digests")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", stage_path(spark, "state")).trigger(availableNow=True).start()
    stream.awaitTermination()
    schema = "digest string, keep struct<key: struct<present: boolean, id: long>, locator: long>, n long"
    updates = spark.read.schema(schema + ", batch int").option("basePath", out).parquet(f"{out}/batch=*") if stream.recentProgress else spark.createDataFrame([], schema)
    return updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> Deduplicated:
    """Find the row that stays for every text; ``id_col`` is a long.

    The rows are staged once with a locator (their place in the staged table), so a lost executor cannot renumber them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("long")
    path_rows = docs.select(
        F.monotonically_increasing_id().alias("locator"),
        F.struct(ident.isNotNull().alias("present"), ident.alias("id")).alias("key"),
        digest(text).cast("string").alias("digest"),
        text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("_null_text")).alias("rest"),
    )
    path = stage_path(docs.sparkSession, "rows")
    path_rows.write.parquet(path)
    staged = docs.sparkSession.read.schema(path_rows.schema).parquet(path)
    light = staged.select("locator", "key", "digest")
    state = stage(digest_state(light, path), "state")

    hits = state.filter("n > 1").select("digest")
    same = stage(
        staged.join(hits, "digest", "left_semi").groupBy("digest", "text").agg(F.max(F.struct("key", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")),
        "texts",
    )
    met = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep"), F.max("n").alias("n"))
    settled = state.filter("n = 1").select("digest", "keep", "n").unionByName(met.filter("texts = 1").select("digest", "keep", "n"))
    clash = stage(met.filter("texts > 1").select("digest"), "clash")
    verdict = lambda: [F.col("keep.key.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.locator") == F.col("locator")).alias("kept")]
    own = [F.col("locator"), F.col("key.id").alias("doc_id"), F.col("digest")]
    plain = light.join(settled, "digest").select(*own, *verdict())
    if not clash.isEmpty():
        apart = staged.join(clash, "digest", "left_semi").select("locator", "key", "digest", "text").join(same, ["digest", "text"])
        plain = plain.unionByName(apart.select(*own, *verdict()))
    return Deduplicated(staged, plain, text_col, docs.columns)


class Deduplicated:
    """Verdicts by locator, and the rows they belong to."""

    def __init__(self, staged: DataFrame, verdicts: DataFrame, text_col: str, columns: list[str]):
        self.staged, self.verdicts, self.text_col, self.columns = staged, verdicts, text_col, columns

    def report(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept and the digest of every row; no text is moved."""
        return self.verdicts.drop("locator")

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns they came with."""
        keep = self.verdicts.filter("kept").select("locator")
        text = F.when(~F.col("rest._null_text"), F.col("text"))
        return self.staged.join(keep, "locator", "left_semi").select(*[(text if c == self.text_col else F.col(f"rest.`{c}`")).alias(c) for c in self.columns])


def report(docs: DataFrame) -> DataFrame:
    found = exact_dedup(docs.select("doc_id", "text")).report()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 g AS (SELECT *, first_value(r) OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r DESC) AS keep_r,
              max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, sha256(t) AS text_sha256 FROM g
"""
