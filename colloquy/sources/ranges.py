"""Files whose line order or nesting is data, read in byte ranges by many tasks.

Spark's text reader cuts a file into blocks of bytes; a line belongs to the block where it starts. Lines are numbered
by counting per block and summing the counts of the blocks before. The same serves JSON: with ``}`` as the line
separator a document of any size is a sequence of short pieces. Whether a piece starts inside a string follows from the
quotes before it, its depth from the brackets before it, both running sums over blocks; pieces between two closings of
the entry level are one entry. No task holds a file, only an entry at a time.

The raw pieces are staged once, since block borders depend on the executors at hand; everything after reads that copy.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from colloquy.operators.ordered import running_sum
from colloquy.operators.staging import stage

BROADCAST_BLOCKS = 10_000
PIECES_PER_BLOCK = 4096
READ_BYTES = 1 << 20


def numbered_lines(spark: SparkSession, path: str, sep: str = "\n", across: bool = False) -> DataFrame:
    """(source, block, n, value): ``n`` counts from 0 per file, or ``across`` all files in the order of their names.

    A file that ends with the separator has no empty last line.
    """
    rows = spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    return _number(stage(rows, "lines"), across)


def _number(rows: DataFrame, across: bool = False) -> DataFrame:
    """Line numbers from ``_at``, which grows along a block."""
    blocks = rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    order = W.orderBy("source", "block") if across else W.partitionBy("source").orderBy("block")  # one row per block
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = stage(blocks.select("source", "block", (before - F.col("_first")).alias("_shift")), "blocks")
    few = blocks.count() <= BROADCAST_BLOCKS
    return rows.join(F.broadcast(blocks) if few else blocks, ["source", "block"]).select("source", "block", (F.col("_at") + F.col("_shift")).alias("n"), "value")


def _unzip(sep: bytes):
    """Members of zipped files, read piece by piece."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as member:
                            rest, at = b"", 0
                            while chunk := member.read(READ_BYTES):
                                *whole, rest = (rest + chunk).split(sep)
                                yield _pieces(f"{path}!{name}", whole, at)
                                at += len(whole)
                            if rest:
                                yield _pieces(f"{path}!{name}", [rest], at)

    return read


def _pieces(source: str, whole: list[bytes], at: int) -> pd.DataFrame:
    n = range(at, at + len(whole))
    return pd.DataFrame({"source": source, "block": [k // PIECES_PER_BLOCK for k in n], "n": n, "value": [p.decode() for p in whole]})


def zipped_pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """:func:`numbered_lines` of the members of zipped files; an archive is unpacked by one task, in small pieces."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return stage(files.mapInPandas(_unzip(sep.encode()), "source string, block long, n long, value string"), "lines")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(source, ord, entry): the members of each file's top-level object, or the items of its top-level array.

    A member comes as ``"key": value`` and an item as its own text. Items are objects, or lists that end in an object
    (decided per file by its first item); members and items without any object of their own are joined to the next one.
    """
    pieces = zipped_pieces(spark, path, "}") if path.endswith(".zip") else numbered_lines(spark, path, "}")
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes every quote opens or closes
    outside = lambda inside: F.regexp_replace(F.concat(F.lit('"' if inside else ""), plain), '"[^"]*("|$)', "")
    net = lambda s: F.char_length(F.regexp_replace(s, r"[^{\[]", "")) - F.char_length(F.regexp_replace(s, r"[^}\]]", ""))
    pieces = stage(
        pieces.select(
            "source", "block", "n", "value", (F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"'), F.lit("")))).alias("_quotes"),
            net(outside(False)).alias("_open"), net(outside(True)).alias("_open_inside"),
        ),
        "pieces",
    )
    light = running_sum(pieces.drop("value"), ["source"], "n", F.col("block"), "_quotes", "_seen", inclusive=False)
    ends_outside = (F.col("_seen") + F.col("_quotes")) % 2 == 0
    opened = F.when(F.col("_seen") % 2 == 0, F.col("_open")).otherwise(F.col("_open_inside"))
    light = light.select("source", "block", "n", ends_outside.alias("_closes"), (opened - ends_outside.cast("int")).alias("_delta"))
    light = stage(running_sum(light, ["source"], "n", F.col("block"), "_delta", "_depth").drop("_delta"), "depths")
    lists = F.max(F.col("value").rlike(r"^[\x{FEFF}\s]*\[\s*\["))
    level = pieces.filter("n = 0").groupBy("source").agg(F.when(lists, 2).otherwise(1).alias("_level"))
    light = light.join(level, "source").withColumn("_end", (F.col("_closes") & (F.col("_depth") == F.col("_level"))).cast("int"))
    light = stage(running_sum(light, ["source"], "n", F.col("block"), "_end", "ord", inclusive=False).select("source", "block", "n", "ord", "_end", "_level"), "entries")
    parts = pieces.select("source", "block", "n", "value").join(light, ["source", "block", "n"])
    held = parts.groupBy("source", "ord", "_level").agg(F.max("_end").alias("_end"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("_p")).filter("_end = 1")
    body = F.concat(F.array_join(F.transform("_p", lambda p: p["value"]), "}"), F.lit("}"))
    # what separates an entry from the one before: brackets, commas and space, up to its key, name or brace
    nested = F.concat(F.lit("["), F.regexp_replace(body, r"^[\x{FEFF}\s\],\[]*", ""), F.lit("]"))
    first = F.when(F.col("ord") == 0, F.regexp_replace(body, r"^[\x{FEFF}\s]*[\[{][\s,]*", "")).otherwise(F.regexp_replace(body, r"^[\s,]*", ""))
    return held.select("source", F.col("ord").cast("bigint").alias("ord"), F.when(F.col("_level") == 2, nested).otherwise(first).alias("entry"))
