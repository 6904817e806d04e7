"""Numbered user/bot dialogue files with knowledge-base lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.features import kb_memory, memory_triples
from colloquy.operators.ordered import carry_last, running_sum
from colloquy.operators.staging import stage
from colloquy.sources.ranges import numbered_lines


def dialogue_lines(lines: DataFrame, source="source") -> DataFrame:
    """(source, n, dialogue, kind, usr, bot, kb) of numbered lines (``block``, ``n``, ``value``); a blank line starts a new dialogue."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    cut = lines.select(source, "block", "n", line.alias("line")).withColumn("blank", (F.col("line") == "").cast("int"))
    d = running_sum(cut, [source], "n", F.col("block"), "blank", "dialogue").filter("blank = 0")
    body = F.regexp_replace("line", r"^\S+ ", "")
    talk = body.contains("\t")
    f = F.split(body, "\t")
    return d.select(
        source, "n", "dialogue", F.when(talk, "talk").otherwise("kb").alias("kind"),
        F.when(talk, F.get(f, F.lit(0))).alias("usr"), F.when(talk, F.get(f, F.lit(1))).alias("bot"),
        F.when(~talk, body).alias("kb"),
    )


def read_numbered_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Files of numbered lines, each read in byte ranges; a folder's files follow each other in the order of their names."""
    lines = numbered_lines(spark, path, across=True)
    return dialogue_lines(lines.select(F.lit(path).alias("source"), F.struct("source", "block").alias("block"), "n", "value"))


def dialogue_totals(lines: DataFrame, source="source") -> DataFrame:
    """User turns (silence excluded), bot turns, KB lines and mean reply length."""
    talk = F.col("kind") == "talk"
    spoken = talk & (F.col("usr") != "<SILENCE>")
    words = F.size(F.split("bot", " "))
    per = lines.groupBy(source, "dialogue").agg(
        F.sum(spoken.cast("bigint")).alias("u"), F.sum(talk.cast("bigint")).alias("b"), F.sum((~talk).cast("bigint")).alias("k"),
        F.sum(F.when(talk, words).otherwise(0)).alias("w"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("dialogues"), F.sum("u").alias("user_turns"), F.sum("b").alias("bot_turns"),
        F.sum("k").alias("kb_lines"), F.round(F.try_divide(F.sum("w"), F.sum("b")), 6).alias("reply_words"),
    )


def memory_rows(lines: DataFrame, dialogue=("source", "dialogue"), width=4) -> DataFrame:
    """Long-form running memory: (dialogue, n, block, k, word, row) in the order it grows.

    A bot turn sees everything up to its own user words (block 0); its reply (block 1) is
    added afterwards. Spoken turns are numbered per dialogue.
    """
    keys = list(dialogue)
    talk = lines.withColumn("_talk", (F.col("kind") == "talk").cast("int"))
    t = stage(running_sum(talk, keys, "n", F.floor(F.col("n") / 4096), "_talk", "turn").drop("_talk"))
    usr = t.filter("kind = 'talk'").select(*keys, "n", F.lit(0).alias("block"), F.posexplode(memory_triples("usr", F.lit("$u"), "turn", width)).alias("k", "row"))
    bot = t.filter("kind = 'talk'").select(*keys, "n", F.lit(1).alias("block"), F.posexplode(memory_triples("bot", F.lit("$s"), "turn", width)).alias("k", "row"))
    kb = t.filter("kind = 'kb'").select(*keys, "n", F.lit(0).alias("block"), F.lit(0).alias("k"), kb_memory("kb", width).alias("row"))
    return usr.unionByName(bot).unionByName(kb).withColumn("word", F.get("row", F.lit(0)))


def memory_positions(exchanges: DataFrame, dialogue="session_id", entities: DataFrame | None = None) -> DataFrame:
    """(dialogue, turn_id, word, last_pos): last memory position of each reply word at that turn.

    ``exchanges(dialogue, turn_id, usr, bot)``. Positions come from word counts per
    exchange: one running total per exchange instead of a rank over all words. The last
    occurrence at or before a turn is the running maximum over the word's own exchanges.
    """
    split = lambda c: F.split(c, " ")
    sized = exchanges.withColumn("_u", F.size(split("usr"))).withColumn("_b", F.size(split("bot")))
    span = F.floor(F.col("turn_id") / 1024)
    sized = stage(running_sum(sized.withColumn("_w", F.col("_u") + F.col("_b")), [dialogue], "turn_id", span, "_w", "_at", inclusive=False))
    # an occurrence in user words is visible at its own turn, one in a reply from the next turn on
    said = sized.select(
        dialogue, F.col("turn_id").alias("seen_at"), F.posexplode(split("usr")).alias("k", "word"), "_at"
    ).select(dialogue, "seen_at", "word", (F.col("_at") + F.col("k")).alias("p"))
    told = sized.select(
        dialogue, (F.col("turn_id") + 1).alias("seen_at"), F.posexplode(split("bot")).alias("k", "word"), (F.col("_at") + F.col("_u")).alias("_at")
    ).select(dialogue, "seen_at", "word", (F.col("_at") + F.col("k")).alias("p"))
    seen = said.unionByName(told).groupBy(dialogue, "word", F.col("seen_at").alias("turn_id")).agg(F.max("p").alias("p"))
    asked = sized.select(dialogue, "turn_id", F.explode(F.array_distinct(split("bot"))).alias("word"))
    if entities is not None:
        asked = asked.join(entities.select("word").distinct(), "word", "left_semi")
    asked = asked.withColumn("_ask", F.lit(True))
    both = stage(asked.join(seen, [dialogue, "word", "turn_id"], "full_outer"))
    # positions grow with the turns, so the last known one is the largest
    out = carry_last(both, [dialogue, "word"], "turn_id", span, "p", "last_pos").filter("_ask and last_pos is not null")
    return out.select(dialogue, "turn_id", "word", F.col("last_pos").cast("bigint").alias("last_pos"))
