"""Corpus profile: the dataset table of a dialogue corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def corpus_profile(turns: DataFrame, goals: DataFrame, by, session="session_id", totals=False) -> DataFrame:
    """Dialogues, turns, means per dialogue and rates, per split or goal type.

    ``turns(session, pos, *by, tokens, acts)``; ``goals(session, sub_goals, tuples, goal_change)``, where a dialogue
    without a goal has none of them. Everything is reduced to one row per dialogue first. With ``totals`` one pass gives
    every subset of ``by`` too, null standing for all.
    """
    by = [by] if isinstance(by, str) else list(by)
    said = lambda i: F.exists("acts", lambda a: a["intent"] == i)
    per = turns.groupBy(*by, session).agg(
        F.count(F.lit(1)).alias("t"), F.sum(F.size("tokens")).alias("w"), F.sum(F.size("acts")).alias("a"),
        F.max(said("NoOffer").cast("int")).alias("no_offer"),
        F.max((F.size(F.filter("acts", lambda a: a["intent"] == "Select")) > 0).cast("int")).alias("multi"),
    ).join(goals, session, "left").na.fill(0, ["sub_goals", "tuples", "goal_change"])
    words = turns.select(*by, F.explode("tokens").alias("token")).distinct()
    group = lambda df: df.cube(*by) if totals else df.groupBy(*by)
    vocab = group(words).agg(F.count_distinct("token").alias("vocabulary"))
    r = lambda c: F.round(c, 4)
    out = group(per).agg(
        F.count(F.lit(1)).alias("dialogues"), F.sum("t").alias("turns"), r(F.avg("sub_goals")).alias("mean_sub_goals"),
        r(F.avg("tuples")).alias("mean_tuples"), r(F.avg("t")).alias("mean_turns"), r(F.sum("w") / F.sum("t")).alias("mean_tokens"),
        r(F.sum("a") / F.sum("t")).alias("mean_acts"), r(F.avg("no_offer")).alias("no_offer_rate"),
        r(F.avg("multi")).alias("multi_query_rate"), r(F.avg("goal_change")).alias("goal_change_rate"),
    )
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"v.{c}")) for c in by]
    return out.alias("o").join(vocab.alias("v"), same, "left").select("o.*", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"))
