"""Belief tracking over annotated sessions as set-based event processing.

A session's belief is never folded turn by turn in Python. Every act becomes a slot
event (set, append or clear) ordered by ``at``; the belief of a slot is what the events
since its last reset add up to. Names that a Select reads from another domain are
resolved first, on the name events alone. All running computations are split by
``pos`` chunks, so one long session is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from colloquy import constants as K
from colloquy.functions.acts import current_domain
from colloquy.operators.ordered import carry_around, carry_last, running_sum, with_preceding
from colloquy.operators.staging import stage

APPEND_SLOTS = (K.DISH, K.FACILITY)
TRACKED_SLOTS = K.OVERWRITE_SLOTS + APPEND_SLOTS + tuple(K.NEARBY + d for d in K.DOMAINS)
_EMPTY_ACTS = "array<struct<intent:string,domain:string,slot:string,value:string>>"


def _at(pos, phase, order, sub):
    return F.struct(
        pos.cast("bigint").alias("pos"), F.lit(phase).alias("phase"), order.cast("int").alias("ord"), F.lit(sub).alias("sub")
    ).alias("at")


def tracker_turns(turns: DataFrame, session="session_id") -> DataFrame:
    """User turns with the acts of the system turn before them, the current domain and the no-offer flag."""
    usr = turns.filter("role = 'usr'").select(session, "pos", F.col("acts").alias("usr"))
    sys = turns.filter("role = 'sys'").select(session, (F.col("pos") + 1).alias("pos"), F.col("acts").alias("sys"))
    t = usr.join(sys, [session, "pos"], "left").withColumn("sys", F.coalesce("sys", F.array().cast(_EMPTY_ACTS)))
    return t.withColumn("cur_domain", current_domain("usr", "sys")).withColumn("no_offer", no_offer("sys"))


def told(a):
    """What an Inform does to the belief: struct(domain, slot, op, value), ``op`` being set, append or null for nothing."""
    facility = a["slot"].contains(K.FACILITY)
    op = F.when(a["slot"].isin(*K.OVERWRITE_SLOTS), "set").when((a["slot"] == K.DISH) | (facility & (a["value"] == K.YES)), "append")
    slot = F.when(facility, F.lit(K.FACILITY)).otherwise(a["slot"])
    value = F.when(facility, F.get(F.split(a["slot"], "-"), F.lit(1))).otherwise(a["value"])
    return F.struct(a["domain"].alias("domain"), slot.alias("slot"), op.alias("op"), value.alias("value"))


def no_offer(sys):
    """A system turn that found nothing and informs of nothing: it clears the current domain."""
    said = lambda i: F.exists(sys, lambda a: a["intent"] == i)
    return said("NoOffer") & ~said("Inform")


def answers(a):
    """Whether a system act answers requests for its domain and slot."""
    return a["intent"].isin(*K.SPAN_INTENTS)


def _user_acts(t, keys):
    return t.select(*keys, "pos", F.posexplode("usr").alias("ord", "a"))


def _name_probes(t, keys, clears, base, chunk):
    """Selects with the name of their source domain at that moment (null when unset)."""
    acts = _user_acts(t, keys)
    selects = acts.filter("a.intent = 'Select'")
    probe = selects.select(
        *keys, F.col("a.value").alias("domain"), _at(F.col("pos"), 1, F.col("ord"), 0), F.lit(None).cast("string").alias("v"),
        F.col("a.domain").alias("target"),
    )
    none = F.lit(None).cast("string").alias("target")
    same = selects.filter("a.domain = a.value").select(
        *keys, F.col("a.domain").alias("domain"), _at(F.col("pos"), 1, F.col("ord"), 1), F.lit("").alias("v"), none
    )
    named = acts.filter((F.col("a.intent") == "Inform") & (F.col("a.slot") == K.NAME)).select(
        *keys, F.col("a.domain").alias("domain"), _at(F.col("pos"), 2, F.col("ord"), 0), F.col("a.value").alias("v"), none
    )
    cleared = clears.select(*keys, "domain", "at", F.lit("").alias("v"), none)
    events = probe.unionByName(same).unionByName(named).unionByName(cleared)
    if base is not None:
        events = events.unionByName(
            base.filter(F.col("slot") == K.NAME).select(*keys, "domain", "at", F.col("value").alias("v"), none)
        )
    out = carry_last(events, [*keys, "domain"], "at", chunk, "v", "name")
    return out.filter("target is not null").select(
        *keys, F.col("domain").alias("source"), "at", F.col("target").alias("domain"),
        F.when(F.col("name") != "", F.col("name")).alias("name"),
    )


def slot_events(t: DataFrame, keys, base: DataFrame | None = None, chunk=None, slots=TRACKED_SLOTS) -> DataFrame:
    """All (domain, slot, op, value) events of the user turns ``t``, ``op`` being set, append or clear."""
    keys = list(keys)
    chunk = F.floor(F.col("at.pos") / 256) if chunk is None else chunk
    clears = t.filter("no_offer and cur_domain is not null").select(
        *keys, F.col("cur_domain").alias("domain"), _at(F.col("pos"), 0, F.lit(0), 0)
    )
    resolved = _name_probes(t, keys, clears, base, chunk).filter("name is not null")
    moved = resolved.filter("source = domain").select(
        *keys, "domain", F.col("at").withField("sub", F.lit(1)).alias("at")
    )
    every = F.explode(F.array(*[F.lit(s) for s in slots])).alias("slot")
    wiped = clears.unionByName(moved).select(*keys, "domain", "at", every, F.lit("clear").alias("op"), F.lit("").alias("value"))
    near = resolved.select(
        *keys, "domain", F.col("at").withField("sub", F.lit(2)).alias("at"),
        F.concat(F.lit(K.NEARBY), "source").alias("slot"), F.lit("set").alias("op"), F.col("name").alias("value"),
    )
    said = _user_acts(t, keys).filter("a.intent = 'Inform'").select(*keys, _at(F.col("pos"), 2, F.col("ord"), 0), told(F.col("a")).alias("e"))
    informed = said.filter("e.op is not null").select(*keys, "e.domain", "at", "e.slot", "e.op", "e.value")
    events = wiped.unionByName(near).unionByName(informed)
    if base is not None:
        events = events.unionByName(base.select(*keys, "domain", "at", "slot", F.lit("set").alias("op"), "value"))
    return events


def running_values(events: DataFrame, keys, chunk=None) -> DataFrame:
    """Value of the slot after each event, chunk by chunk with a carried prefix."""
    by = [*keys, "domain", "slot"]
    chunk = F.floor(F.col("at.pos") / 256) if chunk is None else chunk
    e = events.withColumn("_chunk", chunk).withColumn("_v", F.when(F.col("value") != "", F.col("value")))
    run = W.partitionBy(*by, "_chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("_reset", F.sum((F.col("op") != "append").cast("int")).over(run))
    parts = W.partitionBy(*by, "_chunk", "_reset").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("_text", F.array_join(F.collect_list("_v").over(parts), " "))
    tails = e.groupBy(*by, "_chunk").agg(
        F.max_by("_text", "at").alias("_tail"), (F.max("_reset") > 0).cast("int").alias("_had_reset")
    )
    along = W.partitionBy(*by).orderBy("_chunk")
    tails = tails.withColumn("_epoch", F.sum("_had_reset").over(along.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(
        F.collect_list(F.when(F.col("_tail") != "", F.col("_tail"))).over(
            W.partitionBy(*by, "_epoch").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
        ),
        " ",
    )
    tails = tails.withColumn("_end", joined).withColumn("_in", F.coalesce(F.lag("_end").over(along), F.lit("")))
    out = e.join(tails.select(*by, "_chunk", "_in"), [*by, "_chunk"])
    value = F.when(
        F.col("_reset") == 0,
        F.concat_ws(" ", F.when(F.col("_in") != "", F.col("_in")), F.when(F.col("_text") != "", F.col("_text"))),
    ).otherwise(F.col("_text"))
    return out.select(*by, "at", value.alias("value"))


def slot_values(events: DataFrame, keys, chunk=None) -> DataFrame:
    """Value of the slot after each event; only slots that are appended to look at events before."""
    adds = F.col("slot").isin(*APPEND_SLOTS)
    plain = events.filter(~adds).select(*keys, "domain", "slot", "at", "value")
    return plain.unionByName(running_values(events.filter(adds), keys, chunk))


def state_changes(turns: DataFrame, session="session_id") -> DataFrame:
    """(session, pos, domain, slot, value): value of every slot a user turn touched, after that turn."""
    t = stage(tracker_turns(turns, session))
    values = slot_values(stage(slot_events(t, [session])), [session])
    return values.groupBy(session, F.col("at.pos").alias("pos"), "domain", "slot").agg(F.max_by("value", "at").alias("value"))


def final_state(turns: DataFrame, session="session_id") -> DataFrame:
    """Last value per slot, unset slots left out: only what came after the last clearing of a domain is put together."""
    t = stage(tracker_turns(turns, session))
    events = stage(slot_events(t, [session], slots=("",)))
    cleared = events.filter("op = 'clear'").groupBy(session, "domain").agg(F.max("at").alias("_cleared"))
    kept = events.filter("op <> 'clear'").join(cleared, [session, "domain"], "left").filter("_cleared is null or at > _cleared")
    said = F.array_sort(F.collect_list(F.when((F.col("op") == "append") & (F.col("value") != ""), F.struct("at", "value"))))
    text = F.array_join(F.transform(said, lambda x: x["value"]), " ")
    last = F.max_by(F.when(F.col("op") == "set", F.col("value")), "at")
    value = F.when(F.col("slot").isin(*APPEND_SLOTS), text).otherwise(last).alias("value")
    return kept.groupBy(session, "domain", "slot").agg(value).filter("value <> ''")


def belief_slots(table=K.BELIEF_SLOTS):
    return F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(s).alias("slot")) for d, ss in table.items() for s in ss])


def in_slots(table=K.BELIEF_SLOTS):
    """Whether (domain, slot) is in the list."""
    of = [(F.col("domain") == d) & F.col("slot").isin(*ss) for d, ss in table.items()]
    return reduce(lambda a, b: a | b, of)


# -- beliefs as spans --------------------------------------------------------------------
# A change holds from its position to that of the slot's next one, so states are compared span by span, never slot by
# slot at every turn.


def _pos_chunk():
    return F.floor(F.col("pos") / 256)


def span_ends(turns: DataFrame, session="session_id") -> DataFrame:
    """(session, end): the position after the last turn."""
    return turns.groupBy(session).agg((F.max("pos") + 1).alias("end"))


def slot_spans(changes: DataFrame, turns: DataFrame, session="session_id") -> DataFrame:
    """(session, domain, slot, value, pos, end): where a slot holds a value."""
    spans = carry_around(changes, [session, "domain", "slot"], "pos", _pos_chunk(), [], following="_next").filter("value <> ''")
    spans = spans.join(span_ends(turns, session), session)
    return spans.withColumn("end", F.coalesce("_next", "end")).drop("_next")


def at_turns(spans: DataFrame, turns: DataFrame, session="session_id") -> DataFrame:
    """One row per span and user turn in it."""
    cells = spans.filter("pos < end").withColumn("pos", F.explode(F.sequence(F.col("pos").cast("bigint"), F.col("end") - 1))).drop("end")
    return cells.join(turns.filter("role = 'usr'").select(session, "pos"), [session, "pos"])


def compared_spans(gold: DataFrame, pred: DataFrame, session="session_id") -> DataFrame:
    """Changes of two trackers merged: what either holds (``gold``, ``pred``) from each change on, what it held before, and the next change."""
    keys = [session, "domain", "slot", "pos"]
    both = gold.select(*keys, F.col("value").alias("gold")).join(pred.select(*keys, F.col("value").alias("pred")), keys, "full_outer")
    out = carry_around(stage(both), [session, "domain", "slot"], "pos", _pos_chunk(), ["gold", "pred"], following="next")
    return out.na.fill("", ["gold", "pred", "prev_gold", "prev_pred"])


def turn_counts(gold: DataFrame, pred: DataFrame, turns: DataFrame, session="session_id") -> DataFrame:
    """Per user turn: slots set in ``gold``, in ``pred``, set alike (``hits``), and set in ``pred`` alone (``wrong``).

    Every change adds or takes one; the counts at a turn are the sums up to it.
    """
    on = lambda g, p: [g != "", p != "", (g == p) & (g != ""), (p != "") & (g == "")]
    names = ["gold", "pred", "hits", "wrong"]
    now, then = on(F.col("gold"), F.col("pred")), on(F.col("prev_gold"), F.col("prev_pred"))
    steps = compared_spans(gold, pred, session).select(session, "pos", F.lit(0).alias("turn"), *[(a.cast("int") - b.cast("int")).alias(n) for a, b, n in zip(now, then, names)])
    marks = turns.filter("role = 'usr'").select(session, "pos", F.lit(1).alias("turn"), *[F.lit(0).alias(n) for n in names])
    per = stage(steps.unionByName(marks).groupBy(session, "pos").agg(F.max("turn").alias("turn"), *[F.sum(n).alias(n) for n in names]))
    return running_sum(per, [session], "pos", _pos_chunk(), names, names).filter("turn = 1").drop("turn")


def states_at_turns(turns: DataFrame, changes: DataFrame, session="session_id", slots=None) -> DataFrame:
    """Long-form belief after every user turn for a fixed slot list ('' = unset)."""
    grid = turns.filter("role = 'usr'").select(session, "pos", F.inline(slots if slots is not None else belief_slots()))
    seen = stage(grid.join(changes, [session, "pos", "domain", "slot"], "left").withColumnRenamed("value", "_v"))
    out = carry_last(seen, [session, "domain", "slot"], "pos", F.floor(F.col("pos") / 256), "_v", "value")
    return out.drop("_v").withColumn("value", F.coalesce("value", F.lit("")))


def pending_requests(turns: DataFrame, session="session_id") -> DataFrame:
    """(session, domain, slot, n): requests still open after the last user turn.

    An answer counts once a user turn follows it, and closes every earlier request for
    the same (domain, slot).
    """
    t = tracker_turns(turns, session)
    asked = t.select(session, "pos", F.explode("usr").alias("a")).filter("a.intent = 'Request'").select(
        session, "pos", "a.domain", "a.slot"
    )
    answered = (
        t.select(session, "pos", F.explode("sys").alias("a"))
        .filter(answers(F.col("a")))
        .groupBy(session, F.col("a.domain").alias("domain"), F.col("a.slot").alias("slot"))
        .agg(F.max("pos").alias("closed"))
    )
    return (
        asked.join(answered, [session, "domain", "slot"], "left")
        .filter("closed is null or pos >= closed")
        .groupBy(session, "domain", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def teacher_forced_states(turns: DataFrame, sys_state: DataFrame, session="session_id") -> DataFrame:
    """Belief at each system turn i from the annotated state of i-2 and the user acts of i-1.

    ``sys_state(session, pos, domain, slot, value)`` is the annotated long-form state. Each
    system turn is its own small problem, so this needs no ordering along the session.
    """
    key = [session, "i"]
    usr = turns.filter("role = 'usr'").select(
        session, (F.col("pos") + 1).alias("i"), "pos", F.col("acts").alias("usr"),
        F.lit(None).cast("string").alias("cur_domain"), F.lit(False).alias("no_offer"),
    )
    sys = turns.filter("role = 'sys'").select(session, F.col("pos").alias("i"))
    t = stage(usr.join(sys, key))
    base = sys_state.filter("slot <> 'selectedResults' and value <> ''").select(
        session, (F.col("pos") + 2).alias("i"), "domain", "slot", "value",
        _at(F.lit(-1), 0, F.lit(0), 0),
    ).join(sys, key, "left_semi")
    one = F.lit(0)
    values = slot_values(stage(slot_events(t, key, stage(base), one)), key, one)
    return (
        values.groupBy(session, F.col("i").alias("pos"), "domain", "slot")
        .agg(F.max_by("value", "at").alias("value"))
        .filter("value <> ''")
    )


# -- context columns over turns ---------------------------------------------------------


def context_last_k(turns: DataFrame, k=3, session="session_id", content="content") -> DataFrame:
    """Up to k previous utterances of both roles, oldest first."""
    return with_preceding(
        turns, [session], "pos", k, lambda w: {"context": F.collect_list(content).over(w.rowsBetween(-k, -1))}
    )


def pair_turns(turns: DataFrame, session="session_id", content="content") -> DataFrame:
    """Previous turn (the other side) and the one before it (the same side)."""
    return with_preceding(
        turns, [session], "pos", 2,
        lambda w: {"prev_other": F.lag(content, 1).over(w), "prev_own": F.lag(content, 2).over(w)},
    )


def dialog_history(pairs: DataFrame, session="session_id", chunk_rows=512) -> DataFrame:
    """Running ``sys ; usr ; `` text per exchange and the exchange itself.

    ``pairs(session, i, sys, usr)``. The result repeats all earlier text in every row, so
    its size is quadratic in the exchanges of a session whatever the plan. Exchanges are joined
    within spans of ``chunk_rows`` values of ``i``; along the session only one text per span is carried.
    """
    piece = F.concat(F.col("sys"), F.lit(" ; "), F.col("usr"), F.lit(" ; "))
    cut = pairs.withColumn("_chunk", F.floor(F.col("i") / chunk_rows)).withColumn("_piece", piece)
    within = W.partitionBy(session, "_chunk").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    along = W.partitionBy(session).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.array_join(F.collect_list("_piece").over(within), ""))
    spans = cut.groupBy(session, "_chunk").agg(F.array_sort(F.collect_list(F.struct("i", "_piece"))).alias("_all"))
    spans = spans.select(session, "_chunk", F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("_text"))
    earlier = spans.select(session, "_chunk", F.array_join(F.collect_list("_text").over(along), "").alias("_earlier"))
    out = local.join(earlier, [session, "_chunk"]).withColumn("history", F.trim(F.concat("_earlier", "_local")))
    return out.withColumn("turn_text", F.trim(F.concat(F.col("sys"), F.lit(" ; "), F.col("usr")))).drop("_chunk", "_piece", "_local", "_earlier")


def state_diff(states: DataFrame, keys=("session_id",), chunk_rows=512) -> DataFrame:
    """Tuples that differ from the user's previous turn (by position) and the last expressed sub-goal id.

    ``states(session, pos, state)`` holds user turns only, pos counting every second turn. Sessions are cut into spans of
    ``chunk_rows`` positions; the last turns of a span are also sent to the next one. The states are moved once, and
    not at all where they lie by session already. A turn whose predecessor came twice is returned twice.
    """
    keys = list(keys)
    chunk = F.floor(F.col("pos") / chunk_rows)
    places = F.array(
        F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own")),
        F.when(F.pmod(F.col("pos"), F.lit(chunk_rows)) >= chunk_rows - 2, F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own"))),
    )
    cut = states.withColumn("_p", F.explode(F.filter(places, lambda p: p.isNotNull()))).select(*states.columns, "_p._chunk", "_p._own")
    two_before = W.partitionBy(*keys, "_chunk").orderBy("pos").rangeBetween(-2, -2)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "pos")])
    both = cut.withColumn("_prev", F.collect_list(F.struct("state")).over(two_before)).filter("_own")
    both = both.select(*states.columns, F.explode_outer(F.when(known, F.col("_prev"))).alias("_prev")).select(*states.columns, F.col("_prev.state").alias("prev"))
    changed = F.filter(
        F.transform("state", lambda x, i: F.when(
            F.col("prev").isNotNull() & (i < F.size("prev")) & ~x.eqNullSafe(F.get("prev", i)), x)),
        lambda x: x.isNotNull(),
    )
    expressed = F.filter("state", lambda x: x["expressed"])
    return both.withColumn("changed", changed).withColumn(
        "last_id", F.coalesce(F.get(expressed, F.size(expressed) - 1)["id"], F.lit(1))
    ).drop("prev")


def policy_examples(turns: DataFrame, changes: DataFrame, session="session_id") -> DataFrame:
    """Per system turn: user acts, previous system acts, filled slots, terminated flag and the action.

    ``terminated`` holds when the user turn is the session's second to last message.
    """
    last = turns.groupBy(session).agg(F.max("pos").alias("_last"))
    usr = turns.filter("role = 'usr'").select(session, (F.col("pos") + 1).alias("pos"), F.col("acts").alias("user_action"))
    before = turns.filter("role = 'sys'").select(
        session, (F.col("pos") + 2).alias("pos"), F.col("acts").alias("system_action")
    )
    filled = (
        states_at_turns(turns, changes, session)
        .groupBy(session, (F.col("pos") + 1).alias("pos"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("domain", "slot", (F.col("value") != "").cast("int").alias("on")))),
                lambda x: x["on"],
            ).alias("filled")
        )
    )
    sys = turns.filter("role = 'sys'").select(session, "pos", F.col("acts").alias("action"))
    return (
        sys.join(usr, [session, "pos"])
        .join(before, [session, "pos"], "left")
        .join(filled, [session, "pos"])
        .join(last, session)
        .withColumn("terminated", (F.col("pos") == F.col("_last")).cast("int"))
        .drop("_last")
    )
