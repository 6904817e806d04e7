"""Belief tracking as turns arrive.

The rules are those of the batch tracker (``operators.state``): column expressions turn every turn into what it does to a
belief, and the stateful operator only applies that in the order of positions. Per session it keeps one value with the
next position, the values of its slots, the open requests, what the last system turn left behind and its timer, and a map
of turns that arrived early. Every call to the store is a round trip, so a batch reads and writes the value of a session
once, and the map only where turns wait. A turn that was already applied is ignored; early turns wait until the gap closes
or the session goes idle past the watermark, after which its state is dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from colloquy import constants as K
from colloquy.functions.acts import domains_of, most_common, user_domain
from colloquy.operators import state as S

EVENT = "struct<domain:string,slot:string,op:string,value:string>"
PAIR = "struct<domain:string,slot:string>"
TURN = f"role string, domain string, no_offer boolean, events array<{EVENT}>, requests array<{PAIR}>"
OUTPUT = f"session_id long, pos long, cur_domain string, belief array<struct<domain:string,slot:string,value:string>>, pending array<{PAIR}>"
HELD = f"next long, timer long, early long, slots array<struct<domain:string,slot:string,value:string>>, open array<{PAIR}>, left array<struct<pos long, {TURN}>>"  # left: none or one
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def turn_effects(role, acts) -> list[Column]:
    """What a turn does: its domain, whether it clears, its events in the order they apply, and what it requests or answers."""
    pair = lambda a: F.struct(a["domain"].alias("domain"), a["slot"].alias("slot"))
    of = lambda *names: F.filter(acts, lambda a: a["intent"].isin(*names))
    move = lambda a: F.struct(a["domain"].alias("domain"), a["value"].alias("slot"), F.lit("move").alias("op"), F.lit("").alias("value"))
    events = F.concat(F.transform(of("Select"), move), F.filter(F.transform(of("Inform"), S.told), lambda e: e["op"].isNotNull()))
    usr = F.col(role) == "usr"
    return [
        F.col(role).alias("role"),
        F.when(usr, user_domain(acts)).otherwise(most_common(domains_of(acts, *K.SPAN_INTENTS))).alias("domain"),
        S.no_offer(acts).alias("no_offer"),
        F.when(usr, events).otherwise(F.array().cast(f"array<{EVENT}>")).alias("events"),
        F.transform(F.filter(acts, lambda a: F.when(usr, a["intent"] == "Request").otherwise(S.answers(a))), pair).alias("requests"),
    ]


class SessionTracker(StatefulProcessor):
    """Turns of one session in, one row per applied user turn out."""

    def __init__(self, idle_ms=3_600_000):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.early = handle.getMapState("early", "pos long", TURN)

    def _apply(self, turns, key, held):
        """Apply ``turns`` (pos, turn) in order to the session's slots, open requests and last system turn."""
        belief, pending, left = held["slots"], held["open"], held["left"]
        out = []
        for pos, turn in turns:
            role, domain, _, events, requests = turn
            if role != "usr":
                left = pos, turn
                continue
            if left and left[0] == pos - 1:
                _, fallback, clears, _, answered = left[1]
                domain = domain or fallback
                if clears and domain:
                    belief = {k: v for k, v in belief.items() if k[0] != domain}
                pending = [p for p in pending if p not in answered]
            for to, slot, op, value in events:
                if op == "set":
                    belief[to, slot] = value
                elif op == "append":
                    belief[to, slot] = " ".join(v for v in (belief.get((to, slot)), value) if v)
                elif name := belief.get((slot, K.NAME)):  # the name held by the domain that is pointed at
                    if slot == to:
                        belief = {k: v for k, v in belief.items() if k[0] != to}
                    belief[to, K.NEARBY + slot] = name
            pending = pending + requests
            filled = [(d, s, v) for (d, s), v in sorted(belief.items()) if v]
            out.append((key, pos, domain, [dict(zip(("domain", "slot", "value"), h)) for h in filled], [dict(zip(("domain", "slot"), p)) for p in pending]))
        held.update(slots=belief, open=pending, left=left)
        return out

    def _read(self):
        value = self.held.get()
        if value is None:
            return {"next": 0, "timer": None, "early": 0, "slots": {}, "open": [], "left": None}
        at, timer, early, slots, opened, left = value
        return {
            "next": at, "timer": timer, "early": early, "slots": {(x["domain"], x["slot"]): x["value"] for x in slots},
            "open": [(x["domain"], x["slot"]) for x in opened], "left": (left[0][0], _plain(left[0][1:])) if left else None,
        }

    def _write(self, held):
        left = held["left"]
        self.held.update((held["next"], held["timer"], held["early"], [(*k, v) for k, v in held["slots"].items()], held["open"], [(left[0], *left[1])] if left else []))

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=["session_id", "pos", "cur_domain", "belief", "pending"])

    def handleInputRows(self, key, rows, timerValues):
        held = self._read()
        at = held["next"]
        new, latest = {}, 0
        for pdf in rows:
            latest = max(latest, int(pdf["ms"].max()))
            for pos, *turn in zip(pdf["pos"], pdf["role"], pdf["domain"], pdf["no_offer"], pdf["events"], pdf["requests"]):
                if pos >= at:
                    new.setdefault(int(pos), _plain(turn))
        waiting = {k[0] for k in self.early.keys()} if held["early"] else set()
        ready = []
        while True:
            turn = new.pop(at, None)
            if at in waiting:
                turn = _plain(self.early.getValue((at,)))  # the first delivery counts
                self.early.removeKey((at,))
                waiting.remove(at)
            if turn is None:
                break
            ready.append((at, turn))
            at += 1
        for pos, turn in new.items():
            if pos not in waiting:
                self.early.updateValue((pos,), turn)
                waiting.add(pos)
        before = held["timer"]
        held.update(next=at, early=len(waiting), timer=max(latest + self.idle_ms, before or 0))
        if held["timer"] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(held["timer"])
        out = self._apply(ready, key[0], held) if ready else []
        self._write(held)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._read()
        waiting = sorted((k[0], _plain(v)) for k, v in self.early.iterator()) if held["early"] else []
        out = self._apply(waiting, key[0], held) if waiting else []
        for state in (self.held, self.early):
            state.clear()
        if out:
            yield self._frame(out)

    def close(self):
        pass


def _plain(turn) -> tuple:
    """A turn of rows, dicts or arrays as plain tuples."""
    role, domain, clears, events, requests = turn
    rows = lambda xs, names: [tuple(x[n] for n in names) for x in xs]
    return role, domain, bool(clears), rows(events, ("domain", "slot", "op", "value")), rows(requests, ("domain", "slot"))


def stream_state_tracker(turns: DataFrame, delay="10 minutes", idle_ms=3_600_000) -> DataFrame:
    """``turns(session_id, pos, role, acts array<act>, ts)`` stream -> belief after every user turn.

    The stream's session has to keep several state variables per key: ``jobs.stateful_session`` gives one that does.
    """
    if not turns.sparkSession.conf.get(PROVIDER).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"read the turns from jobs.stateful_session(spark): {PROVIDER} has to be RocksDB")
    effects = turns.withWatermark("ts", delay).select(
        "session_id", F.col("pos").cast("bigint").alias("pos"), "ts", F.unix_millis("ts").alias("ms"), *turn_effects("role", F.col("acts"))
    )
    return effects.groupBy("session_id").transformWithStateInPandas(SessionTracker(idle_ms), OUTPUT, "Append", "EventTime")
