"""Goals: typing, completion, references, ordering, statistics and wording.

A goal is one row: ``subs`` holds its sub-goals
``struct<id, domain, method, ref, constraints, requests>``; the flat form is an array of
tuples ``struct<id, domain, slot, value array, is_list, expressed>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K
from colloquy.functions.binding import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def constraint(slot, value, is_list=False) -> Column:
    return F.struct(F.lit(slot).alias("slot"), value.alias("value"), F.lit(is_list).alias("is_list"))


def goal_tuples(subs) -> Column:
    """Constraints then requests of every sub-goal; nearby and dish requests expect a list."""

    def one(s):
        told = F.transform(
            s["constraints"],
            lambda c: F.struct(
                s["id"].alias("id"), s["domain"].alias("domain"), c["slot"].alias("slot"), c["value"].alias("value"),
                c["is_list"].alias("is_list"), F.lit(False).alias("expressed"),
            ),
        )
        asked = F.transform(
            s["requests"],
            lambda r: F.struct(
                s["id"].alias("id"), s["domain"].alias("domain"), r.alias("slot"), F.array().cast("array<string>").alias("value"),
                (r.contains(K.NEARBY) | (r == K.DISH)).alias("is_list"), F.lit(False).alias("expressed"),
            ),
        )
        return F.concat(told, asked)

    return F.flatten(F.transform(_c(subs), one))


def _refers(t) -> Column:
    """A string value that mentions an id; for lists only an element equal to it counts."""
    text = F.exists(t["value"], lambda v: v.contains(K.REFERENCE_MARK))
    return F.when(t["is_list"], F.array_contains(t["value"], K.REFERENCE_MARK)).otherwise(text)


def _open(t) -> Column:
    return ~t["expressed"] | (F.size(F.filter(t["value"], lambda v: v != "")) == 0) | _refers(t)


def infer_goal_type(tuples) -> Column:
    """One of five goal types from the last sub-goal id, transport domains and id references."""
    t = _c(tuples)
    single = F.element_at(t, -1)["id"] == 1
    moving = F.exists(t, lambda x: x["domain"].isin(*K.TRANSPORT))
    cross = F.exists(
        t,
        lambda x: ~x["is_list"] & ~x["domain"].isin(*K.TRANSPORT) & F.exists(x["value"], lambda v: v.contains(K.APPEARS_IN)),
    )
    return (
        F.when(single, K.GOAL_SINGLE)
        .when(~moving, F.when(cross, K.GOAL_CROSS).otherwise(K.GOAL_MULTI))
        .otherwise(F.when(cross, K.GOAL_CROSS_TRANSPORT).otherwise(K.GOAL_MULTI_TRANSPORT))
    )


def goal_completed(state) -> Column:
    """Every tuple expressed, filled and free of references."""
    return F.forall(_c(state), lambda t: ~_open(t))


def reward(state, max_turn=40) -> Column:
    return F.when(goal_completed(state), F.lit(2.0 * max_turn)).otherwise(F.lit(-1.0))


def current_subgoal(state) -> Column:
    """Id of the first sub-goal with an open tuple; null when all are done."""
    return F.array_min(F.transform(F.filter(_c(state), _open), lambda t: t["id"]))


def state_acts(state) -> Column:
    """Greeting plus the acts of the expressed tuples, sorted."""

    def acts(t):
        empty = F.size(F.filter(t["value"], lambda v: v != "")) == 0
        ask = F.array(F.struct(F.lit("Request").alias("intent"), t["domain"].alias("domain"), t["slot"].alias("slot"), F.lit("").alias("value")))
        tell = F.transform(
            t["value"],
            lambda v: F.struct(F.lit("Inform").alias("intent"), t["domain"].alias("domain"), t["slot"].alias("slot"), v.alias("value")),
        )
        return F.when(empty, ask).otherwise(tell)

    greet = F.array(F.struct(*[F.lit(v).alias(n) for n, v in zip(("intent", "domain", "slot", "value"), K.GREETING)]))
    spoken = F.flatten(F.transform(F.filter(_c(state), lambda t: t["expressed"]), acts))
    return F.array_sort(F.concat(greet, spoken))


def reference_id(text) -> Column:
    """The number right after ``id=``."""
    return F.nullif(F.regexp_extract(text, r"id=(\d+)", 1), F.lit("")).cast("int")


def resolve_references(df: DataFrame, state: str, out="acts") -> DataFrame:
    """Acts for unexpressed tuples whose value refers to another sub-goal.

    A name tuple selects from the referred domain and repeats its name, any other slot
    informs with that name. References resolve inside the goal row.
    """

    def resolve(all_tuples):
        def one(t):
            ref = reference_id(F.get(t["value"], F.lit(0)))
            names = F.filter(all_tuples, lambda x: (x["id"] == ref) & (x["slot"] == K.NAME))
            target = F.get(names, F.lit(0))
            name = F.get(target["value"], F.lit(0))

            def act(i, d, s, v):
                return F.struct(i.alias("intent"), d.alias("domain"), s.alias("slot"), v.alias("value"))

            chosen = F.array(
                act(F.lit("Select"), t["domain"], F.lit(K.SOURCE_DOMAIN), target["domain"]),
                act(F.lit("Inform"), target["domain"], F.lit(K.NAME), name),
            )
            plain = F.array(act(F.lit("Inform"), t["domain"], t["slot"], name))
            none = F.array().cast("array<struct<intent:string,domain:string,slot:string,value:string>>")
            return F.when(F.size(names) == 0, none).when(t["slot"] == K.NAME, chosen).otherwise(plain)

        open_refs = F.filter(all_tuples, lambda t: ~t["expressed"] & ~t["is_list"] & _refers(t))
        return F.flatten(F.transform(open_refs, one))

    return df.withColumn(out, let(F.col(state), resolve))


def method_split(subs) -> Column:
    """single, cross (a place generated from another) or multi."""
    s = _c(subs)
    hop = F.exists(s, lambda x: x["domain"].isin(*K.DOMAINS[:3]) & (x["method"] != K.STANDALONE))
    return F.when(F.size(s) == 1, "single").when(hop, "cross").otherwise("multi")


def goal_totals(goals: DataFrame, subs="subs") -> DataFrame:
    """Share of each method, its mean sub-goal number and their distribution (long form: method, n_subs)."""
    g = goals.groupBy(method_split(subs).alias("method"), F.size(subs).alias("n_subs")).agg(F.count(F.lit(1)).alias("goals"))
    per = g.groupBy("method").agg(F.sum("goals").alias("_g"), F.sum(F.col("goals") * F.col("n_subs")).alias("_s"))
    total = g.agg(F.sum("goals").alias("_t"))
    return (
        g.join(per, "method")
        .crossJoin(F.broadcast(total))
        .select(
            "method", F.col("n_subs").cast("bigint").alias("n_subs"), "goals", F.round(F.col("_g") / F.col("_t"), 6).alias("prior"),
            F.round(F.col("_s") / F.col("_g"), 6).alias("mean_subs"),
        )
    )


def goal_domains(goals: DataFrame, subs="subs") -> DataFrame:
    """Per domain: sub-goals per goal, constraints and requests per sub-goal, goals with one and with several."""
    total = goals.agg(F.count(F.lit(1)).alias("_t"))
    flat = goals.select("goal_id", F.explode(subs).alias("s"))
    per_goal = flat.groupBy("goal_id", F.col("s.domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("s.constraints")).alias("c"), F.sum(F.size("s.requests")).alias("r")
    )
    d = per_goal.groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("g"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("m"),
    )
    r = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return d.crossJoin(F.broadcast(total)).select(
        "domain", r("n", "_t").alias("subs_per_goal"), r("c", "n").alias("constraints"), r("r", "n").alias("requests"),
        r("g", "_t").alias("goals_with"), r("m", "_t").alias("goals_with_several"),
    )


def cross_ratio(goals: DataFrame, subs="subs") -> DataFrame:
    """Share of sub-goals generated alone and by a hop."""
    alone = F.filter(subs, lambda s: s["method"] == K.STANDALONE)
    t = goals.agg(F.sum(F.size(alone)).alias("a"), F.sum(F.size(subs)).alias("n"))
    return t.select(F.round(F.col("a") / F.col("n"), 6).alias("alone"), F.round(1 - F.col("a") / F.col("n"), 6).alias("hop"))


def reorder_subgoals(subs) -> Column:
    """New order: each stand-alone sub-goal, its hops, transport as soon as both ends are placed.

    Returns ``array<struct<id, old_id, domain, ref, from_id, to_id>>`` with renumbered references.
    """

    def place(s):
        return F.coalesce(s["ref"], s["id"]).cast("long") * 2**31 + F.when(s["ref"].isNotNull(), s["id"]).otherwise(F.lit(0))

    def end(s, slot):
        c = F.filter(s["constraints"], lambda c: c["slot"] == slot)
        text = F.get(F.get(c, F.lit(0))["value"], F.lit(0))
        return F.when(s["domain"].isin(*K.TRANSPORT), F.regexp_extract(text, r"(\d+)$", 1).cast("int"))

    def order(all_subs):
        # place of every sub-goal as one sortable number
        def at(i):
            found = F.filter(all_subs, lambda x: x["id"] == i)
            return F.get(F.transform(found, lambda x: place(x)), F.lit(0))

        def key(s):
            ends = F.struct(end(s, K.ORIGIN_SLOT).alias("f"), end(s, K.DESTINATION_SLOT).alias("t"))
            moving = s["domain"].isin(*K.TRANSPORT)

            def row(e):
                where = F.when(moving, F.greatest(at(e["f"]), at(e["t"]))).otherwise(place(s))
                return F.struct(
                    where.alias("where"), moving.cast("int").alias("moving"), s["id"].alias("old_id"), s["domain"].alias("domain"),
                    s["ref"].alias("ref"), e["f"].alias("f"), e["t"].alias("t"),
                )

            return let(ends, row)

        return F.array_sort(F.transform(all_subs, key))

    def renumber(sorted_subs):
        def rows(ids):
            new = lambda i: F.array_position(ids, i).cast("int")
            return F.transform(
                sorted_subs,
                lambda s, i: F.struct(
                    (i + 1).alias("id"), s["old_id"].alias("old_id"), s["domain"].alias("domain"),
                    new(s["ref"]).alias("ref"),
                    F.least(new(s["f"]), new(s["t"])).alias("from_id"),
                    F.greatest(new(s["f"]), new(s["t"])).alias("to_id"),
                ),
            )

        return let(F.transform(sorted_subs, lambda x: x["old_id"]), rows)

    return let(let(_c(subs), order), renumber)


def _phrase_of(domain, phrases, fmt):
    """Wording of one constraint of a place domain."""

    def phrase(c):
        text = F.array_join(c["value"], "、")
        out = F.when(c["slot"].contains(K.FACILITY), fmt(K.GOAL_FACILITY_PHRASE, F.get(F.split(c["slot"], "-"), F.lit(1))) if domain == K.HOTEL else F.lit(""))
        for slot, pattern in phrases.items():
            out = out.when(c["slot"] == slot, fmt(pattern, text))
        return out.otherwise(F.lit(""))

    return phrase


def render_goal(subs) -> Column:
    """One sentence group per sub-goal, joined."""

    def fmt(pattern, *args):
        return F.format_string(pattern.replace("%d", "%s"), *args)

    def one(s):
        held = lambda slot: F.get(F.get(F.filter(s["constraints"], lambda c: c["slot"] == slot), F.lit(0))["value"], F.lit(0))
        out = None
        for domain, (verb, phrases) in K.GOAL_PLACE_PHRASES.items():
            name = held(K.NAME)
            d, i, v = F.lit(domain), s["id"].cast("string"), F.lit(verb)
            opening = (
                F.when(name.contains(K.NEARBY), fmt(K.GOAL_NEAR_PHRASE, reference_id(name).cast("string"), d, i, v))
                .when(name.isNotNull(), fmt(K.GOAL_NAMED_PHRASE, name, d, i, v))
                .otherwise(fmt(K.GOAL_ANY_PHRASE, d, i, v))
            )

            phrase = _phrase_of(domain, phrases, fmt)
            text = F.concat(opening, F.array_join(F.transform(s["constraints"], phrase), ""))
            out = F.when(s["domain"] == domain, text) if out is None else out.when(s["domain"] == domain, text)
        for domain, pattern in K.GOAL_TRIP_PHRASES.items():
            ends = lambda i: F.get(F.get(s["constraints"], F.lit(i))["value"], F.lit(0))
            out = out.when(s["domain"] == domain, fmt(pattern, ends(0), ends(1)))
        asked = F.array_join(
            F.transform(
                s["requests"],
                lambda r: F.when(r.contains(K.FACILITY), fmt(K.GOAL_FACILITY_REQUEST, F.get(F.split(r, "-"), F.lit(1)))).otherwise(r),
            ),
            "、",
        )
        return F.concat(out, fmt(K.GOAL_REQUEST_PHRASE, s["domain"], asked))

    return F.array_join(F.transform(_c(subs), one), "")


def success_blocks(sessions: DataFrame, order, done: str, goal_type: str, block=100) -> DataFrame:
    """Success rate in consecutive blocks per goal type and overall, then the mean over blocks."""
    from colloquy.operators.ordered import dense_position

    both = sessions.select(order, done, F.explode(F.array(F.col(goal_type), F.lit("all"))).alias("kind"))
    ranked = dense_position(both, ["kind"], [order], F.floor(F.col(order) / 4096), out="_i")
    rates = ranked.groupBy("kind", F.floor(F.col("_i") / block).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(done).cast("double")).alias("rate")
    )
    return rates.groupBy("kind").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("sessions"), F.round(F.avg("rate"), 6).alias("mean_rate")
    )
