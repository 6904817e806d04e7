"""Column functions over dialogue acts ``struct<intent,domain,slot,value>`` and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy import constants as K
from colloquy.functions.binding import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def act(intent, domain, slot, value) -> Column:
    return F.struct(
        *[
            (F.lit(v) if isinstance(v, str) else v).alias(n)
            for n, v in (("intent", intent), ("domain", domain), ("slot", slot), ("value", value))
        ]
    )


def act_text(a) -> Column:
    return F.concat_ws("+", a["intent"], a["domain"], a["slot"], a["value"])


def act_texts(acts, sep=" ") -> Column:
    return F.array_join(F.transform(_c(acts), act_text), sep)


def is_span(a, facility=K.FACILITY, intents=K.SPAN_INTENTS) -> Column:
    """The value of the act can be located in the utterance text."""
    return a["intent"].isin(*intents) & ~a["slot"].contains(facility)


def span_acts(acts, facility=K.FACILITY) -> Column:
    return F.filter(_c(acts), lambda a: is_span(a, facility))


def sentence_acts(acts, facility=K.FACILITY) -> Column:
    return F.filter(_c(acts), lambda a: ~is_span(a, facility))


def delexicalize(acts, intents=K.SPAN_INTENTS) -> Column:
    """Act strings with span values replaced by their running number within the turn."""
    acts = _c(acts)

    def one(a, i):
        same = F.size(
            F.filter(
                F.slice(acts, F.lit(1), i + 1),
                lambda b: (b["intent"] == a["intent"]) & (b["domain"] == a["domain"]) & (b["slot"] == a["slot"]),
            )
        )
        tail = F.when(a["intent"].isin(*intents), same.cast("string")).otherwise(a["value"])
        return F.concat_ws("+", a["intent"], a["domain"], a["slot"], tail)

    return F.transform(acts, one)


def sort_acts(acts) -> Column:
    return F.array_sort(_c(acts))


def most_common(values) -> Column:
    """Most frequent element; ties go to the one seen first; null when empty."""
    values = _c(values)
    ranked = F.transform(
        F.array_distinct(values),
        lambda d: F.struct(
            F.size(F.filter(values, lambda x: x == d)).alias("n"),
            (-F.array_position(values, d)).alias("first"),
            d.alias("item"),
        ),
    )
    return F.array_max(ranked)["item"]


def domains_of(acts, *intents) -> Column:
    return F.transform(F.filter(_c(acts), lambda a: a["intent"].isin(*intents)), lambda a: a["domain"])


def user_domain(usr) -> Column:
    """Domain of the user's Select, else Request, else Inform."""
    return F.coalesce(*[most_common(domains_of(usr, intent)) for intent in ("Select", "Request", "Inform")])


def current_domain(usr, sys) -> Column:
    """The user's domain, else that of the system's Inform or Recommend."""
    return F.coalesce(user_domain(usr), most_common(domains_of(sys, *K.SPAN_INTENTS)))


# -- intent strings and templates ------------------------------------------------


def _facility_part(a, i) -> Column:
    return F.get(F.split(a["slot"], "-"), F.lit(i))


def intent_string(a) -> Column:
    """Key under which an act is realised: facility and Select forms, value kept for free tickets and absences."""
    facility = a["slot"].contains(K.FACILITY)
    slot = (
        F.when(a["intent"] == "Select", F.concat(F.lit(K.SOURCE_DOMAIN + "+"), a["value"]))
        .when(facility & (a["intent"] == "Inform"), F.concat_ws("+", _facility_part(a, 0), a["value"]))
        .when(facility & (a["intent"] == "Request"), _facility_part(a, 0))
        .otherwise(a["slot"])
    )
    short = F.concat_ws("+", a["intent"], a["domain"], slot)
    full = F.concat_ws("+", short, a["value"])
    return F.when((full == K.FREE_TICKET) | (a["value"] == K.ABSENT), full).otherwise(short)


def intent_strings(acts) -> Column:
    return F.transform(_c(acts), intent_string)


def intent_rank(intent, role: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ((t, i) for i, t in enumerate(K.INTENT_ORDER[role])) for x in pair])
    base = F.get(F.split(intent, "1"), F.lit(0))
    key = F.when(base.contains("Inform") & base.contains(K.ABSENT), F.lit(K.ABSENT_INFORM)).otherwise(base)
    return F.try_element_at(table, key)


def canonical_order(intents, role: str) -> Column:
    """Stable sort by the role's fixed order; left as is when any intent is unknown."""
    intents = _c(intents)
    ranked = F.transform(
        intents, lambda x, i: F.struct(intent_rank(x, role).alias("rank"), i.alias("i"), x.alias("intent"))
    )
    unknown = F.exists(ranked, lambda r: r["rank"].isNull())
    return F.when(unknown, intents).otherwise(F.transform(F.array_sort(ranked), lambda r: r["intent"]))


def multi_intent_key(acts, role: Column) -> Column:
    names = intent_strings(acts)
    return F.array_join(
        F.when(role == "usr", canonical_order(names, "usr")).otherwise(canonical_order(names, "sys")), "*"
    )


def _replaceable(a, intent) -> Column:
    return (a["intent"].isin(*K.SPAN_INTENTS) | intent.contains(K.FACILITY)) & ~intent.endswith(K.ABSENT)


def _prepared(acts) -> Column:
    """Acts with the per-act strings the text passes need, each computed once."""

    def one(a):
        facility = F.when(a["slot"].contains(K.FACILITY), _facility_part(a, 1))
        return let(
            intent_string(a),
            lambda name: F.struct(
                a.alias("a"),
                name.alias("name"),
                _replaceable(a, name).alias("rep"),
                F.coalesce(facility, F.lit("")).alias("facility"),
                F.when(name.contains(K.FACILITY), F.coalesce(_facility_part(a, 1), a["value"]))
                .otherwise(a["value"])
                .alias("surface"),
            ),
        )

    return F.transform(_c(acts), one)


def _hit(text, p) -> Column:
    found = text.contains(p["a"]["value"]) | ((p["facility"] != "") & text.contains(p["facility"]))
    return p["rep"] & found


def _count(seen, name) -> Column:
    return F.size(F.filter(seen, lambda x: x == name))


def _mark(name, number="") -> Column:
    tail = number if isinstance(number, Column) else F.lit(number)
    return F.concat(F.lit("["), name, tail, F.lit("]"))


def _put_mark(text, p, n) -> Column:
    """The value becomes ``[name]``, a repeat ``[nameN]`` while the first is renamed ``[name1]``."""
    renamed = F.replace(text, _mark(p["name"]), _mark(p["name"], "1"))
    repeat = F.replace(renamed, p["surface"], _mark(p["name"], n.cast("string")))
    return F.when(n > 1, repeat).otherwise(F.replace(text, p["surface"], _mark(p["name"])))


def delexicalize_text(text, acts, count_mode="found") -> Column:
    """Replace act values by ``[intent]`` placeholders, act after act.

    ``count_mode='found'`` numbers only the acts whose value was found (mining),
    ``'all'`` numbers every act (scoring, features). Returns ``struct<text,seen,usable>``.
    """
    start = F.struct(
        _c(text).alias("text"), F.array().cast("array<string>").alias("seen"), F.lit(True).alias("usable")
    )

    def step(s, p):
        def counted(b):
            n = _count(b["seen"], p["name"])
            return F.struct(
                F.when(b["hit"], _put_mark(s["text"], p, n)).otherwise(s["text"]).alias("text"),
                b["seen"].alias("seen"),
                (s["usable"] & (b["hit"] | ~p["rep"])).alias("usable"),
            )

        def with_hit(hit):
            grow = F.array_append(s["seen"], p["name"])
            seen = F.when(hit, grow).otherwise(s["seen"]) if count_mode == "found" else grow
            return let(F.struct(hit.alias("hit"), seen.alias("seen")), counted)

        return let(_hit(s["text"], p), with_hit)

    return F.aggregate(_prepared(acts), start, step)


def fill_template(template, acts, clear_left=False) -> Column:
    """Put act values back into ``[intent]`` placeholders; optionally blank what is left over."""
    start = F.struct(_c(template).alias("text"), F.array().cast("array<string>").alias("seen"))

    def step(s, p):
        a = p["a"]
        absent = (a["intent"] == "Inform") & (a["value"] == K.ABSENT)
        marked = F.replace(F.replace(s["text"], F.lit(K.SUBJECT_MARK), a["domain"]), F.lit(K.ATTRIBUTE_MARK), a["slot"])
        text = F.when(absent, marked).otherwise(s["text"])

        def fill(seen):
            n = _count(seen, p["name"])
            name = F.when(n > 1, F.concat(p["name"], n.cast("string"))).otherwise(p["name"])
            return let(
                name,
                lambda m: F.struct(
                    F.replace(F.replace(text, _mark(m), p["surface"]), _mark(m, "1"), p["surface"]).alias("text"),
                    seen.alias("seen"),
                ),
            )

        return let(F.array_append(s["seen"], p["name"]), fill)

    done = F.aggregate(_prepared(acts), start, step)["text"]
    return F.regexp_replace(done, r"\[[^\[\]]+\]", " ") if clear_left else done


def feature_triples(acts, text=None) -> Column:
    """``array<struct<key,slot,ord,value>>``: domain-intent key, slot (+value), running number / ? / none, value.

    With ``text`` the value is ``none`` unless it occurs in the (progressively
    delexicalised) text; without it values are taken as they are and facility acts
    carry no number.
    """
    start = F.struct(
        (_c(text) if text is not None else F.lit("")).alias("text"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<struct<key:string,slot:string,ord:string,value:string>>").alias("out"),
    )

    def row(p, hit, n):
        a, name = p["a"], p["name"]
        number = n.cast("string")
        if text is None:
            number = F.when(name.contains(K.FACILITY), F.lit("none")).otherwise(number)
        parts = F.split(name, r"\+")
        at = lambda i: F.get(parts, F.lit(i))
        asked = a["intent"] == "Request"
        return F.struct(
            F.when(at(0) == "General", F.concat_ws("-", at(0), at(1))).otherwise(F.concat_ws("-", at(1), at(0))).alias("key"),
            F.when((at(2) == K.FACILITY) & (at(0) == "Inform"), F.concat_ws("+", at(2), at(3)))
            .when(name.endswith(K.ABSENT), F.concat(at(2), F.lit("+" + K.ABSENT)))
            .when(name.endswith(K.FREE), F.concat(at(2), F.lit("+" + K.FREE)))
            .otherwise(at(2))
            .alias("slot"),
            F.when(p["rep"], number).when(asked, F.lit("?")).otherwise(F.lit("none")).alias("ord"),
            F.when(hit, p["surface"])
            .when(p["rep"], F.lit("none"))
            .when(asked, F.lit("?"))
            .when(a["intent"] == "Select", a["value"])
            .otherwise(F.lit("none"))
            .alias("value"),
        )

    def step(s, p):
        def counted(b):
            n = _count(b["seen"], p["name"])
            kept = s["text"] if text is None else F.when(b["hit"], _put_mark(s["text"], p, n)).otherwise(s["text"])
            return F.struct(
                kept.alias("text"), b["seen"].alias("seen"), F.array_append(s["out"], row(p, b["hit"], n)).alias("out")
            )

        hit = p["rep"] if text is None else _hit(s["text"], p)
        return let(F.struct(hit.alias("hit"), F.array_append(s["seen"], p["name"]).alias("seen")), counted)

    return F.aggregate(_prepared(acts), start, step)["out"]


def feature_names(triples) -> Column:
    """The ``d:``, ``d-a:`` and ``d-a-s-v:`` strings of a turn."""
    return F.flatten(
        F.transform(
            _c(triples),
            lambda t: F.array(
                F.concat(F.lit("d:"), F.get(F.split(t["key"], "-"), F.lit(0))),
                F.concat(F.lit("d-a:"), t["key"]),
                F.concat(F.lit("d-a-s-v:"), F.concat_ws("-", t["key"], t["slot"], t["ord"])),
            ),
        )
    )


def finish_sentence(text, last) -> Column:
    """Strip stops at both ends and close with a comma, or a full stop for the last sentence."""
    body = F.regexp_replace(_c(text), r"^[。.，, ]+|[。.，, ]+$", "")
    stop = F.when(_c(last), F.lit("。")).otherwise(F.lit("，"))
    return F.when(body.rlike(r"[!?！？]$"), body).otherwise(F.concat(body, stop))
