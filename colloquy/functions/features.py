"""Composite feature columns built from act and belief columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.encode import multi_hot_ids, result_bucket


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def state_vector(user_ids, system_ids, filled, n_results, terminated, user_dim, system_dim) -> Column:
    """User acts, system acts, filled-slot flags, result bucket and the terminated flag as one 0/1 vector.

    Acts come as vocabulary ids; a null list counts as empty.
    """
    empty = F.array().cast("array<int>")
    return F.concat(
        multi_hot_ids(F.coalesce(_c(user_ids), empty), user_dim),
        multi_hot_ids(F.coalesce(_c(system_ids), empty), system_dim),
        _c(filled),
        multi_hot_ids(F.array(result_bucket(n_results)), 4),
        F.array(_c(terminated).cast("int")),
    )


def slot_gate(slots, belief) -> Column:
    """Per ontology slot its value (or ``none``) and whether it points into the text."""
    b = _c(belief)
    value = lambda s: F.coalesce(F.try_element_at(b, s), F.lit("none"))
    return F.transform(
        F.array(*[F.lit(s) for s in slots]),
        lambda s: F.struct(
            s.alias("slot"), value(s).alias("value"), F.when(value(s) == "none", "none").otherwise("ptr").alias("gate")
        ),
    )


def apply_gates(rows, slot_values=None) -> Column:
    """``array<struct<slot,gate,words>>`` -> belief strings; words stop at EOS, ``none`` values drop out.

    Gates other than ptr/none take their value from ``slot_values`` (a gate->value map).
    """
    def text(r):
        cut = F.array_position(r["words"], F.lit("EOS"))
        kept = F.when(cut > 0, F.slice(r["words"], F.lit(1), (cut - 1).cast("int"))).otherwise(r["words"])
        spoken = F.array_join(kept, " ")
        if slot_values is None:
            return spoken
        return F.when(r["gate"] == "ptr", spoken).otherwise(F.coalesce(F.try_element_at(slot_values, r["gate"]), spoken))

    kept = F.filter(_c(rows), lambda r: (r["gate"] != "none") & ~((r["gate"] == "ptr") & (text(r) == "none")))
    return F.transform(kept, lambda r: F.concat(r["slot"], F.lit("-"), text(r)))


def parse_belief(strings, known=None) -> Column:
    """``domain-slot-value`` (split at most twice) -> structs; optionally only known ``domain-slot`` keys."""
    def one(x):
        p = F.split(x, "-", 3)
        g = lambda i: F.trim(F.get(p, F.lit(i)))
        return F.struct(F.concat_ws("-", g(0), g(1)).alias("slot"), g(2).alias("value"))

    out = F.transform(_c(strings), one)
    return out if known is None else F.filter(out, lambda s: s["slot"].isin(*known))


def memory_triples(text, speaker, turn, width=4) -> Column:
    """Word -> [word, speaker, turnT, wordI, PAD...]."""
    return F.transform(
        F.split(_c(text), " "),
        lambda w, i: F.concat(
            F.array(w, _c(speaker), F.concat(F.lit("turn"), _c(turn).cast("string")), F.concat(F.lit("word"), i.cast("string"))),
            F.array_repeat(F.lit("PAD"), width - 4),
        ),
    )


def kb_memory(line, width=4) -> Column:
    """KB line -> its fields reversed (ratings keep their order), padded."""
    f = F.split(_c(line), " ")
    pad = F.when(F.size(f) < width, F.array_repeat(F.lit("PAD"), F.lit(width) - F.size(f))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.when(F.get(f, F.lit(1)) == "R_rating", f).otherwise(F.reverse(f)), pad)


def belief_memory(belief) -> Column:
    """``array<struct<domain,slot,value>>`` -> [domain, slot, tI, word] per value word; 'book' leaves the slot."""
    return F.flatten(
        F.transform(
            _c(belief),
            lambda b: F.transform(
                F.filter(F.split(b["value"], r"\s+"), lambda w: w != ""),
                lambda w, i: F.array(
                    b["domain"], F.trim(F.replace(b["slot"], F.lit("book"), F.lit(""))), F.concat(F.lit("t"), i.cast("string")), w
                ),
            ),
        )
    )
