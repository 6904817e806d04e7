"""BIO tags: encoding acts onto tokens and decoding them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy import constants as K
from colloquy.functions.acts import act_text, is_span
from colloquy.functions.binding import let

SPAN = "struct<label:string,start:int,end:int>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def default_tokens(text) -> Column:
    """Whitespace tokens with every CJK character on its own."""
    from colloquy.operators.text import CJK

    return F.filter(F.split(F.regexp_replace(_c(text), f"({CJK})", " $1 "), r"\s+"), lambda t: t != "")


def spans(text, acts, tokenize=default_tokens, facility=K.FACILITY) -> Column:
    """Token span of every located act value, at its first occurrence, in act order."""
    t = _c(text)
    located = F.filter(_c(acts), lambda a: is_span(a, facility) & (a["value"] != "") & t.contains(a["value"]))

    def one(a):
        start = F.size(tokenize(F.substring(t, F.lit(1), F.instr(t, a["value"]) - 1)))
        return F.struct(
            F.concat_ws("+", a["intent"], a["domain"], a["slot"]).alias("label"),
            start.alias("start"),
            (start + F.size(tokenize(a["value"]))).alias("end"),
        )

    return F.transform(located, one)


def bio_encode(tokens, span_col) -> Column:
    """B+/I+ labels; the first span in the list wins an overlap, tokens outside get O."""

    def tag(held, j):
        starts = F.filter(held, lambda s: (s["start"] <= j) & ((j < s["end"]) | (j == s["start"])))
        first = F.get(starts, F.lit(0))
        return (
            F.when(F.size(starts) == 0, F.lit("O"))
            .when(first["start"] == j, F.concat(F.lit("B+"), first["label"]))
            .otherwise(F.concat(F.lit("I+"), first["label"]))
        )

    return let(_c(span_col), lambda held: F.transform(_c(tokens), lambda _, j: tag(held, j)))


def golden_acts(tokens, text, acts, tokenize=default_tokens, facility=K.FACILITY) -> Column:
    """Acts with located values rebuilt from the tokens of their span."""
    t = _c(text)

    def one(a):
        start = F.size(tokenize(F.substring(t, F.lit(1), F.instr(t, a["value"]) - 1)))
        piece = F.slice(_c(tokens), start + 1, F.size(tokenize(a["value"])))
        from_tokens = F.replace(F.array_join(piece, ""), F.lit("##"), F.lit(""))
        found = is_span(a, facility) & (a["value"] != "") & t.contains(a["value"])
        return a.withField("value", F.when(found, from_tokens).otherwise(a["value"]))

    return F.transform(_c(acts), one)


def bio_decode(tokens, tags) -> Column:
    """Spans back to acts inside the row.

    B opens a span, I with the same label extends it (dropping a ``##`` prefix), anything
    else closes it; an I without an open span is ignored.
    """
    pair = F.zip_with(_c(tokens), _c(tags), lambda w, t: F.struct(w.alias("w"), t.alias("t")))
    start = F.struct(
        F.array().cast("array<struct<label:string,value:string>>").alias("done"),
        F.lit(None).cast("string").alias("label"),
        F.lit("").alias("value"),
    )

    def close(s):
        return F.when(
            s["label"].isNotNull(),
            F.array_append(s["done"], F.struct(s["label"].alias("label"), s["value"].alias("value"))),
        ).otherwise(s["done"])

    def step(s, x):
        body = F.substring(x["t"], F.lit(3), F.length(x["t"]))
        begin = x["t"].startswith("B")
        extend = x["t"].startswith("I") & s["label"].isNotNull() & (body == s["label"])
        return F.struct(
            F.when(extend, s["done"]).otherwise(close(s)).alias("done"),
            F.when(begin, body).when(extend, s["label"]).alias("label"),
            F.when(begin, x["w"])
            .when(extend, F.concat(s["value"], F.regexp_replace(x["w"], "^##", "")))
            .otherwise(F.lit(""))
            .alias("value"),
        )

    found = F.aggregate(pair, start, step, close)

    def act(x):
        p = F.split(x["label"], r"\+")
        return F.struct(
            F.get(p, F.lit(0)).alias("intent"), F.get(p, F.lit(1)).alias("domain"), F.get(p, F.lit(2)).alias("slot"),
            x["value"].alias("value"),
        )

    return F.transform(found, act)


def align_tags_to_pieces(tags, piece_counts) -> Column:
    """Copy each word's tag to all of its pieces."""
    return F.flatten(F.zip_with(_c(tags), _c(piece_counts), lambda t, n: F.array_repeat(t, n)))


def piece_word_index(piece_counts) -> Column:
    """Word number of every piece."""
    return F.flatten(F.transform(_c(piece_counts), lambda n, i: F.array_repeat(i, n)))
