"""Mining and using sentence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import acts as A
from colloquy.functions.binding import let
from colloquy.operators.lookups import select_template


def usable_for_template(turns: DataFrame, acts="acts", content="content", count_mode="found") -> DataFrame:
    """Add the delexicalised text, the multi-intent key and whether every span value was found."""
    d = turns.withColumn("_d", A.delexicalize_text(content, acts, count_mode))
    return d.select(
        *turns.columns, F.col("_d.text").alias("delex"), F.col("_d.usable").alias("usable"),
        A.multi_intent_key(acts, F.col("role")).alias("key"),
    )


def mine_templates(turns: DataFrame, acts="acts", content="content") -> DataFrame:
    """(role, key, template, n): distinct delexicalised utterances of usable turns with their counts."""
    u = usable_for_template(turns, acts, content).filter("usable")
    return u.groupBy("role", "key", F.col("delex").alias("template")).agg(F.count(F.lit(1)).alias("n"))


def manual_intents(acts, role: Column) -> Column:
    """Distinct intents of a turn in realisation order; mentions of one listable intent become one entry."""
    names = A.intent_strings(acts)

    def merged(held):
        def one(x):
            n = F.size(F.filter(held, lambda y: y == x))
            slot = F.element_at(F.split(x, r"\+"), -1)
            listable = (
                x.contains("Recommend") | x.contains("名称") | x.contains("推荐菜") | x.contains("周边")
            )
            rest = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.concat(slot, k.cast("string")))
            return F.when(listable & (n > 1), F.concat(x, F.lit("1+"), F.array_join(rest, "+"))).otherwise(x)

        return F.transform(F.array_distinct(held), one)

    m = let(names, merged)
    # merged entries come after the others before sorting, as newly added keys do
    m = let(m, lambda v: F.concat(F.filter(v, lambda x: ~x.rlike(r"1\+[^+]*2")), F.filter(v, lambda x: x.rlike(r"1\+[^+]*2"))))
    return F.when(role == "usr", A.canonical_order(m, "usr")).otherwise(A.canonical_order(m, "sys"))


def split_repeated(rows: DataFrame, library: DataFrame, base="base", n="n") -> DataFrame:
    """Cut a repetition count into the longest pieces the library holds: ``pieces`` array, null when impossible.

    ``library(base, rep)``: repetition counts with a template.
    """
    reps = library.groupBy(base).agg(F.sort_array(F.collect_set("rep")).alias("_reps"))
    start = F.struct(F.col(n).cast("int").alias("left"), F.array().cast("array<int>").alias("out"))

    def step(s, _):
        best = F.array_max(F.filter("_reps", lambda r: r <= s["left"])).cast("int")
        go = (s["left"] > 0) & best.isNotNull()
        return F.struct(
            F.when(go, s["left"] - best).otherwise(s["left"]).alias("left"),
            F.when(go, F.array_append(s["out"], best)).otherwise(s["out"]).alias("out"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.col(n).cast("int")), start, step)
    return (
        rows.join(reps, base, "left")
        .withColumn("_p", done)
        .withColumn("pieces", F.when(F.col("_p.left") == 0, F.col("_p.out")))
        .drop("_p", "_reps")
    )


def realise(turns: DataFrame, auto: DataFrame, manual: DataFrame, keys=("session_id", "pos"), seed=0) -> DataFrame:
    """Utterance per turn: a template for the whole key, else one template per intent.

    ``auto(key, template)``, ``manual(intent, template)``. Text is null when an intent has
    no template at all. Values are filled in afterwards.
    """
    keys = list(keys)
    t = turns.withColumn("key", A.multi_intent_key("acts", F.col("role")))
    whole = select_template(t, auto, "key", [F.col(k).cast("string") for k in keys], seed, "auto_template")
    miss = whole.filter("auto_template is null").select(
        *keys, F.posexplode(manual_intents("acts", F.col("role"))).alias("i", "intent")
    )
    # an absence has one generic entry
    generic = F.when(
        F.col("intent").contains("Inform") & F.col("intent").contains("无"), F.lit("Inform+主体+属性+无")
    ).otherwise(F.col("intent"))
    picked = select_template(
        miss.withColumn("intent", generic), manual, "intent", [F.col(k).cast("string") for k in keys] + [F.col("i").cast("string")], seed
    )
    parts = picked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "template"))).alias("p"), F.count(F.lit(1)).alias("n")
    )
    joined = F.array_join(
        F.transform("p", lambda x, i: A.finish_sentence(x["template"], i == F.size("p") - 1)), ""
    )
    complete = ~F.exists("p", lambda x: x["template"].isNull())
    stitched = parts.select(*keys, F.when(complete, joined).alias("manual_text"))
    out = whole.join(stitched, keys, "left").withColumn("template", F.coalesce("auto_template", "manual_text"))
    return out.withColumn("text", A.fill_template("template", "acts")).drop("auto_template", "manual_text")
