"""Row filters and label repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy import constants as K
from colloquy.operators.ordered import dense_position, order_rank, seeded_order


def filter_role(turns: DataFrame, mode="all", role="role") -> DataFrame:
    """Keep one role. Build context columns first: skipped turns still belong to the context."""
    return turns if mode == "all" else turns.filter(F.col(role) == mode)


def filter_goal_type(sessions: DataFrame, goal_type=None, col="goal_type") -> DataFrame:
    return sessions if goal_type is None else sessions.filter(F.col(col) == goal_type)


def repair_labels(belief, slots=None) -> Column:
    """Belief ``map<slot,value>`` with spelling fixes, then slot-dependent fixes, in that order."""
    spelling = F.create_map(*[F.lit(x) for kv in K.LABEL_SPELLING.items() for x in kv])

    def fixed(slot, value):
        out = F.coalesce(F.try_element_at(spelling, value), value)
        for group in K.LABEL_REPAIRS:
            chain = None
            for how, name, values, replacement in group:
                cond = slot == name if how == "is" else slot.contains(name)
                if values is not None:
                    cond = cond & out.isin(*values)
                new = out if replacement is None else F.lit(replacement)
                chain = F.when(cond, new) if chain is None else chain.when(cond, new)
            out = chain.otherwise(out)
        return out

    b = F.col(belief) if isinstance(belief, str) else belief
    if slots is None:
        return F.transform_values(b, fixed)
    listed = F.array(*[F.lit(s) for s in slots])
    return F.transform_values(b, lambda s, v: F.when(F.array_contains(listed, s), fixed(s, v)).otherwise(v))


def belief_list_to_map(belief) -> Column:
    """[(slot, value), ...] -> map; a repeated slot keeps its last value."""
    b = F.col(belief) if isinstance(belief, str) else belief
    last = F.filter(
        F.transform(b, lambda x, i: F.struct(x["slot"].alias("slot"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(b, x["i"] + 2, F.size(b)), lambda y: y["slot"] == x["slot"]),
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["slot"], x["value"])))


def domain_filter(dials: DataFrame, only="", exclude="", split="train", domains="domains", belief="belief") -> DataFrame:
    """Session filter and belief filter for unseen-domain runs; test keeps what training leaves out."""
    d = dials
    if only:
        d = d.filter(F.array_contains(domains, only))
    if exclude and split == "test":
        d = d.filter(F.array_contains(domains, exclude))
    elif exclude:
        d = d.filter(F.col(domains) != F.array(F.lit(exclude)))
    if exclude:
        keep_in = split == "test"
        test = lambda k, v: k.contains(exclude) if keep_in else ~k.contains(exclude)
    elif only:
        test = lambda k, v: k.contains(only)
    else:
        return d
    return d.withColumn(belief, F.map_filter(belief, test))


def cap_label(df: DataFrame, label: str, capped: str, n: int, order, chunk: Column) -> DataFrame:
    """First ``n`` rows (by ``order``) of one label, all rows of the others."""
    rest = df.filter(F.col(label) != capped)
    first = dense_position(df.filter(F.col(label) == capped), [label], [order], chunk, out="_rn", start=1)
    return rest.unionByName(first.filter(F.col("_rn") <= n).drop("_rn"))


def drop_unknown_labels(df: DataFrame, labels: DataFrame, label="label") -> DataFrame:
    return df.join(labels.select(label).distinct(), label, "left_semi")


def drop_unknown_features(triples: DataFrame, known: DataFrame) -> DataFrame:
    """Long-form feature triples that occur in the feature vocabulary; a turn key left empty disappears."""
    name = F.concat(F.lit("d-a-s-v:"), F.concat_ws("-", "key", "slot", "ord"))
    return triples.withColumn("name", name).join(known.select("name"), "name", "left_semi").drop("name")


def sample_fraction(df: DataFrame, pct: float, key, seed=10, shuffle=True, chunk: Column | None = None) -> DataFrame:
    """Exactly ``int(n*pct/100)`` rows: the head of a seeded permutation, or of the key order without ``shuffle``.

    Key order needs a ``chunk``: an expression that never decreases along the keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranked = order_rank(df, keys, seeded_order(seed, *keys) if shuffle else None, chunk, out="_rank")
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(float(pct)) / F.lit(100.0)).alias("_keep"))
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("_rank") <= F.col("_keep")).drop("_rank", "_keep")
