"""Evaluation metrics as partial aggregations over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.acts import is_span
from colloquy.functions.binding import let


def _ratio(num, den, empty=0.0) -> Column:
    """num/den with ``empty`` when there is nothing to divide by."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty))


def _prf_columns(tp="tp", fp="fp", fn="fn"):
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, _ratio(2.0 * p * r, p + r)


def with_prf(df: DataFrame, digits=6) -> DataFrame:
    p, r, f = _prf_columns()
    return df.select(
        *df.columns, F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1")
    )


def element_counts(pred, gold):
    """(tp, fp, fn): every predicted element counts, duplicates included."""
    pred, gold = F.col(pred), F.col(gold)
    tp = F.size(F.filter(pred, lambda x: F.array_contains(gold, x)))
    fn = F.size(F.filter(gold, lambda x: ~F.array_contains(pred, x)))
    return tp, F.size(pred) - tp, fn


def micro_prf(df: DataFrame, pred="pred", gold="gold", by=()) -> DataFrame:
    """Micro precision, recall and F1 of two array columns, optionally per group."""
    tp, fp, fn = element_counts(pred, gold)
    counts = df.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return with_prf(
        counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    )


def act_outcomes(df: DataFrame, pred="pred", gold="gold", keep=()) -> DataFrame:
    """One row per act with its tp/fp/fn contribution; no join, the comparison stays inside the row."""
    p, g = F.col(pred), F.col(gold)
    rows = F.concat(
        F.transform(
            p,
            lambda x: F.struct(
                x.alias("act"),
                F.array_contains(g, x).cast("int").alias("tp"),
                (~F.array_contains(g, x)).cast("int").alias("fp"),
                F.lit(0).alias("fn"),
            ),
        ),
        F.transform(
            F.filter(g, lambda x: ~F.array_contains(p, x)),
            lambda x: F.struct(x.alias("act"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
        ),
    )
    return df.select(*keep, F.inline(rows)).select(
        *keep, "act.intent", "act.domain", "act.slot", "act.value", "tp", "fp", "fn"
    )


def prf_breakdown(df: DataFrame, pred="pred", gold="gold", goal_type="goal_type") -> DataFrame:
    """Overall, per goal type, per intent and per domain in one pass; General acts count as their own domain."""
    rows = act_outcomes(df, pred, gold, [goal_type]).withColumn(
        "domain", F.when(F.col("intent") == "General", F.lit("General")).otherwise(F.col("domain"))
    )
    dims = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("item")),
        F.struct(F.lit("goal_type").alias("dimension"), F.col(goal_type).alias("item")),
        F.struct(F.lit("intent").alias("dimension"), F.col("intent").alias("item")),
        F.struct(F.lit("domain").alias("dimension"), F.col("domain").alias("item")),
    )
    # sum per cell first: the fan-out over the dimensions then touches a handful of rows
    cells = rows.groupBy(goal_type, "intent", "domain").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = (
        cells.select(F.inline(dims), "tp", "fp", "fn")
        .groupBy("dimension", "item")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    out = with_prf(out, 12)
    return out.select(
        "dimension", "item", "tp", "fp", "fn",
        *[F.round(F.col(c) * 100, 2).alias(c) for c in ("precision", "recall", "f1")],
    )


def prf_by_kind(df: DataFrame, pred="pred", gold="gold", facility=None) -> DataFrame:
    """Overall, span-act and sentence-act scores."""
    rows = act_outcomes(df, pred, gold)
    a = {"intent": F.col("intent"), "slot": F.col("slot")}
    kind = F.when(is_span(a, facility) if facility else is_span(a), "span").otherwise("sentence")
    cells = rows.groupBy(kind.alias("kind")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    both = cells.select(F.explode(F.array("kind", F.lit("overall"))).alias("kind"), "tp", "fp", "fn")
    return with_prf(both.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def align(pred: DataFrame, gold: DataFrame, keys) -> DataFrame:
    """Keyed alignment of predictions and gold rows; ``side`` tells which rows lack a partner."""
    p = pred.withColumn("_in_pred", F.lit(True))
    g = gold.withColumn("_in_gold", F.lit(True))
    side = (
        F.when(F.col("_in_pred").isNull(), "gold_only").when(F.col("_in_gold").isNull(), "pred_only").otherwise("both")
    )
    return p.join(g, list(keys), "full_outer").withColumn("side", side).drop("_in_pred", "_in_gold")


# -- belief states -------------------------------------------------------------------


def joint_state_accuracy(states: DataFrame, turn, slot_keys, pred="pred", gold="gold", by=()) -> DataFrame:
    """Long-form states (one row per slot): share of turns with every slot equal, and share of equal slots."""
    eq = F.coalesce(F.col(pred), F.lit("")) == F.coalesce(F.col(gold), F.lit(""))
    per_turn = states.groupBy(*by, *turn).agg(
        F.min(eq.cast("int")).alias("_ok"), F.sum(eq.cast("int")).alias("_same"), F.count(F.lit(1)).alias("_n")
    )
    return per_turn.groupBy(*by).agg(
        F.count(F.lit(1)).alias("turns"),
        F.round(F.coalesce(F.avg("_ok"), F.lit(0.0)), 6).alias("joint_acc"),
        F.round(F.coalesce(F.sum("_same") / F.sum("_n"), F.lit(0.0)), 6).alias("slot_acc"),
    )


def last_dash_prefix(x) -> Column:
    return F.regexp_replace(x, "-[^-]*$", "")


def belief_scores(df: DataFrame, n_slots: int, pred="pred", gold="gold") -> DataFrame:
    """Joint accuracy, turn accuracy and mean F1 of ``slot-value`` string sets per turn."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    missed, extra = F.array_except(g, p), F.array_except(p, g)
    missed_slots = F.transform(missed, last_dash_prefix)
    wrong = F.size(F.filter(extra, lambda x: ~F.array_contains(missed_slots, last_dash_prefix(x))))
    sizes = df.select(F.size(g).alias("_g"), F.size(p).alias("_p"), (F.size(g) - F.size(missed)).alias("_h"), wrong.alias("_w"))
    return count_scores(sizes.toDF("gold", "pred", "hits", "wrong"), n_slots)


def count_scores(counts: DataFrame, n_slots: int) -> DataFrame:
    """The scores of :func:`belief_scores` from numbers per turn: slots set in ``gold``, in ``pred``, alike, in ``pred`` alone."""
    missed = F.col("gold") - F.col("hits")
    precision, recall = _ratio(F.col("hits"), F.col("pred")), _ratio(F.col("hits"), F.col("gold"))
    f1 = (
        F.when((F.col("gold") == 0) & (F.col("pred") == 0), F.lit(1.0))
        .when(F.col("gold") == 0, F.lit(0.0))
        .otherwise(_ratio(2.0 * precision * recall, precision + recall))
    )
    per = counts.select(
        ((missed == 0) & (F.col("pred") == F.col("hits"))).cast("int").alias("joint"),
        ((F.lit(n_slots) - missed - F.col("wrong")) / F.lit(float(n_slots))).alias("turn"),
        f1.alias("f1"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("turns"),
        *[F.round(F.coalesce(F.avg(a), F.lit(0.0)), 6).alias(b) for a, b in (("joint", "joint_acc"), ("turn", "turn_acc"), ("f1", "belief_f1"))],
    )


def count_accuracy(counts: DataFrame, n_slots: int, by=()) -> DataFrame:
    """:func:`joint_state_accuracy` from numbers per turn: a slot differs that is missed or set in ``pred`` alone."""
    differ = F.col("gold") - F.col("hits") + F.col("wrong")
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("turns"),
        F.round(F.coalesce(F.avg((differ == 0).cast("int")), F.lit(0.0)), 6).alias("joint_acc"),
        F.round(F.coalesce(F.sum(F.lit(n_slots) - differ) / (F.count(F.lit(1)) * n_slots), F.lit(0.0)), 6).alias("slot_acc"),
    )


# -- class scores ------------------------------------------------------------------------


def argmax(scores) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores
    return let(s, lambda v: F.array_position(v, F.array_max(v)) - 1)


def accuracy(df: DataFrame, scores, label, by=()) -> DataFrame:
    ok = (argmax(scores) == F.col(label)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 6).alias("accuracy"))


def class_report(df: DataFrame, expected, actual, other="other", empty_business=None, threshold=0.6):
    """(per-label accuracy, one row of total/business/other accuracy and the fixed threshold)."""
    ok = (F.col(expected) == F.col(actual)).cast("int")
    per_label = (
        df.groupBy(F.col(expected).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("right"))
        .select("label", "n", F.col("right"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))
    )
    is_other = F.col("label") == F.lit(other)
    cell = lambda cond: F.sum(F.when(cond, F.col("right"))) / F.sum(F.when(cond, F.col("n")))
    total = per_label.agg(
        F.round(cell(F.lit(True)), 6).alias("total"),
        F.round(F.coalesce(cell(~is_other), F.lit(empty_business).cast("double")), 6).alias("business"),
        F.round(cell(is_other), 6).alias("other"),
    ).withColumn("threshold", F.lit(float(threshold)))
    return per_label.drop("right"), total


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _exps(scores) -> Column:
    """exp(x - max) per element."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return let(s, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))


def softmax(scores) -> Column:
    return let(_exps(scores), lambda e: let(_total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(scores) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores
    shift = let(F.array_max(s), lambda top: top + F.log(_total(F.transform(s, lambda x: F.exp(x - top)))))
    return let(shift, lambda lse: F.transform(s, lambda x: x - lse))


def kl(p_logits, q_logits, form="floored") -> Column:
    """Divergence of q from p per row.

    ``floored``: sum q*ln(q/(p+1e-10)+1e-10) over softmaxed logits; ``plain``: the same
    without floors; ``log``: from log-softmax values.
    """
    if form == "log":
        terms = F.zip_with(log_softmax(p_logits), log_softmax(q_logits), lambda p, q: F.exp(q) * (q - p))
    elif form == "plain":
        terms = F.zip_with(softmax(p_logits), softmax(q_logits), lambda p, q: q * F.log(q / p))
    else:
        eps = F.lit(1e-10)
        terms = F.zip_with(softmax(p_logits), softmax(q_logits), lambda p, q: q * F.log(q / (p + eps) + eps))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def cross_entropy(logits, label) -> Column:
    """-log softmax of the true class."""
    return -F.get(log_softmax(logits), F.col(label).cast("int"))


def masked_mean_loss(df: DataFrame, losses, length) -> DataFrame:
    """Sum of the first ``length`` losses of every row over the total length."""
    kept = F.aggregate(F.slice(F.col(losses), F.lit(1), F.col(length)), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.round(F.sum(kept) / F.sum(length), 6).alias("loss"))


def coverage_loss(df: DataFrame, coverage, attention, length) -> DataFrame:
    """Sum of element-wise minima before ``length``, over the number of rows."""
    low = F.zip_with(
        F.slice(F.col(coverage), F.lit(1), F.col(length)), F.slice(F.col(attention), F.lit(1), F.col(length)),
        lambda c, a: F.least(c, a),
    )
    return df.agg(F.round(F.sum(F.aggregate(low, F.lit(0.0), lambda a, x: a + x)) / F.count(F.lit(1)), 6).alias("loss"))


def recognition_outcomes(df: DataFrame, first, second, label) -> DataFrame:
    """Per row both predictions and whether each is right (the row export behind the four counts)."""
    return df.select(
        "*",
        argmax(first).alias("first_pred"),
        argmax(second).alias("second_pred"),
        (argmax(first) == F.col(label)).alias("first_ok"),
        (argmax(second) == F.col(label)).alias("second_ok"),
    )


def position_counts(df: DataFrame, pred, gold) -> DataFrame:
    """F1 over the set positions of two 0/1 vectors per row."""
    pairs = F.zip_with(F.col(pred), F.col(gold), lambda p, g: F.struct((p != 0).alias("p"), (g != 0).alias("g")))
    n = lambda cond: F.size(F.filter(pairs, cond))
    return with_prf(
        df.agg(
            F.sum(n(lambda x: x["p"] & x["g"])).alias("tp"),
            F.sum(n(lambda x: x["p"] & ~x["g"])).alias("fp"),
            F.sum(n(lambda x: ~x["p"] & x["g"])).alias("fn"),
        )
    )
