"""Queries over dialogue acts: reshaping, filtering, scoring."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from colloquy import constants as K
from colloquy.functions import acts as A
from colloquy.operators import metrics as M
from colloquy.plans import views as V
from colloquy.plans.registry import query

KEY = "intent || '+' || domain || '+' || slot || '+' || value"

_COUNTS = f"""
WITH g AS (SELECT session_id, pos, goal_type, intent, domain, slot, {KEY} AS a FROM v_gold),
p AS (SELECT session_id, pos, goal_type, intent, domain, slot, {KEY} AS a FROM v_pred),
o AS (
 SELECT goal_type, intent, domain, slot, CASE WHEN hit THEN 1 ELSE 0 END AS tp, CASE WHEN hit THEN 0 ELSE 1 END AS fp, 0 AS fn
 FROM (SELECT p.*, EXISTS (SELECT 1 FROM g WHERE g.session_id = p.session_id AND g.pos = p.pos AND g.a = p.a) AS hit FROM p)
 UNION ALL
 SELECT goal_type, intent, domain, slot, 0, 0, 1 FROM g
 WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.session_id = p.session_id AND g.pos = p.pos AND g.a = p.a))
"""


def prf_sql(source, dims="", group="", digits=6, scale=1, out_digits=6):
    """P/R/F1 over (tp, fp, fn) rows; percentages round the rounded ratio as the operator does."""
    def r(x):
        return f"round(round({x}, {digits}) * {scale}, {out_digits})" if scale != 1 else f"round({x}, {out_digits})"
    return f"""
, s AS (SELECT {dims} CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp,
 CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn FROM {source} {group}),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p_,
 CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r_ FROM s)
SELECT * EXCLUDE (p_, r_), {r('p_')} AS precision, {r('r_')} AS recall,
 {r('CASE WHEN p_ + r_ = 0 THEN 0.0 ELSE 2.0 * p_ * r_ / (p_ + r_) END')} AS f1 FROM r"""


_PG = ("v_gold", "v_pred")


@query("micro_prf", _COUNTS + prf_sql("o"), _PG)
def _(spark, sf):
    return M.micro_prf(V.predgold(spark, sf))


@query(
    "prf_breakdown",
    _COUNTS + """, d AS (SELECT 'total' AS dimension, 'all' AS item, tp, fp, fn FROM o
 UNION ALL SELECT 'goal_type', goal_type, tp, fp, fn FROM o
 UNION ALL SELECT 'intent', intent, tp, fp, fn FROM o
 UNION ALL SELECT 'domain', domain, tp, fp, fn FROM o)"""
    + prf_sql("d", "dimension, item,", "GROUP BY dimension, item", 12, 100, 2),
    _PG,
)
def _(spark, sf):
    return M.prf_breakdown(V.predgold(spark, sf))


@query(
    "prf_by_kind",
    _COUNTS + """, d AS (SELECT 'overall' AS kind, tp, fp, fn FROM o UNION ALL
 SELECT CASE WHEN intent IN ('Inform', 'Recommend') AND NOT contains(slot, 's5') THEN 'span' ELSE 'sentence' END, tp, fp, fn FROM o)"""
    + prf_sql("d", "kind,", "GROUP BY kind"),
    _PG,
)
def _(spark, sf):
    return M.prf_by_kind(V.predgold(spark, sf), facility="s5")


_DELEX = """ SELECT session_id, pos, CASE WHEN intent IN ('Inform', 'Recommend') THEN intent || '+' || domain || '+' || slot || '+' ||
 row_number() OVER (PARTITION BY session_id, pos, intent, domain, slot ORDER BY {order})
 ELSE intent || '+' || domain || '+' || slot || '+' || value END AS a FROM {src}"""


@query(
    "delex_prf",
    f"""WITH g AS ({_DELEX.format(src='v_gold', order='act_ord')}), p AS ({_DELEX.format(src='v_pred', order='act_ord')}),
o AS (SELECT CASE WHEN hit THEN 1 ELSE 0 END AS tp, CASE WHEN hit THEN 0 ELSE 1 END AS fp, 0 AS fn
 FROM (SELECT EXISTS (SELECT 1 FROM g WHERE g.session_id = p.session_id AND g.pos = p.pos AND g.a = p.a) AS hit FROM p)
 UNION ALL SELECT 0, 0, 1 FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.session_id = p.session_id AND g.pos = p.pos AND g.a = p.a))"""
    + prf_sql("o"),
    _PG,
)
def _(spark, sf):
    t = V.predgold(spark, sf).select(A.delexicalize("pred").alias("pred"), A.delexicalize("gold").alias("gold"))
    return M.micro_prf(t)


@query("explode_turns", "SELECT session_id, pos, role, content FROM v_turns", ("v_turns",))
def _(spark, sf):
    return V.turns(spark, sf).select("session_id", "pos", "role", "content")


@query("explode_acts", "SELECT session_id, pos, act_ord, intent, domain, slot, value FROM v_acts", ("v_acts",))
def _(spark, sf):
    t = V.act_turns(V.acts(spark, sf))
    return t.select("session_id", "pos", F.posexplode_outer("acts").alias("o", "a")).select(
        "session_id", "pos", F.col("o").cast("bigint").alias("act_ord"), "a.*"
    )


@query(
    "split_acts",
    f"""SELECT session_id, pos,
 coalesce(string_agg(CASE WHEN span THEN a END, ' ' ORDER BY act_ord), '') AS span,
 coalesce(string_agg(CASE WHEN NOT span THEN a END, ' ' ORDER BY act_ord), '') AS sentence
FROM (SELECT *, {KEY} AS a, intent IN ('Inform', 'Recommend') AND NOT contains(slot, '酒店设施') AS span FROM v_named)
GROUP BY session_id, pos""",
    ("v_named",),
)
def _(spark, sf):
    t = V.act_turns(V.named_acts(spark, sf))
    return t.select(
        "session_id", "pos", A.act_texts(A.span_acts("acts")).alias("span"), A.act_texts(A.sentence_acts("acts")).alias("sentence")
    )


@query(
    "delexicalize_acts",
    f"WITH d AS ({_DELEX.format(src='v_acts', order='act_ord').replace('SELECT session_id, pos,', 'SELECT session_id, pos, act_ord,')}) "
    "SELECT session_id, pos, string_agg(a, ' ' ORDER BY act_ord) AS delex FROM d GROUP BY session_id, pos",
    ("v_acts",),
)
def _(spark, sf):
    t = V.act_turns(V.acts(spark, sf))
    return t.select("session_id", "pos", F.array_join(A.delexicalize("acts"), " ").alias("delex"))


@query(
    "act_vocabulary",
    f"""WITH d AS ({_DELEX.format(src='v_acts', order='act_ord').replace('SELECT session_id, pos,', 'SELECT role,')})
SELECT role, a AS act, row_number() OVER (PARTITION BY role ORDER BY a) - 1 AS id FROM (SELECT DISTINCT role, a FROM d)""",
    ("v_acts",),
)
def _(spark, sf):
    from colloquy.operators.vocab import act_vocabulary

    return act_vocabulary(V.act_turns(V.acts(spark, sf)))


@query(
    "first_turn_act_types",
    f"""WITH t AS (SELECT CASE WHEN intent = 'General' THEN {KEY} ELSE intent END AS k FROM v_named WHERE pos = 0),
c AS (SELECT k AS act_type, count(*) AS n FROM t GROUP BY k)
SELECT act_type, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.vocab import distribution

    t = V.act_turns(V.named_acts(spark, sf)).filter("pos = 0")
    kind = F.transform(
        "acts", lambda a: F.when(a["intent"] == "General", A.act_text(a)).otherwise(a["intent"])
    )
    return distribution(t.select(F.explode(kind).alias("act_type")), "act_type")


@query(
    "last_user_act_types",
    f"""WITH l AS (SELECT session_id, max(pos) AS pos FROM v_named WHERE role = 'usr' GROUP BY session_id),
t AS (SELECT v.session_id, string_agg(CASE WHEN intent = 'General' THEN {KEY} ELSE intent END, '' ORDER BY act_ord) AS k
 FROM v_named v JOIN l ON v.session_id = l.session_id AND v.pos = l.pos GROUP BY v.session_id),
c AS (SELECT k AS act_type, count(*) AS n FROM t GROUP BY k)
SELECT act_type, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.vocab import distribution

    t = V.act_turns(V.named_acts(spark, sf)).filter("role = 'usr'")
    last = t.groupBy("session_id").agg(F.max_by("acts", "pos").alias("acts"))
    key = F.array_join(
        F.transform("acts", lambda a: F.when(a["intent"] == "General", A.act_text(a)).otherwise(a["intent"])), ""
    )
    return distribution(last.select(key.alias("act_type")), "act_type")


@query(
    "first_and_last_turns",
    """SELECT session_id, arg_min(content, pos) AS first_content, arg_max(content, pos) FILTER (role = 'usr') AS last_user_content
FROM v_turns GROUP BY session_id""",
    ("v_turns",),
)
def _(spark, sf):
    return V.turns(spark, sf).groupBy("session_id").agg(
        F.min_by("content", "pos").alias("first_content"),
        F.max_by(F.when(F.col("role") == "usr", F.col("content")), F.when(F.col("role") == "usr", F.col("pos"))).alias(
            "last_user_content"
        ),
    )


@query(
    "goal_type_sessions",
    """SELECT DISTINCT session_id, 'g' || (session_id % 5) AS goal_type FROM v_acts WHERE 'g' || (session_id % 5) = 'g2'""",
    ("v_acts",),
)
def _(spark, sf):
    from colloquy.operators.filters import filter_goal_type

    s = V.table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct()
    s = s.withColumn("goal_type", F.concat(F.lit("g"), F.col("session_id") % 5))
    return filter_goal_type(s, "g2")


@query(
    "intent_pos_weight",
    f"""WITH s AS (SELECT session_id, pos, {KEY} AS a FROM v_named WHERE NOT (intent IN ('Inform', 'Recommend') AND NOT contains(slot, '酒店设施'))),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT session_id, pos FROM v_named))
SELECT a AS intent, 1 + count(*) AS c, round(log10(((SELECT n FROM n) - (1 + count(*))) / (1 + count(*))), 6) AS weight FROM s GROUP BY a""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.vocab import intent_pos_weight

    t = V.act_turns(V.named_acts(spark, sf))
    s = t.select(F.transform(A.sentence_acts("acts"), A.act_text).alias("intents"))
    return intent_pos_weight(s, "intents")


@query(
    "sentence_act_vocab",
    f"""WITH s AS (SELECT {KEY} AS a, min(session_id * 100000000 + pos * 100 + act_ord) AS f FROM v_named
 WHERE NOT (intent IN ('Inform', 'Recommend') AND NOT contains(slot, '酒店设施')) GROUP BY a)
SELECT a AS item, row_number() OVER (ORDER BY f) - 1 AS id FROM s""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.vocab import first_seen_vocabulary

    t = V.act_turns(V.named_acts(spark, sf)).select(
        "session_id", "pos", F.transform(A.sentence_acts("acts"), A.act_text).alias("items")
    )
    # the position of an item inside the whole act list, so that order matches the turn
    return first_seen_vocabulary(t, "items", ["session_id", "pos"]).select("item", "id")


@query(
    "domain_counter",
    """SELECT domain, count(*) AS dialogues FROM (SELECT DISTINCT session_id, domain FROM v_named)
WHERE domain IN ('餐馆', '地铁', '出租', '酒店', '景点') GROUP BY domain""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.vocab import domain_counter

    d = V.named_acts(spark, sf).select("session_id", "domain").distinct()
    return domain_counter(d)


@query(
    "turn_domain_id",
    """SELECT session_id, pos, act_ord, CASE domain WHEN '餐馆' THEN 0 WHEN '地铁' THEN 1 WHEN '出租' THEN 2 WHEN '酒店' THEN 3
 WHEN 'bye' THEN 4 WHEN '景点' THEN 5 WHEN 'greet' THEN 6 ELSE 0 END AS domain_id FROM v_named""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.operators.lookups import domain_id

    return V.named_acts(spark, sf).select("session_id", "pos", "act_ord", domain_id("domain").alias("domain_id"))


@query(
    "align_predictions",
    f"""WITH g AS (SELECT session_id, pos, string_agg({KEY}, ' ' ORDER BY act_ord) AS gold FROM v_gold WHERE event_id % 5 <> 0 GROUP BY ALL),
p AS (SELECT session_id, pos, string_agg({KEY}, ' ' ORDER BY act_ord) AS pred FROM v_pred GROUP BY ALL)
SELECT coalesce(g.session_id, p.session_id) AS session_id, coalesce(g.pos, p.pos) AS pos, gold, pred,
 CASE WHEN p.pos IS NULL THEN 'gold_only' WHEN g.pos IS NULL THEN 'pred_only' ELSE 'both' END AS side
FROM g FULL JOIN p ON g.session_id = p.session_id AND g.pos = p.pos""".replace(" WHERE event_id % 5 <> 0", ""),
    _PG,
)
def _(spark, sf):
    t = V.predgold(spark, sf)
    g = t.select("session_id", "pos", A.act_texts("gold").alias("gold"))
    p = t.filter(F.size("pred") > 0).select("session_id", "pos", A.act_texts("pred").alias("pred"))
    return M.align(p, g, ["session_id", "pos"])


@query(
    "sort_acts",
    f"SELECT session_id, pos, string_agg({KEY}, ' ' ORDER BY intent, domain, slot, value) AS acts FROM v_acts GROUP BY session_id, pos",
    ("v_acts",),
)
def _(spark, sf):
    t = V.act_turns(V.acts(spark, sf))
    return t.select("session_id", "pos", A.act_texts(A.sort_acts("acts")).alias("acts"))


@query(
    "most_common_domain",
    """WITH c AS (SELECT session_id, pos, domain, count(*) AS n, min(act_ord) AS f FROM v_acts GROUP BY session_id, pos, domain)
SELECT session_id, pos, arg_max(domain, n * 100 - f) AS domain FROM c GROUP BY session_id, pos""",
    ("v_acts",),
)
def _(spark, sf):
    t = V.act_turns(V.acts(spark, sf))
    return t.select("session_id", "pos", A.most_common(F.transform("acts", lambda a: a["domain"])).alias("domain"))


@query(
    "distinct_acts",
    "SELECT DISTINCT intent, domain, slot FROM v_acts",
    ("v_acts",),
)
def _(spark, sf):
    return V.acts(spark, sf).select("intent", "domain", "slot").distinct()


@query(
    "ontology_slots",
    """WITH k AS (SELECT DISTINCT domain || '-' || CASE slot WHEN '名称' THEN 'Book Day' WHEN '评分' THEN 'Price Range' ELSE slot END AS key FROM v_named
 WHERE intent = 'Inform')
SELECT key, CASE WHEN contains(key, 'book') THEN lower(key) ELSE lower(replace(key, ' ', '')) END AS slot FROM k
WHERE string_split(key, '-')[1] IN ('餐馆', '地铁', '出租', '酒店', '景点')""",
    ("v_named",),
)
def _(spark, sf):
    from colloquy.sources.readers import ontology_slots

    a = V.named_acts(spark, sf).filter("intent = 'Inform'")
    slot = F.when(F.col("slot") == "名称", "Book Day").when(F.col("slot") == "评分", "Price Range").otherwise(F.col("slot"))
    return ontology_slots(a.select(F.concat_ws("-", "domain", slot).alias("key")).distinct())


@query(
    "multi_hot_f1",
    f"""WITH g AS (SELECT DISTINCT session_id, pos, {KEY} AS a FROM v_gold), p AS (SELECT DISTINCT session_id, pos, {KEY} AS a FROM v_pred),
voc AS (SELECT DISTINCT a FROM (SELECT intent || '+' || domain || '+' || slot AS a FROM v_gold)),
g2 AS (SELECT DISTINCT session_id, pos, intent || '+' || domain || '+' || slot AS a FROM v_gold),
p2 AS (SELECT DISTINCT session_id, pos, intent || '+' || domain || '+' || slot AS a FROM v_pred),
o AS (SELECT CASE WHEN g2.a IS NOT NULL AND p2.a IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN g2.a IS NULL THEN 1 ELSE 0 END AS fp,
 CASE WHEN p2.a IS NULL THEN 1 ELSE 0 END AS fn FROM g2 FULL JOIN p2 ON g2.session_id = p2.session_id AND g2.pos = p2.pos AND g2.a = p2.a)"""
    + prf_sql("o"),
    _PG,
)
def _(spark, sf):
    from colloquy.functions.encode import multi_hot

    labels = [f"{i}+d{d}+s{s}" for i in ("Inform", "NoOffer", "Recommend", "Request", "Select") for d in range(5) for s in range(7)]
    key = lambda c: F.transform(c, lambda a: F.concat_ws("+", a["intent"], a["domain"], a["slot"]))
    t = V.predgold(spark, sf).select(multi_hot(key("pred"), labels).alias("p"), multi_hot(key("gold"), labels).alias("g"))
    return M.position_counts(t, "p", "g")
