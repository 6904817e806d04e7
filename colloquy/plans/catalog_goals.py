"""Queries over goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import acts as A
from colloquy.operators import goals as G, metrics as M, state as S
from colloquy.operators.staging import stage
from colloquy.plans import views as V
from colloquy.plans.registry import query

_T, _G = ("v_tuples",), ("v_gstate",)


def gstate(spark, sf):
    """Goal tuples with expressed flags and some requests answered."""
    g = V.goals(spark, sf).withColumn("tuples", G.goal_tuples("subs"))
    state = F.transform(
        "tuples",
        lambda t, i: t.withField("expressed", (F.col("goal_id") + i) % 5 != 0).withField(
            "value", F.when((F.size(t["value"]) == 0) & ((F.col("goal_id") + i) % 7 != 0), F.array(F.lit("x"))).otherwise(t["value"])
        ),
    )
    return g.withColumn("state", state)


@query(
    "goal_tuples",
    """SELECT goal_id, string_agg(id || ':' || domain || ':' || slot || ':' || array_to_string(value, '|') || ':' || is_list, ' ' ORDER BY id, o) AS tuples FROM v_tuples GROUP BY goal_id""",
    _T,
)
def _(spark, sf):
    t = G.goal_tuples("subs")
    text = F.transform(t, lambda x: F.concat_ws(":", x["id"].cast("string"), x["domain"], x["slot"], F.array_join(x["value"], "|"), x["is_list"].cast("string")))
    return V.goals(spark, sf).select("goal_id", F.array_join(text, " ").alias("tuples"))


@query(
    "goal_type",
    """SELECT goal_id, CASE WHEN max(id) = 1 THEN '单领域' ELSE CASE WHEN bool_or(domain NOT IN ('出租', '地铁') AND NOT is_list AND contains(array_to_string(value, ' '), '出现在id')) THEN '不独立多领域' ELSE '独立多领域' END
 || CASE WHEN bool_or(domain IN ('出租', '地铁')) THEN '+交通' ELSE '' END END AS goal_type FROM v_tuples GROUP BY goal_id""",
    _T,
)
def _(spark, sf):
    return V.goals(spark, sf).select("goal_id", G.infer_goal_type(G.goal_tuples("subs")).alias("goal_type"))


_OPEN = """WITH op AS (SELECT *, NOT expressed OR len(filled) = 0 OR (NOT is_list AND contains(array_to_string(filled, ' '), 'id')) OR (is_list AND list_contains(filled, 'id')) AS open FROM v_gstate)
"""


@query("goal_completed", _OPEN + "SELECT goal_id, NOT bool_or(open) AS completed, CASE WHEN bool_or(open) THEN -1.0::DOUBLE ELSE 80.0::DOUBLE END AS reward FROM op GROUP BY goal_id", _G)
def _(spark, sf):
    return gstate(spark, sf).select("goal_id", G.goal_completed("state").alias("completed"), G.reward("state").alias("reward"))


@query("current_subgoal", _OPEN + "SELECT goal_id, min(CASE WHEN open THEN id END) AS sub_goal FROM op GROUP BY goal_id", _G)
def _(spark, sf):
    return gstate(spark, sf).select("goal_id", G.current_subgoal("state").cast("bigint").alias("sub_goal"))


_ACTS = """WITH a AS (SELECT goal_id, 'General+greet+none+none' AS a FROM (SELECT DISTINCT goal_id FROM v_gstate)
 UNION ALL SELECT goal_id, CASE WHEN len(filled) = 0 THEN 'Request+' || domain || '+' || slot || '+' ELSE 'Inform+' || domain || '+' || slot || '+' || v END
 FROM (SELECT *, unnest(CASE WHEN len(filled) = 0 THEN [''] ELSE filled END) AS v FROM v_gstate WHERE expressed))
"""


@query("state_acts", _ACTS + "SELECT goal_id, string_agg(a, ' ' ORDER BY a) AS acts FROM a GROUP BY goal_id", _G)
def _(spark, sf):
    return gstate(spark, sf).select(
        "goal_id", F.array_join(F.array_sort(F.transform(G.state_acts("state"), A.act_text)), " ").alias("acts")
    )


@query(
    "state_acts_prf",
    _ACTS + """, g AS (SELECT goal_id, a FROM a WHERE (goal_id + length(a)) % 6 <> 0),
o AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.goal_id = a.goal_id AND g.a = a.a) THEN 1 ELSE 0 END AS tp FROM a),
n AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(1 - tp) AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM o)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1 FROM n""",
    _G,
)
def _(spark, sf):
    t = gstate(spark, sf).withColumn("pred", F.transform(G.state_acts("state"), A.act_text))
    gold = F.filter("pred", lambda a: (F.col("goal_id") + F.length(a)) % 6 != 0)
    return M.micro_prf(t.select("pred", gold.alias("gold")))


@query(
    "expressed_distribution",
    """WITH k AS (SELECT goal_id, coalesce(string_agg(CASE WHEN expressed THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') AS expressed FROM v_gstate GROUP BY goal_id),
c AS (SELECT expressed, count(*) AS n FROM k GROUP BY expressed) SELECT expressed, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""",
    _G,
)
def _(spark, sf):
    from colloquy.operators.vocab import distribution

    at = F.filter(F.transform("state", lambda t, i: F.when(t["expressed"], i.cast("string"))), lambda x: x.isNotNull())
    return distribution(gstate(spark, sf).select(F.array_join(at, ",").alias("expressed")), "expressed")


@query(
    "resolve_references",
    r"""WITH r AS (SELECT goal_id, id, i, domain, slot, CAST(regexp_extract(filled[1], 'id=(\d+)', 1) AS BIGINT) AS ref FROM v_gstate WHERE NOT expressed AND NOT is_list AND contains(array_to_string(filled, ' '), 'id')),
n AS (SELECT goal_id, id, arg_min(domain, i) AS domain, arg_min(filled[1], i) AS name FROM v_gstate WHERE slot = '名称' GROUP BY ALL),
x AS (SELECT r.goal_id, r.i, CASE WHEN r.slot = '名称' THEN 'Select+' || r.domain || '+源领域+' || n.domain || ' Inform+' || n.domain || '+名称+' || n.name
 ELSE 'Inform+' || r.domain || '+' || r.slot || '+' || n.name END AS a FROM r JOIN n ON n.goal_id = r.goal_id AND n.id = r.ref)
SELECT goal_id, string_agg(a, ' ' ORDER BY i) AS acts FROM x GROUP BY goal_id""",
    _G,
)
def _(spark, sf):
    r = G.resolve_references(gstate(spark, sf), "state")
    return r.filter(F.size("acts") > 0).select("goal_id", A.act_texts("acts").alias("acts"))


_METHOD = """WITH m AS (SELECT goal_id, count(*) AS n_subs, CASE WHEN count(*) = 1 THEN 'single' WHEN bool_or(ref IS NOT NULL) THEN 'cross' ELSE 'multi' END AS method FROM v_subgoals GROUP BY goal_id)
"""


@query("method_split", _METHOD + "SELECT goal_id, method FROM m", ("v_subgoals",))
def _(spark, sf):
    return V.goals(spark, sf).select("goal_id", G.method_split("subs").alias("method"))


@query(
    "goal_totals",
    _METHOD + """SELECT method, n_subs, count(*) AS goals, round((SELECT count(*) FROM m x WHERE x.method = m.method) / (SELECT count(*) FROM m), 6) AS prior,
 round((SELECT avg(n_subs) FROM m x WHERE x.method = m.method), 6) AS mean_subs FROM m GROUP BY method, n_subs""",
    ("v_subgoals",),
)
def _(spark, sf):
    return G.goal_totals(stage(V.goals(spark, sf)))


@query(
    "goal_domains",
    """WITH s AS (SELECT goal_id, id, domain, count(*) FILTER (kind = 'c') AS c, count(*) FILTER (kind = 'r') AS r FROM v_tuples GROUP BY ALL),
g AS (SELECT goal_id, domain, count(*) AS n, sum(c) AS c, sum(r) AS r FROM s GROUP BY ALL), t AS (SELECT count(DISTINCT goal_id) AS t FROM s)
SELECT domain, round(sum(n) / any_value(t), 6) AS subs_per_goal, round(sum(c) / sum(n), 6) AS constraints, round(sum(r) / sum(n), 6) AS requests,
 round(count(*) / any_value(t), 6) AS goals_with, round(count(*) FILTER (n > 1) / any_value(t), 6) AS goals_with_several FROM g, t GROUP BY domain""",
    _T,
)
def _(spark, sf):
    return G.goal_domains(stage(V.goals(spark, sf)))


@query(
    "cross_ratio",
    "SELECT round(count(*) FILTER (ref IS NULL AND domain NOT IN ('出租', '地铁')) / count(*), 6) AS alone, round(1 - count(*) FILTER (ref IS NULL AND domain NOT IN ('出租', '地铁')) / count(*), 6) AS hop FROM v_subgoals",
    ("v_subgoals",),
)
def _(spark, sf):
    return G.cross_ratio(V.goals(spark, sf))


_REORDER = """WITH n AS (SELECT goal_id, max(id) AS n FROM v_subgoals GROUP BY goal_id),
s AS (SELECT v.goal_id, n.n + 1 - id AS id, domain, n.n + 1 - ref AS ref, CASE WHEN domain IN ('出租', '地铁') THEN n.n END AS f, CASE WHEN domain IN ('出租', '地铁') THEN n.n - 1 END AS t
 FROM v_subgoals v JOIN n ON n.goal_id = v.goal_id),
k AS (SELECT goal_id, id, domain, ref, f, t, coalesce(ref, id) * 1000 + CASE WHEN ref IS NOT NULL THEN id ELSE 0 END AS w FROM s),
k2 AS (SELECT k.*, CASE WHEN k.f IS NOT NULL THEN greatest(a.w, b.w) ELSE k.w END AS w2 FROM k LEFT JOIN k a ON a.goal_id = k.goal_id AND a.id = k.f LEFT JOIN k b ON b.goal_id = k.goal_id AND b.id = k.t),
o AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY w2, CASE WHEN f IS NULL THEN 0 ELSE 1 END, id) AS new_id FROM k2)
SELECT o.goal_id, o.new_id, o.id AS old_id, o.domain, r.new_id AS ref, least(a.new_id, b.new_id) AS from_id, greatest(a.new_id, b.new_id) AS to_id
FROM o LEFT JOIN o r ON r.goal_id = o.goal_id AND r.id = o.ref LEFT JOIN o a ON a.goal_id = o.goal_id AND a.id = o.f LEFT JOIN o b ON b.goal_id = o.goal_id AND b.id = o.t"""


@query("reorder_subgoals", _REORDER, ("v_subgoals",))
def _(spark, sf):
    """Goals whose numbering is reversed, so hops and trips come before what they refer to."""
    n = F.size("subs")
    flip = F.transform(
        "subs",
        lambda s: F.struct(
            (n + 1 - s["id"]).alias("id"), s["domain"].alias("domain"), s["method"].alias("method"), (n + 1 - s["ref"]).alias("ref"),
            F.transform(
                s["constraints"],
                lambda c: c.withField(
                    "value",
                    F.when(c["slot"] == K.ORIGIN_SLOT, F.array(F.concat(F.lit("id="), n.cast("string"))))
                    .when(c["slot"] == K.DESTINATION_SLOT, F.array(F.concat(F.lit("id="), (n - 1).cast("string"))))
                    .otherwise(c["value"]),
                ),
            ).alias("constraints"),
            s["requests"].alias("requests"),
        ),
    )
    ordered = stage(V.goals(spark, sf).select("goal_id", G.reorder_subgoals(flip).alias("ordered")))
    r = ordered.select("goal_id", F.inline("ordered"))
    return r.select("goal_id", F.col("id").cast("bigint").alias("new_id"), *[F.col(c).cast("bigint").alias(c) for c in ("old_id", "ref", "from_id", "to_id")], "domain")


@query(
    "render_goal",
    r"""WITH s AS (SELECT goal_id, id, any_value(domain) AS d, max(CASE WHEN slot = '名称' THEN value[1] END) AS nm, max(CASE WHEN slot = '评分' THEN value[1] END) AS rt,
 max(CASE WHEN slot = '推荐菜' AND kind = 'c' THEN array_to_string(value, '、') END) AS di, string_agg(CASE WHEN kind = 'r' THEN slot END, '、' ORDER BY o) AS rq FROM v_tuples GROUP BY goal_id, id),
p AS (SELECT *, CASE d WHEN '酒店' THEN '住宿' WHEN '景点' THEN '游玩' ELSE '用餐' END AS verb FROM s)
SELECT goal_id, string_agg(CASE WHEN d = '出租' THEN '你想呼叫从id=1到id=2的出租车。' WHEN d = '地铁' THEN '你想乘坐从id=1到id=2的地铁。' ELSE
 CASE WHEN contains(nm, '周边') THEN '你要去id=' || regexp_extract(nm, 'id=(\d+)', 1) || '附近的' || d || '(id=' || id || ')' || verb || '。'
  WHEN nm IS NOT NULL THEN '你要去名叫' || nm || '的' || d || '(id=' || id || ')' || verb || '。' ELSE '你要去一个' || d || '(id=' || id || ')' || verb || '。' END
 || coalesce('你希望' || d || '的评分是' || rt || '。', '') || coalesce('你想吃的菜肴是' || di || '。', '') END || '你想知道这个' || d || '的' || rq || '。', '' ORDER BY id) AS text FROM p GROUP BY goal_id""",
    _T,
)
def _(spark, sf):
    return V.goals(spark, sf).select("goal_id", G.render_goal("subs").alias("text"))


@query(
    "task_success_blocks",
    _OPEN + """, c AS (SELECT goal_id, NOT bool_or(open AND id = 1) AS done, CASE WHEN max(id) = 1 THEN 'one' WHEN bool_or(domain IN ('出租', '地铁')) THEN 'trip' ELSE 'many' END AS kind FROM op GROUP BY goal_id),
b AS (SELECT goal_id, done, kind FROM c UNION ALL SELECT goal_id, done, 'all' FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY goal_id) - 1) // 100 AS block FROM b),
m AS (SELECT kind, block, count(*) AS n, avg(CASE WHEN done THEN 1.0 ELSE 0.0 END) AS rate FROM r GROUP BY ALL)
SELECT kind, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS sessions, round(avg(rate), 6) AS mean_rate FROM m GROUP BY kind""",
    _G,
)
def _(spark, sf):
    g = gstate(spark, sf)
    first = F.filter("state", lambda t: t["id"] == 1)
    kind = F.when(F.size("subs") == 1, "one").when(F.exists("subs", lambda s: s["domain"].isin(*K.TRANSPORT)), "trip").otherwise("many")
    return G.success_blocks(g.select("goal_id", G.goal_completed(first).alias("done"), kind.alias("goal_type")), "goal_id", "done", "goal_type")


@query(
    "state_diff",
    """WITH st AS (SELECT g.goal_id AS session_id, p.pos, i, id, slot, (goal_id + i + p.pos // 2) % 5 <> 0 AS expressed, array_to_string(filled, '|') AS v
 FROM v_gstate g, (SELECT unnest([0, 2, 4]) AS pos) p),
c AS (SELECT a.session_id, a.pos, string_agg(CASE WHEN b.pos IS NOT NULL AND a.expressed <> b.expressed THEN a.slot || ':' || a.expressed END, ' ' ORDER BY a.i) AS changed,
 arg_max(CASE WHEN a.expressed THEN a.id END, a.i) AS last_id FROM st a LEFT JOIN st b ON b.session_id = a.session_id AND b.pos = a.pos - 2 AND b.i = a.i GROUP BY ALL)
SELECT session_id, pos, coalesce(changed, '') AS changed, coalesce(last_id, 1) AS last_id FROM c""",
    _G,
)
def _(spark, sf):
    g = gstate(spark, sf).select(F.col("goal_id").alias("session_id"), "state", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 2, 4)])).alias("pos"))
    st = F.transform("state", lambda t, i: t.withField("expressed", (F.col("session_id") + i + F.expr("pos div 2")) % 5 != 0))
    d = S.state_diff(g.withColumn("state", st))
    text = F.transform("changed", lambda t: F.concat_ws(":", t["slot"], t["expressed"].cast("string")))
    return d.select("session_id", "pos", F.array_join(text, " ").alias("changed"), F.col("last_id").cast("bigint").alias("last_id"))
