"""Queries over sessions: context, belief tracking, state metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import encode as E, features as Fe
from colloquy.operators import entities as N, metrics as M, state as S, vocab as Vo
from colloquy.operators.filters import filter_role
from colloquy.operators.ordered import with_preceding
from colloquy.operators.staging import stage
from colloquy.plans import views as V
from colloquy.plans.catalog_entities import _E, _MATCH, constraints, searchable
from colloquy.plans.registry import query

SLOTS_SQL = "[" + ", ".join(f"'{s}'" for s in S.TRACKED_SLOTS) + "]"
OVERWRITE_SQL = "(" + ", ".join(f"'{s}'" for s in K.OVERWRITE_SLOTS) + ")"

# belief tracking stated in SQL; {base} lets the caller choose user turns and the acts before them
TRACK = f"""
WITH usr AS (SELECT * FROM v_named WHERE role = 'usr'),
sysp AS (SELECT session_id, pos + 1 AS pos, act_ord, intent, domain, slot FROM v_named WHERE role = 'sys'
 AND EXISTS (SELECT 1 FROM usr u WHERE u.session_id = v_named.session_id AND u.pos = v_named.pos + 1)),
cand AS (
 SELECT session_id, pos, CASE intent WHEN 'Select' THEN 1 WHEN 'Request' THEN 2 ELSE 3 END AS pr, domain, act_ord FROM usr
  WHERE intent IN ('Select', 'Request', 'Inform')
 UNION ALL SELECT session_id, pos, 4, domain, act_ord FROM sysp WHERE intent IN ('Inform', 'Recommend')),
cnt AS (SELECT session_id, pos, pr, domain, count(*) AS n, min(act_ord) AS f FROM cand GROUP BY ALL),
cur AS (SELECT session_id, pos, arg_min(domain, pr * 1000000 - n * 1000 + f) AS cur_domain FROM cnt GROUP BY session_id, pos),
noof AS (SELECT session_id, pos FROM sysp GROUP BY session_id, pos
 HAVING bool_or(intent = 'NoOffer') AND NOT bool_or(intent = 'Inform')),
clr AS (SELECT c.session_id, c.pos, cur_domain AS domain, c.pos * 100000 AS tt FROM cur c JOIN noof n ON c.session_id = n.session_id AND c.pos = n.pos),
nev AS (
 SELECT session_id, domain, tt, '' AS v, NULL AS target FROM clr
 UNION ALL SELECT session_id, domain, pos * 100000 + 10000 + act_ord * 10 + 1, '', NULL FROM usr WHERE intent = 'Select' AND domain = value
 UNION ALL SELECT session_id, domain, pos * 100000 + 20000 + act_ord * 10, value, NULL FROM usr WHERE intent = 'Inform' AND slot = '名称'
 UNION ALL SELECT session_id, value, pos * 100000 + 10000 + act_ord * 10, NULL, domain FROM usr WHERE intent = 'Select'),
prb AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id, domain ORDER BY tt ROWS UNBOUNDED PRECEDING) AS name FROM nev),
sel AS (SELECT session_id, domain AS source, target AS domain, tt, name FROM prb WHERE target IS NOT NULL AND name <> ''),
wipe AS (SELECT session_id, domain, tt FROM clr UNION ALL SELECT session_id, domain, tt + 1 FROM sel WHERE source = domain),
ev AS (
 SELECT session_id, domain, unnest({SLOTS_SQL}) AS slot, tt, 'clear' AS op, '' AS value FROM wipe
 UNION ALL SELECT session_id, domain, '周边' || source, tt + 2, 'set', name FROM sel
 UNION ALL SELECT session_id, domain, slot, pos * 100000 + 20000 + act_ord * 10, 'set', value FROM usr WHERE intent = 'Inform' AND slot IN {OVERWRITE_SQL}
 UNION ALL SELECT session_id, domain, slot, pos * 100000 + 20000 + act_ord * 10, 'append', value FROM usr WHERE intent = 'Inform' AND slot = '推荐菜'
 UNION ALL SELECT session_id, domain, '酒店设施', pos * 100000 + 20000 + act_ord * 10, 'append', string_split(slot, '-')[2] FROM usr
  WHERE intent = 'Inform' AND contains(slot, '酒店设施') AND value = '是'),
ep AS (SELECT *, sum(CASE WHEN op <> 'append' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, domain, slot ORDER BY tt ROWS UNBOUNDED PRECEDING) AS e FROM ev),
val AS (SELECT session_id, domain, slot, tt, tt // 100000 AS pos,
 coalesce(string_agg(CASE WHEN value <> '' THEN value END, ' ' ORDER BY tt) OVER (PARTITION BY session_id, domain, slot, e ORDER BY tt ROWS UNBOUNDED PRECEDING), '') AS value FROM ep),
chg AS (SELECT session_id, pos, domain, slot, arg_max(value, tt) AS value FROM val GROUP BY ALL)
"""

GRID = """, slots AS (SELECT d.domain, unnest(d.slots) AS slot FROM (SELECT unnest([""" + ", ".join(
    "{'domain': '%s', 'slots': [%s]}" % (d, ", ".join(f"'{s}'" for s in ss)) for d, ss in K.BELIEF_SLOTS.items()
) + """]) AS d)),
ut AS (SELECT DISTINCT session_id, pos FROM usr),
grid AS (SELECT ut.session_id, ut.pos, s.domain, s.slot, coalesce(last_value(chg.value IGNORE NULLS) OVER
 (PARTITION BY ut.session_id, s.domain, s.slot ORDER BY ut.pos ROWS UNBOUNDED PRECEDING), '') AS value
 FROM ut CROSS JOIN slots s LEFT JOIN chg ON chg.session_id = ut.session_id AND chg.pos = ut.pos AND chg.domain = s.domain AND chg.slot = s.slot)
"""


def named_turns(spark, sf):
    return stage(V.act_turns(V.named_acts(spark, sf)))


@query(
    "user_turn_context",
    """SELECT session_id, pos, content, coalesce(array_to_string(context, ' | '), '') AS context FROM (
 SELECT *, list(content) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM v_turns)
WHERE role = 'usr'""",
    ("v_turns",),
)
def _(spark, sf):
    t = filter_role(S.context_last_k(V.turns(spark, sf), 3), "usr")
    return t.select("session_id", "pos", "content", F.array_join("context", " | ").alias("context"))


@query(
    "pair_turns",
    """SELECT session_id, pos, role, lag(content, 1) OVER w AS prev_other, lag(content, 2) OVER w AS prev_own
FROM v_exchanges WINDOW w AS (PARTITION BY session_id ORDER BY pos)""",
    ("v_exchanges",),
)
def _(spark, sf):
    return S.pair_turns(V.exchanges(spark, sf)).select("session_id", "pos", "role", "prev_other", "prev_own")


@query(
    "dialog_history",
    """WITH y AS (SELECT *, lag(content) OVER w AS before, lag(role) OVER w AS who FROM v_exchanges WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
x AS (SELECT session_id, pos AS i, content AS usr, CASE WHEN who = 'sys' THEN before ELSE '' END AS sys FROM y WHERE role = 'usr')
SELECT session_id, i, trim(string_agg(sys || ' ; ' || usr || ' ; ', '' ORDER BY i) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS history,
 trim(sys || ' ; ' || usr) AS turn_text FROM x""",
    ("v_exchanges",),
)
def _(spark, sf):
    before = lambda w: F.lag(F.when(F.col("role") == "sys", F.col("content"))).over(w)
    t = with_preceding(V.exchanges(spark, sf), ["session_id"], "pos", 1, lambda w: {"sys": F.coalesce(before(w), F.lit(""))})
    pairs = filter_role(t, "usr").select("session_id", F.col("pos").alias("i"), "sys", F.col("content").alias("usr"))
    return S.dialog_history(pairs).select("session_id", "i", "history", "turn_text")


@query("current_domain", TRACK + "SELECT session_id, pos, cur_domain FROM ut LEFT JOIN cur USING (session_id, pos)".replace(
    "FROM ut", "FROM (SELECT DISTINCT session_id, pos FROM usr) ut"), ("v_named",))
def _(spark, sf):
    return S.tracker_turns(named_turns(spark, sf)).select("session_id", "pos", "cur_domain")


@query("track_state", TRACK + "SELECT session_id, pos, domain, slot, value FROM chg", ("v_named",))
def _(spark, sf):
    return S.state_changes(named_turns(spark, sf))


@query(
    "final_state",
    TRACK + """SELECT * FROM (SELECT session_id, domain, slot, arg_max(value, pos) AS value FROM chg GROUP BY ALL) WHERE value <> ''""",
    ("v_named",),
)
def _(spark, sf):
    return S.final_state(named_turns(spark, sf))


@query(
    "pending_requests",
    TRACK + """, ans AS (SELECT session_id, domain, slot, max(pos) AS closed FROM sysp WHERE intent IN ('Inform', 'Recommend') GROUP BY ALL)
SELECT u.session_id, u.domain, u.slot, count(*) AS n FROM usr u LEFT JOIN ans a
 ON a.session_id = u.session_id AND a.domain = u.domain AND a.slot = u.slot
WHERE intent = 'Request' AND (closed IS NULL OR u.pos >= closed) GROUP BY ALL""",
    ("v_named",),
)
def _(spark, sf):
    return S.pending_requests(named_turns(spark, sf))


N_SLOTS = sum(map(len, K.BELIEF_SLOTS.values()))

_PERTURB = "CASE WHEN (session_id + pos + length(slot)) % 7 = 0 AND value <> '' THEN value || 'x' ELSE value END"


def compared(spark, sf, keep=None):
    """User turns, changes of the tracked belief, and those of a copy that is wrong at every seventh position of a slot.

    Where ``keep`` (of session and value) is false the copy has nothing.
    """
    t = named_turns(spark, sf)
    gold = stage(S.state_changes(t).filter(S.in_slots()))
    spans = S.slot_spans(gold, t)
    if keep is not None:
        spans = spans.filter(keep)
    spans = stage(spans)
    # the first wrong position at or after the start of the span, and every seventh after it
    first = F.col("pos") + F.pmod(-(F.col("session_id") + F.col("pos") + F.length("slot")), F.lit(7))
    key = ["session_id", "domain", "slot"]
    wrong = spans.filter(first < F.col("end")).select(*key, F.explode(F.sequence(first, F.col("end") - 1, F.lit(7).cast("bigint"))).alias("pos"), "end", "value")
    off = wrong.select(*key, "pos", F.concat("value", F.lit("x")).alias("value"))
    back = wrong.filter("pos + 1 < end").select(*key, F.expr("pos + 1").alias("pos"), "value")
    right = spans.filter(first != F.col("pos")).select(*key, "pos", "value")
    noisy = off.unionByName(back).unionByName(right)
    # what ends without a successor is unset in the copy too
    ends = spans.select(*key, F.col("end").alias("pos")).join(spans.select(*key, "pos"), [*key, "pos"], "left_anti").withColumn("value", F.lit(""))
    return t, gold, noisy.unionByName(ends.select(*key, "pos", "value"))


@query(
    "state_accuracy",
    TRACK + GRID + f""", s AS (SELECT session_id, pos, value AS gold, {_PERTURB} AS pred FROM grid),
t AS (SELECT 'g' || (session_id % 5) AS goal_type, session_id, pos, CASE WHEN bool_and(gold = pred) THEN 1 ELSE 0 END AS ok,
 sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS same, count(*) AS n FROM s GROUP BY ALL)
SELECT goal_type, count(*) AS turns, round(avg(ok), 6) AS joint_acc, round(CAST(sum(same) AS DOUBLE) / sum(n), 6) AS slot_acc FROM t GROUP BY goal_type""",
    ("v_named",),
)
def _(spark, sf):
    t, gold, noisy = compared(spark, sf)
    counts = S.turn_counts(gold, noisy, t).withColumn("goal_type", F.concat(F.lit("g"), F.col("session_id") % 5))
    return M.count_accuracy(counts, N_SLOTS, by=["goal_type"])


_STRINGS = TRACK + GRID + f""", b AS (SELECT session_id, pos,
 coalesce(list(domain || '.' || slot || '-' || value) FILTER (value <> ''), []) AS gold,
 coalesce(list(domain || '.' || slot || '-' || {_PERTURB}) FILTER (value <> '' AND (session_id + length(value)) % 5 <> 0), []) AS pred
 FROM grid GROUP BY session_id, pos),
"""


@query(
    "belief_scores",
    _STRINGS + r"""x AS (SELECT *, list_filter(gold, lambda v: NOT list_contains(pred, v)) AS miss,
 list_filter(pred, lambda v: NOT list_contains(gold, v)) AS extra FROM b),
y AS (SELECT *, list_transform(miss, lambda v: regexp_replace(v, '-[^-]*$', '')) AS ms FROM x),
z AS (SELECT *, len(list_filter(extra, lambda v: NOT list_contains(ms, regexp_replace(v, '-[^-]*$', '')))) AS wrong,
 len(gold) - len(miss) AS hit FROM y)
SELECT count(*) AS turns, round(avg(CASE WHEN len(miss) = 0 AND len(extra) = 0 THEN 1.0 ELSE 0.0 END), 6) AS joint_acc,
 round(avg((26 - len(miss) - wrong) / 26.0), 6) AS turn_acc,
 round(avg(CASE WHEN len(gold) = 0 AND len(pred) = 0 THEN 1.0 WHEN len(gold) = 0 OR hit = 0 THEN 0.0
  ELSE 2.0 * hit / (len(gold) + len(pred)) END), 6) AS belief_f1 FROM z""",
    ("v_named",),
)
def _(spark, sf):
    t, gold, noisy = compared(spark, sf, "(session_id + length(value)) % 5 <> 0")
    return M.count_scores(S.turn_counts(gold, noisy, t), N_SLOTS)


@query(
    "belief_differences",
    _STRINGS + """x AS (SELECT session_id, pos, list_sort(list_filter(gold, lambda v: NOT list_contains(pred, v))) AS miss,
 list_sort(list_filter(pred, lambda v: NOT list_contains(gold, v))) AS extra FROM b)
SELECT session_id, pos, array_to_string(miss, ' ') AS missing, array_to_string(extra, ' ') AS extra, len(miss) + len(extra) = 0 AS equal FROM x""",
    ("v_named",),
)
def _(spark, sf):
    t, gold, noisy = compared(spark, sf, "(session_id + length(value)) % 5 <> 0")
    spans = S.compared_spans(gold, noisy).filter("gold <> pred").join(S.span_ends(t), "session_id").withColumn("end", F.coalesce("next", "end"))
    name = lambda v: F.when(F.col(v) != "", F.concat("domain", F.lit("."), "slot", F.lit("-"), v))
    cells = S.at_turns(spans, t).groupBy("session_id", "pos").agg(F.array_sort(F.collect_list(name("gold"))).alias("miss"), F.array_sort(F.collect_list(name("pred"))).alias("extra"))
    text = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    all_turns = t.filter("role = 'usr'").select("session_id", "pos").join(cells, ["session_id", "pos"], "left")
    return all_turns.select("session_id", "pos", text("miss").alias("missing"), text("extra").alias("extra"), F.col("miss").isNull().alias("equal"))


@query(
    "teacher_forced_state",
    # each system turn on its own: annotated state of i-2, then the acts of i-1
    TRACK.replace("WITH usr", "WITH usr0") .split("chg AS")[0].replace("usr0 AS", "usr AS", 1) + f"""chg AS (SELECT session_id, pos, domain, slot, arg_max(value, tt) AS value FROM val GROUP BY ALL)
""" + GRID + """, st AS (SELECT session_id, pos + 1 AS pos, domain, slot, value FROM grid WHERE value <> ''),
si AS (SELECT DISTINCT session_id, pos AS i FROM v_named WHERE role = 'sys'),
b0 AS (SELECT st.session_id, i, domain, slot, value FROM st JOIN si ON si.session_id = st.session_id AND si.i = st.pos + 2),
u1 AS (SELECT u.*, u.pos + 1 AS i FROM usr u JOIN si ON si.session_id = u.session_id AND si.i = u.pos + 1),
n1 AS (
 SELECT session_id, i, domain, 0 AS tt, value AS v, NULL AS target FROM b0 WHERE slot = '名称'
 UNION ALL SELECT session_id, i, domain, 10000 + act_ord * 10 + 1, '', NULL FROM u1 WHERE intent = 'Select' AND domain = value
 UNION ALL SELECT session_id, i, domain, 20000 + act_ord * 10, value, NULL FROM u1 WHERE intent = 'Inform' AND slot = '名称'
 UNION ALL SELECT session_id, i, value, 10000 + act_ord * 10, NULL, domain FROM u1 WHERE intent = 'Select'),
n2 AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id, i, domain ORDER BY tt ROWS UNBOUNDED PRECEDING) AS name FROM n1),
s1 AS (SELECT session_id, i, domain AS source, target AS domain, tt, name FROM n2 WHERE target IS NOT NULL AND name <> ''),
e1 AS (
 SELECT session_id, i, domain, slot, 0 AS tt, 'set' AS op, value FROM b0
 UNION ALL SELECT session_id, i, domain, unnest(""" + SLOTS_SQL + """), tt + 1, 'clear', '' FROM s1 WHERE source = domain
 UNION ALL SELECT session_id, i, domain, '周边' || source, tt + 2, 'set', name FROM s1
 UNION ALL SELECT session_id, i, domain, slot, 20000 + act_ord * 10, 'set', value FROM u1 WHERE intent = 'Inform' AND slot IN """ + OVERWRITE_SQL + """
 UNION ALL SELECT session_id, i, domain, slot, 20000 + act_ord * 10, 'append', value FROM u1 WHERE intent = 'Inform' AND slot = '推荐菜'
 UNION ALL SELECT session_id, i, domain, '酒店设施', 20000 + act_ord * 10, 'append', string_split(slot, '-')[2] FROM u1
  WHERE intent = 'Inform' AND contains(slot, '酒店设施') AND value = '是'),
r1 AS (SELECT *, sum(CASE WHEN op <> 'append' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, i, domain, slot ORDER BY tt ROWS UNBOUNDED PRECEDING) AS e FROM e1),
m1 AS (SELECT session_id, i, domain, slot, max(e) AS e FROM r1 GROUP BY ALL)
SELECT * FROM (SELECT r1.session_id, r1.i AS pos, r1.domain, r1.slot, coalesce(string_agg(CASE WHEN value <> '' THEN value END, ' ' ORDER BY tt), '') AS value
 FROM r1 JOIN m1 ON r1.session_id = m1.session_id AND r1.i = m1.i AND r1.domain = m1.domain AND r1.slot = m1.slot AND r1.e = m1.e GROUP BY ALL) WHERE value <> ''""",
    ("v_named",),
)
def _(spark, sf):
    t = named_turns(spark, sf)
    spans = S.slot_spans(S.state_changes(t).filter(S.in_slots()), t)
    return S.teacher_forced_states(t, S.at_turns(spans, t).withColumn("pos", F.col("pos") + 1))


_ACTS = """dx AS (SELECT session_id, pos, role, intent || '+' || domain || '+' || slot || '+' || CASE WHEN intent IN ('Inform', 'Recommend') THEN
 CAST(row_number() OVER (PARTITION BY session_id, pos, intent, domain, slot ORDER BY act_ord) AS VARCHAR) ELSE value END AS a FROM v_named),
"""


def _hot_sql(side, col):
    return f"list_transform({side}.l, lambda x: CASE WHEN list_contains({col}, x) THEN 1 ELSE 0 END)"


def act_ids(spark, sf):
    """Turns with the ids of their acts in the vocabulary of all acts, and that vocabulary."""
    t = stage(named_turns(spark, sf))
    vocab = stage(Vo.act_vocabulary(t))
    return t, Vo.act_ids(t, vocab, ["session_id", "pos"]), vocab


@query(
    "policy_examples",
    _MATCH + ", hits AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id), top AS (SELECT max(p_partkey) AS k FROM part), "
    + TRACK.strip().removeprefix("WITH").strip() + GRID + ", " + _ACTS + f"""tl AS (SELECT session_id, pos, role, list(a) AS acts FROM dx GROUP BY ALL),
ul AS (SELECT coalesce(list(a ORDER BY a), []) AS l FROM (SELECT DISTINCT a FROM dx WHERE role = 'usr')),
sl AS (SELECT coalesce(list(a ORDER BY a), []) AS l FROM (SELECT DISTINCT a FROM dx WHERE role = 'sys')),
fl AS (SELECT session_id, pos, list(CASE WHEN value <> '' THEN 1 ELSE 0 END ORDER BY domain, slot) AS filled FROM grid GROUP BY ALL),
mx AS (SELECT session_id, max(pos) AS last FROM tl GROUP BY ALL),
v AS (SELECT s.session_id, s.pos, {_hot_sql('ul', 'u.acts')} || {_hot_sql('sl', 'coalesce(b.acts, [])')} || fl.filled
  || CASE WHEN coalesce(h.n, 0) = 0 THEN [1, 0, 0, 0] WHEN h.n = 1 THEN [0, 1, 0, 0] WHEN h.n < 5 THEN [0, 0, 1, 0] ELSE [0, 0, 0, 1] END
  || [CASE WHEN s.pos = last THEN 1 ELSE 0 END] AS state, {_hot_sql('sl', 's.acts')} AS act
 FROM tl s JOIN tl u ON u.session_id = s.session_id AND u.pos = s.pos - 1 LEFT JOIN tl b ON b.session_id = s.session_id AND b.pos = s.pos - 2
 JOIN fl ON fl.session_id = s.session_id AND fl.pos = s.pos - 1 JOIN mx ON mx.session_id = s.session_id, ul, sl, top
 LEFT JOIN hits h ON h.query_id = (s.session_id * 31 + s.pos) % top.k + 1 WHERE s.role = 'sys')
SELECT session_id, pos, array_to_string(state, '') AS state, array_to_string(act, '') AS action FROM v""",
    ("v_named", *_E),
)
def _(spark, sf):
    """Vectors over the acts of the data; the search of a turn is the one its session and position fall on."""
    t, coded, vocab = act_ids(spark, sf)
    p = S.policy_examples(coded.drop("acts", "act_names").withColumnRenamed("act_ids", "acts"), S.state_changes(t))
    c = constraints(spark, sf)
    hits = stage(N.result_counts(c, N.entity_search(c, searchable(spark, sf), counted=True)).select("query_id", "n"))
    top = V.table(spark, sf, "part").agg(F.max("p_partkey").alias("top"))
    p = p.crossJoin(F.broadcast(top)).withColumn("query_id", (F.col("session_id") * 31 + F.col("pos")) % F.col("top") + 1).join(hits, "query_id", "left")
    p = p.crossJoin(F.broadcast(Vo.act_dims(vocab)))
    v = Fe.state_vector("user_action", "system_action", "filled", F.coalesce("n", F.lit(0)), "terminated", F.col("user_dim"), F.col("system_dim"))
    action = E.multi_hot_ids("action", F.col("system_dim"))
    return p.select("session_id", "pos", F.array_join(v, "").alias("state"), F.array_join(action, "").alias("action"))


@query(
    "action_names",
    "WITH " + _ACTS.strip().rstrip(",") + "SELECT session_id, pos, string_agg(DISTINCT a, ' ' ORDER BY a) AS names FROM dx WHERE role = 'sys' GROUP BY ALL",
    ("v_named",),
)
def _(spark, sf):
    """Action vectors of the system turns, read back as act names."""
    _, coded, vocab = act_ids(spark, sf)
    v = coded.filter("role = 'sys'").crossJoin(F.broadcast(Vo.act_dims(vocab))).withColumn("vec", E.multi_hot_ids("act_ids", F.col("system_dim")))
    return v.select("session_id", "pos", F.array_join(F.transform(E.hot_ids("vec"), lambda i: F.try_element_at("act_names", i)), " ").alias("names"))
