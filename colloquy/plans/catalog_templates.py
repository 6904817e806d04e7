"""Queries over delexicalised text, templates and generated utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import acts as A
from colloquy.operators import generation as G, lookups as L, templates as T, vocab as Vo
from colloquy.operators.filters import drop_unknown_features
from colloquy.operators.text import split_delex
from colloquy.plans import views as V
from colloquy.plans.registry import query

_I, _S = ("v_intent",), ("v_intent", "v_said")


def _rec(mode):
    counted = "hit" if mode == "found" else "true"
    return f"""WITH RECURSIVE rec AS (
 SELECT session_id, pos, CAST(-1 AS BIGINT) AS i, content AS text, CAST([] AS VARCHAR[]) AS seen, true AS usable, NULL::VARCHAR AS istr, false AS hit, CAST(0 AS BIGINT) AS n FROM v_said
 UNION ALL
 SELECT session_id, pos, i, CASE WHEN hit AND n > 1 THEN replace(replace(text, '[' || istr || ']', '[' || istr || '1]'), surf, '[' || istr || n || ']')
   WHEN hit THEN replace(text, surf, '[' || istr || ']') ELSE text END, seen, usable AND (hit OR NOT rep), istr, hit, n
 FROM (SELECT *, len(list_filter(seen, lambda x: x = istr)) AS n FROM (
  SELECT *, CASE WHEN {counted} THEN list_append(seen0, istr) ELSE seen0 END AS seen FROM (
   SELECT r.session_id, r.pos, r.i + 1 AS i, r.text, r.seen AS seen0, r.usable, a.istr, a.surf, a.rep,
    a.rep AND (contains(r.text, a.value) OR (coalesce(a.fac, '') <> '' AND contains(r.text, a.fac))) AS hit
   FROM rec r JOIN v_intent a ON a.session_id = r.session_id AND a.pos = r.pos AND a.act_ord = r.i + 1)))),
lastr AS (SELECT session_id, pos, arg_max(text, i) AS delex, arg_max(usable, i) AS usable FROM rec GROUP BY session_id, pos)
"""


def _orders():
    out = []
    for role, items in K.INTENT_ORDER.items():
        lst = "[" + ", ".join(f"'{x}'" for x in items) + "]"
        out.append(f"SELECT '{role}' AS role, unnest({lst}) AS base, generate_subscripts({lst}, 1) AS rnk")
    return " UNION ALL ".join(out)


_KEYS = f""", ord AS ({_orders()}),
ri AS (SELECT a.session_id, a.pos, a.role, act_ord, istr, rnk FROM v_intent a LEFT JOIN ord ON ord.role = a.role
 AND ord.base = CASE WHEN contains(string_split(istr, '1')[1], 'Inform') AND contains(string_split(istr, '1')[1], '无') THEN 'Inform+主体+属性+无' ELSE string_split(istr, '1')[1] END),
uk AS (SELECT session_id, pos, bool_or(rnk IS NULL) AS unknown FROM ri GROUP BY ALL),
keys AS (SELECT ri.session_id, ri.pos, ri.role, string_agg(istr, '*' ORDER BY CASE WHEN unknown THEN 0 ELSE rnk END, act_ord) AS key
 FROM ri JOIN uk ON uk.session_id = ri.session_id AND uk.pos = ri.pos GROUP BY ALL)
"""


@query("intent_strings", "SELECT session_id, pos, string_agg(istr, ' ' ORDER BY act_ord) AS intents FROM v_intent GROUP BY ALL", _I)
def _(spark, sf):
    t = V.act_turns(V.named_acts(spark, sf))
    return t.select("session_id", "pos", F.array_join(A.intent_strings("acts"), " ").alias("intents"))


@query("canonical_intent_order", "WITH" + _KEYS[1:] + "SELECT session_id, pos, key FROM keys", _I)
def _(spark, sf):
    t = V.act_turns(V.named_acts(spark, sf))
    return t.select("session_id", "pos", A.multi_intent_key("acts", F.col("role")).alias("key"))


@query("delexicalize_text_found", _rec("found") + "SELECT session_id, pos, delex, usable FROM lastr", _S)
def _(spark, sf):
    t = V.said(spark, sf).withColumn("d", A.delexicalize_text("content", "acts", "found"))
    return t.select("session_id", "pos", F.col("d.text").alias("delex"), F.col("d.usable").alias("usable"))


@query("delexicalize_text_all", _rec("all") + "SELECT session_id, pos, delex FROM lastr", _S)
def _(spark, sf):
    t = V.said(spark, sf)
    return t.select("session_id", "pos", A.delexicalize_text("content", "acts", "all")["text"].alias("delex"))


@query(
    "fill_template",
    _rec("all") + """, f AS (
 SELECT session_id, pos, CAST(-1 AS BIGINT) AS i, delex || '[主体][其他]' AS text, CAST([] AS VARCHAR[]) AS seen FROM lastr
 UNION ALL
 SELECT session_id, pos, i, replace(replace(CASE WHEN absent THEN replace(replace(text, '[主体]', domain), '[属性]', slot) ELSE text END,
   '[' || nm || ']', surf), '[' || nm || '1]', surf), seen
 FROM (SELECT *, CASE WHEN n > 1 THEN istr || n ELSE istr END AS nm FROM (SELECT *, len(list_filter(seen, lambda x: x = istr)) AS n FROM (
  SELECT r.session_id, r.pos, r.i + 1 AS i, r.text, list_append(r.seen, a.istr) AS seen, a.istr, a.surf, a.domain, a.slot,
   a.intent = 'Inform' AND a.value = '无' AS absent
  FROM f r JOIN v_intent a ON a.session_id = r.session_id AND a.pos = r.pos AND a.act_ord = r.i + 1))))
SELECT session_id, pos, regexp_replace(arg_max(text, i), '\\[[^\\[\\]]+\\]', ' ', 'g') AS text FROM f GROUP BY session_id, pos""".replace("\\\\", "\\"),
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf).withColumn("delex", A.delexicalize_text("content", "acts", "all")["text"])
    marked = F.concat("delex", F.lit("[主体][其他]"))
    return t.select("session_id", "pos", A.fill_template(marked, "acts", clear_left=True).alias("text"))


@query(
    "mine_templates",
    _rec("found") + _KEYS + """SELECT role, key, delex AS template, count(*) AS n FROM lastr l JOIN keys k ON k.session_id = l.session_id AND k.pos = l.pos
WHERE usable GROUP BY ALL""",
    _S,
)
def _(spark, sf):
    return T.mine_templates(V.said(spark, sf))


@query(
    "split_delex",
    _rec("all") + r"""SELECT session_id, pos, array_to_string(list_filter(regexp_split_to_array(regexp_replace(delex, '(\[[^\[^\]]+\])', ' \1 ', 'g'), '\s+'), lambda w: w <> ''), ' ') AS tokens FROM lastr""",
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf).withColumn("delex", A.delexicalize_text("content", "acts", "all")["text"])
    return t.select("session_id", "pos", F.array_join(split_delex("delex"), " ").alias("tokens"))


_TRIPLES = _rec("all") + """, ft AS (SELECT a.session_id, a.pos, a.role, a.act_ord,
 CASE WHEN p[1] = 'General' THEN p[1] || '-' || p[2] ELSE p[2] || '-' || p[1] END AS key,
 CASE WHEN p[3] = '酒店设施' AND p[1] = 'Inform' THEN p[3] || '+' || p[4] WHEN suffix(a.istr, '无') THEN p[3] || '+无' WHEN suffix(a.istr, '免费') THEN p[3] || '+免费' ELSE p[3] END AS slot,
 CASE WHEN a.rep THEN CAST(r.n AS VARCHAR) WHEN a.intent = 'Request' THEN '?' ELSE 'none' END AS ord,
 CASE WHEN r.hit THEN a.surf WHEN a.rep THEN 'none' WHEN a.intent = 'Request' THEN '?' WHEN a.intent = 'Select' THEN a.value ELSE 'none' END AS value
 FROM (SELECT *, string_split(istr, '+') AS p FROM v_intent) a JOIN rec r ON r.session_id = a.session_id AND r.pos = a.pos AND r.i = a.act_ord)
"""


@query("feature_triples", _TRIPLES + "SELECT session_id, pos, string_agg(key || ':' || slot || ':' || ord || ':' || value, ' ' ORDER BY act_ord) AS triples FROM ft GROUP BY ALL", _S)
def _(spark, sf):
    t = V.said(spark, sf)
    text = F.transform(A.feature_triples("acts", "content"), lambda x: F.concat_ws(":", x["key"], x["slot"], x["ord"], x["value"]))
    return t.select("session_id", "pos", F.array_join(text, " ").alias("triples"))


_NAMES = _TRIPLES + """, nm AS (SELECT 'd:' || string_split(key, '-')[1] AS name FROM ft UNION SELECT 'd-a:' || key FROM ft
 UNION SELECT 'd-a-s-v:' || key || '-' || slot || '-' || ord FROM ft)
"""


def features(spark, sf):
    return V.said(spark, sf).select("session_id", "pos", "role", A.feature_triples("acts", "content").alias("triples"))


@query("feature_names", _NAMES + "SELECT name, row_number() OVER (ORDER BY name DESC) - 1 AS id FROM nm", _S)
def _(spark, sf):
    names = features(spark, sf).select(F.explode(A.feature_names("triples")).alias("name"))
    return Vo.feature_cardinality(names)


@query(
    "feature_offsets",
    _NAMES + """SELECT CAST(0 AS BIGINT) AS d_start, count(*) FILTER (prefix(name, 'd:')) AS da_start,
 count(*) FILTER (prefix(name, 'd:') OR prefix(name, 'd-a:')) AS dasv_start, count(*) AS "end" FROM nm""",
    _S,
)
def _(spark, sf):
    names = features(spark, sf).select(F.explode(A.feature_names("triples")).alias("name"))
    return Vo.feature_offsets(Vo.feature_cardinality(names))


@query(
    "drop_unknown_features",
    _TRIPLES + """, known AS (SELECT DISTINCT 'd-a-s-v:' || key || '-' || slot || '-' || ord AS name FROM ft WHERE session_id % 3 = 0)
SELECT session_id, pos, key, count(*) AS n FROM ft WHERE 'd-a-s-v:' || key || '-' || slot || '-' || ord IN (SELECT name FROM known) GROUP BY ALL""",
    _S,
)
def _(spark, sf):
    f = features(spark, sf)
    rows = f.select("session_id", "pos", F.inline("triples"))
    name = F.concat(F.lit("d-a-s-v:"), F.concat_ws("-", "key", "slot", "ord"))
    known = rows.filter("session_id % 3 = 0").select(name.alias("name")).distinct()
    return drop_unknown_features(rows, known).groupBy("session_id", "pos", "key").agg(F.count(F.lit(1)).alias("n"))


_TOK = r"list_filter(regexp_split_to_array(regexp_replace({}, '(\[[^\[^\]]+\])', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"


@query(
    "token_vocabulary",
    _rec("all") + f"""SELECT CAST(i AS BIGINT) AS id, t AS token, NULL::BIGINT AS freq FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest(['PAD_token', 'SOS_token', 'EOS_token', 'UNK_token']) AS t)
UNION ALL SELECT row_number() OVER (ORDER BY n, t) + 3, t, n FROM (SELECT t, count(*) AS n FROM (SELECT unnest({_TOK.format('delex')}) AS t FROM lastr) GROUP BY t HAVING count(*) > 3)""",
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf).withColumn("tokens", split_delex(A.delexicalize_text("content", "acts", "all")["text"]))
    return Vo.token_vocabulary(t, "tokens")


@query(
    "unknown_sentence_ratio",
    _rec("all") + f""", tk AS (SELECT session_id, pos, unnest({_TOK.format('delex')}) AS t FROM lastr),
voc AS (SELECT t FROM tk GROUP BY t HAVING count(*) > 3), b AS (SELECT DISTINCT session_id, pos FROM tk WHERE t NOT IN (SELECT t FROM voc))
SELECT (SELECT count(*) FROM lastr) AS total, (SELECT count(*) FROM b) AS bad, round((SELECT count(*) FROM b) / (SELECT count(*) FROM lastr), 6) AS ratio""",
    _S,
)
def _(spark, sf):
    from colloquy.operators.staging import stage

    t = stage(V.said(spark, sf).select("session_id", "pos", split_delex(A.delexicalize_text("content", "acts", "all")["text"]).alias("tokens")))
    return Vo.unknown_sentence_ratio(t, "tokens", Vo.token_vocabulary(t, "tokens", specials=("UNK_token",)), ["session_id", "pos"])


@query(
    "slot_error",
    _rec("found") + r""", want AS (SELECT session_id, pos, role, istr AS slot, count(*) AS want FROM v_intent WHERE rep GROUP BY ALL),
got AS (SELECT session_id, pos, slot, count(*) AS got FROM (SELECT session_id, pos, regexp_replace(unnest(regexp_extract_all(delex, '\[([^\[\]]+)\]', 1)), '\d+$', '') AS slot FROM lastr) GROUP BY ALL),
j AS (SELECT coalesce(got, 0) - coalesce(want, 0) AS d, coalesce(want, 0) AS want, CASE WHEN coalesce(w.pos, g.pos) % 2 = 0 THEN 'usr' ELSE 'sys' END AS role
 FROM want w FULL JOIN got g ON g.session_id = w.session_id AND g.pos = w.pos AND g.slot = w.slot)
SELECT role, CAST(sum(want) AS BIGINT) AS total, CAST(sum(greatest(d, 0)) AS BIGINT) AS redundant, CAST(sum(greatest(-d, 0)) AS BIGINT) AS missing,
 round(sum(abs(d)) / sum(want) * 100, 6) AS slot_error FROM j GROUP BY role""",
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf)
    names = F.transform(
        F.filter("acts", lambda a: A._replaceable(a, A.intent_string(a))), A.intent_string
    )
    want = t.select("session_id", "pos", F.explode(names).alias("slot")).groupBy("session_id", "pos", "slot").agg(F.count(F.lit(1)).alias("want"))
    d = t.select("session_id", "pos", A.delexicalize_text("content", "acts", "found")["text"].alias("delex"))
    got = G.placeholder_counts(d, ["session_id", "pos"], "delex").withColumn("slot", F.regexp_replace("slot", r"\d+$", ""))
    got = got.groupBy("session_id", "pos", "slot").agg(F.sum("got").alias("got"))
    role = lambda d: d.withColumn("role", F.when(F.col("pos") % 2 == 0, "usr").otherwise("sys"))
    return G.slot_error(role(want), role(got), ["session_id", "pos", "role"], by=["role"])


@query(
    "slot_error_mean",
    _rec("found") + r""", w AS (SELECT session_id, pos, list(DISTINCT istr) AS want FROM v_intent WHERE rep GROUP BY ALL),
g AS (SELECT session_id, pos, list_distinct(regexp_extract_all(delex, '\[([^\[\]]+)\]', 1)) AS got FROM lastr),
x AS (SELECT len(coalesce(want, [])) AS n, len(list_filter(coalesce(want, []), lambda v: NOT list_contains(got, v))) + len(list_filter(got, lambda v: NOT list_contains(coalesce(want, []), v))) AS bad
 FROM g LEFT JOIN w ON w.session_id = g.session_id AND w.pos = g.pos)
SELECT count(*) FILTER (n > 0) AS turns, round(avg(CASE WHEN n > 0 THEN bad / n END), 6) AS mean, round(stddev_pop(CASE WHEN n > 0 THEN bad / n END), 6) AS std,
 round(sum(bad) / sum(n), 6) AS pooled FROM x""",
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf)
    names = F.transform(F.filter("acts", lambda a: A._replaceable(a, A.intent_string(a))), A.intent_string)
    d = A.delexicalize_text("content", "acts", "found")["text"]
    got = F.regexp_extract_all(d, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return G.slot_error_mean(t.select(names.alias("want"), got.alias("got")), "want", "got")


_GRAMS = r"""
WITH t AS (SELECT row_number() OVER () AS hid, act_key, list_filter(regexp_split_to_array(hyp, '\s+'), lambda w: w <> '') AS h,
 list_filter(regexp_split_to_array(ref, '\s+'), lambda w: w <> '') AS r FROM v_pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT hid, act_key, n, array_to_string(h[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT hid, act_key, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM t, ns) GROUP BY ALL),
rg AS (SELECT act_key, n, g, max(c) AS lim FROM (SELECT hid, act_key, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c
  FROM (SELECT hid, act_key, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM t, ns) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT hg.n, CAST(sum(least(c, coalesce(lim, 0))) AS BIGINT) AS hit, CAST(sum(c) AS BIGINT) AS total FROM hg LEFT JOIN rg ON rg.act_key = hg.act_key AND rg.n = hg.n AND rg.g = hg.g GROUP BY hg.n),
rl AS (SELECT DISTINCT act_key, len(r) AS rl FROM t),
cl AS (SELECT hid, len(any_value(h)) AS hl, arg_min(rl, abs(len(h) - rl) * 100000 + rl) AS rl FROM t JOIN rl ON rl.act_key = t.act_key GROUP BY hid),
l AS (SELECT CAST(sum(hl) AS BIGINT) AS hyp_len, CAST(sum(rl) AS BIGINT) AS ref_len FROM cl),
c AS (SELECT *, (SELECT hit FROM m WHERE n = 1) AS hit1, (SELECT total FROM m WHERE n = 1) AS total1, (SELECT hit FROM m WHERE n = 2) AS hit2, (SELECT total FROM m WHERE n = 2) AS total2,
 (SELECT hit FROM m WHERE n = 3) AS hit3, (SELECT total FROM m WHERE n = 3) AS total3, (SELECT hit FROM m WHERE n = 4) AS hit4, (SELECT total FROM m WHERE n = 4) AS total4 FROM l),
b AS (SELECT *, CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END AS bp FROM c)
"""
_LOG = " + ".join(f"0.25 * ln((CASE WHEN hit{n} = 0 THEN 0.1 ELSE hit{n} END) / greatest(total{n}, 1))" for n in (1, 2, 3, 4))
_PLAIN = " + ".join(f"0.25 * CASE WHEN hit{n} = 0 THEN -9999999999.0 ELSE ln(hit{n} / total{n}) END" for n in (1, 2, 3, 4))


def _bleu_counts(spark, sf):
    p = V.pairs(spark, sf).select("act_key", V.words(F.col("hyp")).alias("h"), V.words(F.col("ref")).alias("r"))
    return G.bleu_counts(p, "act_key", "h", "r", [])


@query("bleu_smoothed", _GRAMS + f"SELECT * EXCLUDE (bp), CASE WHEN hit1 = 0 THEN 0.0 ELSE round(bp * exp({_LOG}), 6) END AS bleu FROM b", ("v_pairs",))
def _(spark, sf):
    return G.bleu(_bleu_counts(spark, sf))


@query("bleu_plain", _GRAMS + f"SELECT * EXCLUDE (bp), round(100 * bp * exp({_PLAIN}), 6) AS bleu FROM b", ("v_pairs",))
def _(spark, sf):
    return G.bleu(_bleu_counts(spark, sf), style="plain")


@query(
    "split_repeated_intents",
    """WITH RECURSIVE r AS (SELECT session_id, pos // 8 AS part, short AS base, count(*) AS n FROM v_short WHERE intent IN ('Inform', 'Recommend') GROUP BY ALL),
lib AS (SELECT DISTINCT base, unnest(CASE length(base) % 3 WHEN 0 THEN [1, 2, 4] WHEN 1 THEN [1, 3] ELSE [2, 3] END) AS rep FROM r),
g AS (SELECT session_id, part, base, n, n AS rest, CAST([] AS BIGINT[]) AS out FROM r
 UNION ALL SELECT session_id, part, base, n, rest - best, list_append(out, best) FROM (
  SELECT g.session_id, g.part, g.base, g.n, g.rest, g.out, (SELECT max(rep) FROM lib WHERE lib.base = g.base AND rep <= g.rest) AS best FROM g WHERE rest > 0) WHERE best IS NOT NULL)
SELECT session_id, part, base, n, max(CASE WHEN rest = 0 THEN array_to_string(out, ',') END) AS pieces FROM g GROUP BY ALL""",
    ("v_short",),
)
def _(spark, sf):
    a = V.named_acts(spark, sf).filter("intent in ('Inform', 'Recommend')")
    whole = {c: F.col(c) for c in V.ACT}
    short = F.when(
        F.col("slot").contains(K.FACILITY) & (F.col("intent") == "Inform"),
        F.concat_ws("+", "intent", "domain", F.get(F.split("slot", "-"), F.lit(0)), "value"),
    ).otherwise(F.concat_ws("+", "intent", "domain", "slot"))
    r = a.groupBy("session_id", F.expr("pos div 8").alias("part"), short.alias("base")).agg(F.count(F.lit(1)).alias("n"))
    m = F.length("base") % 3
    reps = F.when(m == 0, F.array(F.lit(1), F.lit(2), F.lit(4))).when(m == 1, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(3)))
    lib = r.select("base").distinct().select("base", F.explode(reps).alias("rep"))
    out = T.split_repeated(r, lib)
    return out.select("session_id", "part", "base", "n", F.array_join("pieces", ",").alias("pieces"))


@query(
    "select_template",
    _rec("found") + _KEYS + """, lib AS (SELECT DISTINCT key, delex AS template FROM lastr l JOIN keys k ON k.session_id = l.session_id AND k.pos = l.pos WHERE usable AND l.session_id % 3 <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(template), template) - 1 AS j, count(*) OVER (PARTITION BY key) AS cnt FROM lib),
pk AS (SELECT session_id, pos, key, CAST('0x' || substr(md5('7|' || session_id || '|' || pos), 1, 8) AS BIGINT) AS h FROM keys)
SELECT pk.session_id, pk.pos, num.template FROM pk LEFT JOIN num ON num.key = pk.key AND num.j = pk.h % num.cnt""",
    _S,
)
def _(spark, sf):
    t = T.usable_for_template(V.said(spark, sf))
    lib = t.filter("usable and session_id % 3 <> 0").select("key", F.col("delex").alias("template"))
    out = L.select_template(t.select("session_id", "pos", "key"), lib, "key", [F.col("session_id").cast("string"), F.col("pos").cast("string")], 7)
    return out.select("session_id", "pos", "template")


_REALISE = _rec("found") + _KEYS + r""", lib AS (SELECT DISTINCT key, delex AS template FROM lastr l JOIN keys k ON k.session_id = l.session_id AND k.pos = l.pos WHERE usable AND l.session_id % 3 <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(template), template) - 1 AS j, count(*) OVER (PARTITION BY key) AS cnt FROM lib),
pk AS (SELECT session_id, pos, role, key, CAST('0x' || substr(md5('0|' || session_id || '|' || pos), 1, 8) AS BIGINT) AS h FROM keys),
auto AS (SELECT pk.session_id, pk.pos, pk.role, num.template FROM pk LEFT JOIN num ON num.key = pk.key AND num.j = pk.h % num.cnt),
held AS (SELECT session_id, pos, role, istr, count(*) AS n, min(act_ord) AS f FROM v_intent GROUP BY ALL),
named AS (SELECT session_id, pos, role, f, CASE WHEN n > 1 AND regexp_matches(istr, 'Recommend|名称|推荐菜|周边')
 THEN istr || '1+' || array_to_string(list_transform(range(2, n + 1), lambda k: string_split(istr, '+')[-1] || k), '+') ELSE istr END AS name FROM held),
ranked AS (SELECT n.*, rnk, bool_or(rnk IS NULL) OVER (PARTITION BY session_id, pos) AS unknown FROM named n LEFT JOIN ord ON ord.role = n.role
 AND ord.base = CASE WHEN contains(string_split(name, '1')[1], 'Inform') AND contains(string_split(name, '1')[1], '无') THEN 'Inform+主体+属性+无' ELSE string_split(name, '1')[1] END),
placed AS (SELECT session_id, pos, name, row_number() OVER (PARTITION BY session_id, pos ORDER BY CASE WHEN unknown THEN 0 ELSE rnk END, regexp_matches(name, '1\+[^+]*2'), f) AS i,
 count(*) OVER (PARTITION BY session_id, pos) AS n FROM ranked),
part AS (SELECT session_id, pos, i, n, '有[' || k.name || ']' AS s FROM (SELECT *, CASE WHEN contains(name, 'Inform') AND contains(name, '无') THEN 'Inform+主体+属性+无' ELSE name END AS looked FROM placed) p
 LEFT JOIN (SELECT DISTINCT name FROM named) k ON k.name = looked),
man AS (SELECT session_id, pos, CASE WHEN count(s) = count(*) THEN string_agg(CASE WHEN regexp_matches(b, '[!?！？]$') THEN b ELSE b || CASE WHEN i = n THEN '。' ELSE '，' END END, '' ORDER BY i) END AS template
 FROM (SELECT *, regexp_replace(regexp_replace(s, '^[。.，, ]+', ''), '[。.，, ]+$', '') AS b FROM part) GROUP BY ALL),
chosen AS (SELECT a.session_id, a.pos, a.role, coalesce(a.template, man.template) AS template FROM auto a JOIN man ON man.session_id = a.session_id AND man.pos = a.pos),
f AS (
 SELECT session_id, pos, CAST(-1 AS BIGINT) AS i, template AS text, CAST([] AS VARCHAR[]) AS seen FROM chosen
 UNION ALL
 SELECT session_id, pos, i, replace(replace(CASE WHEN absent THEN replace(replace(text, '[主体]', domain), '[属性]', slot) ELSE text END,
   '[' || nm || ']', surf), '[' || nm || '1]', surf), seen
 FROM (SELECT *, CASE WHEN n > 1 THEN istr || n ELSE istr END AS nm FROM (SELECT *, len(list_filter(seen, lambda x: x = istr)) AS n FROM (
  SELECT r.session_id, r.pos, r.i + 1 AS i, r.text, list_append(r.seen, a.istr) AS seen, a.istr, a.surf, a.domain, a.slot,
   a.intent = 'Inform' AND a.value = '无' AS absent
  FROM f r JOIN v_intent a ON a.session_id = r.session_id AND a.pos = r.pos AND a.act_ord = r.i + 1)))),
said AS (SELECT session_id, pos, list(text ORDER BY i)[-1] AS text FROM f GROUP BY session_id, pos)
SELECT c.session_id, c.pos, c.role, template, text FROM chosen c JOIN said ON said.session_id = c.session_id AND said.pos = c.pos
"""


@query("realise_turns", _REALISE, _S)
def _(spark, sf):
    """Whole-key templates mined from two thirds of the sessions, one plain sentence per intent otherwise."""
    t = V.said(spark, sf)
    mined = T.mine_templates(t.filter("session_id % 3 <> 0")).select("key", "template")
    names = t.select(F.explode(T.manual_intents("acts", F.col("role"))).alias("intent")).distinct()
    manual = names.select("intent", F.concat(F.lit("有["), "intent", F.lit("]")).alias("template"))
    return T.realise(t, mined, manual).select("session_id", "pos", "role", "template", "text")


@query(
    "finish_sentence",
    r"""SELECT session_id, pos, CASE WHEN regexp_matches(b, '[!?！？]$') THEN b WHEN pos % 2 = 0 THEN b || '。' ELSE b || '，' END AS text
FROM (SELECT session_id, pos, regexp_replace(regexp_replace(content, '^[。.，, ]+', ''), '[。.，, ]+$', '') AS b FROM v_turns)""",
    ("v_turns",),
)
def _(spark, sf):
    return V.turns(spark, sf).select("session_id", "pos", A.finish_sentence("content", F.col("pos") % 2 == 0).alias("text"))


@query(
    "attach_text_and_features",
    _TRIPLES + """, f AS (SELECT session_id, pos, count(*) AS n_features FROM ft WHERE intent_ok GROUP BY ALL)
SELECT s.session_id, s.pos, s.content, n_features FROM v_said s JOIN f ON f.session_id = s.session_id AND f.pos = s.pos WHERE s.role = 'usr'""".replace(
        "WHERE intent_ok", "WHERE ord <> '?'"
    ),
    _S,
)
def _(spark, sf):
    t = V.said(spark, sf)
    f = t.select("session_id", "pos", F.size(F.filter(A.feature_triples("acts", "content"), lambda x: x["ord"] != "?")).cast("bigint").alias("n_features"))
    split = t.filter("role = 'usr'").select("session_id", "pos")
    return L.attach_text_and_features(split, t.select("session_id", "pos", "content"), f.filter("n_features > 0"), ["session_id", "pos"])
