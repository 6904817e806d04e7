"""SQL statement of the views in ``views``."""

from __future__ import annotations

from colloquy import constants as K
from colloquy.plans.views import NAMED_SLOTS


def _list(items):
    return "[" + ", ".join("'" + i + "'" for i in items) + "]"


_INTENT = """CASE event_type WHEN 'click' THEN 'Inform' WHEN 'view' THEN 'Request' WHEN 'purchase' THEN 'Recommend'
 WHEN 'error' THEN 'NoOffer' ELSE 'Select' END"""

_NAMED_SLOT = "CASE domain0 " + " ".join(
    f"WHEN '{d}' THEN {_list(s)}[k % 7 + 1]" for d, s in NAMED_SLOTS.items()
) + " END"

VIEWS = {
    "v_turns": ((), """
SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
 CASE role WHEN 'user' THEN 'usr' WHEN 'system' THEN 'note' ELSE 'sys' END AS role, text AS content
FROM conversations"""),
    "v_exchanges": ((), """
SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
 CASE role WHEN 'user' THEN 'usr' ELSE 'sys' END AS role, text AS content
FROM conversations WHERE role <> 'system'"""),
    "v_events": ((), """
SELECT event_id, ts, user_id AS session_id, event_type, CAST(floor(value / 10) AS BIGINT) AS v,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
FROM events"""),
    "v_acts": (("v_events",), f"""
SELECT session_id, n // 3 AS pos, n % 3 AS act_ord, CASE WHEN (n // 3) % 2 = 0 THEN 'usr' ELSE 'sys' END AS role,
 {_INTENT} AS intent, 'd' || (k % 5) AS domain, 's' || (k % 7) AS slot, 'v' || v AS value, event_id, ts, n, k
FROM v_events"""),
    "v_named0": (("v_events",), f"""
SELECT *, n // 3 AS pos, n % 3 AS act_ord, CASE WHEN (n // 3) % 2 = 0 THEN 'usr' ELSE 'sys' END AS role,
 {_INTENT} AS intent0, {_list(K.DOMAINS)}[k % 5 + 1] AS domain0 FROM v_events"""),
    "v_named1": (("v_named0",), f"""
SELECT *, {_NAMED_SLOT} AS slot0, intent0 = 'Select' AND k % 4 = 0 AS general FROM v_named0"""),
    "v_named": (("v_named1",), f"""
SELECT session_id, pos, act_ord, role, CASE WHEN general THEN 'General' ELSE intent0 END AS intent,
 CASE WHEN general AND role = 'usr' THEN 'greet' WHEN general THEN 'thank' ELSE domain0 END AS domain,
 CASE WHEN general OR intent0 = 'NoOffer' THEN 'none' WHEN intent0 = 'Select' THEN '源领域'
  WHEN intent0 = 'Recommend' THEN '名称' ELSE slot0 END AS slot,
 CASE WHEN general OR intent0 = 'NoOffer' THEN 'none'
  WHEN intent0 = 'Select' THEN {_list(K.DOMAINS[:4])}[v % 4 + 1]
  WHEN intent0 = 'Request' THEN ''
  WHEN intent0 = 'Recommend' THEN 'v' || v
  WHEN contains(slot0, '酒店设施') THEN CASE WHEN v % 2 = 0 THEN '是' ELSE '否' END
  WHEN slot0 = '门票' AND v % 5 = 0 THEN '免费'
  WHEN v = 7 THEN '无' ELSE 'v' || v END AS value, event_id, ts, n, k
FROM v_named1"""),
    "v_phrase": (("v_named",), """
SELECT *, CASE WHEN event_id % 17 = 0 THEN '好的' ELSE '我要 ' || CASE WHEN contains(slot, '酒店设施') THEN string_split(slot, '-')[2] ELSE value END || ' 吧' END AS phrase
FROM v_named"""),
    "v_said": (("v_phrase",), """
SELECT session_id, pos, role, string_agg(phrase, '，' ORDER BY act_ord) AS content FROM v_phrase GROUP BY session_id, pos, role"""),
    "v_short": (("v_named",), """
SELECT *, intent || '+' || domain || '+' || CASE WHEN intent = 'Select' THEN '源领域+' || value
  WHEN contains(slot, '酒店设施') AND intent = 'Inform' THEN string_split(slot, '-')[1] || '+' || value
  WHEN contains(slot, '酒店设施') AND intent = 'Request' THEN string_split(slot, '-')[1] ELSE slot END AS short FROM v_named"""),
    "v_intent": (("v_short",), """
SELECT *, (intent IN ('Inform', 'Recommend') OR contains(istr, '酒店设施')) AND NOT suffix(istr, '无') AS rep,
 CASE WHEN contains(slot, '酒店设施') THEN string_split(slot, '-')[2] END AS fac,
 CASE WHEN contains(istr, '酒店设施') THEN coalesce(string_split(slot, '-')[2], value) ELSE value END AS surf
FROM (SELECT *, CASE WHEN short || '+' || value = 'Inform+景点+门票+免费' OR value = '无' THEN short || '+' || value ELSE short END AS istr FROM v_short)"""),
    "v_gold": (("v_acts",), """
SELECT session_id, pos, role, 'g' || (session_id % 5) AS goal_type, act_ord, intent, domain, slot, value FROM v_acts"""),
    "v_pred": (("v_acts",), """
SELECT session_id, pos, role, 'g' || (session_id % 5) AS goal_type, act_ord, intent, domain, slot,
 CASE WHEN event_id % 7 = 0 THEN value || 'x' ELSE value END AS value
FROM v_acts, unnest(CASE WHEN event_id % 11 = 0 THEN [] WHEN event_id % 13 = 0 THEN [1, 2] ELSE [1] END) AS c(copy)"""),
    "v_ngold": (("v_named",), """
SELECT session_id, pos, role, act_ord, intent, domain, slot, value FROM v_named"""),
    "v_npred": (("v_named",), """
SELECT session_id, pos, role, act_ord, intent, domain, slot,
 CASE WHEN event_id % 7 = 0 THEN value || 'x' ELSE value END AS value
FROM v_named, unnest(CASE WHEN event_id % 11 = 0 THEN [] WHEN event_id % 13 = 0 THEN [1, 2] ELSE [1] END) AS c(copy)"""),
    "v_near": ((), """
SELECT l_partkey AS key, list(DISTINCT s_name ORDER BY s_name) AS near
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey"""),
    "v_entities": (("v_near",), """
SELECT p_partkey AS key, p_name AS name, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price,
 p_size / 10.0 AS rating, string_split(p_name, ' ') || [p_type, p_brand] AS tags, coalesce(near, []) AS near
FROM part LEFT JOIN v_near ON key = p_partkey"""),
    "v_beliefs": ((), """
SELECT query_id, s.slot AS slot, s.value AS value FROM (
SELECT p_partkey AS query_id, unnest([
 {'slot': 'price', 'value': CASE p_partkey % 6 WHEN 0 THEN CAST(floor(p_retailprice) AS BIGINT) || '-' || (CAST(floor(p_retailprice) AS BIGINT) + 1) || '元'
   WHEN 1 THEN (CAST(floor(p_retailprice) AS BIGINT) + 99) || '以上' WHEN 2 THEN '便宜' ELSE '' END},
 {'slot': 'rating', 'value': CASE WHEN p_partkey % 6 IN (2, 3) THEN '4.5分以上' WHEN p_partkey % 6 = 1 THEN '高' ELSE '' END},
 {'slot': 'tags', 'value': CASE WHEN p_partkey % 6 IN (1, 4) THEN string_split(p_name, ' ')[1] || '  ' || p_brand ELSE '' END},
 {'slot': 'near', 'value': CASE WHEN p_partkey % 6 IN (2, 3) THEN printf('Supplier#%09d', p_partkey % 100) ELSE '' END},
 {'slot': 'name', 'value': CASE WHEN p_partkey % 6 = 5 THEN p_name ELSE '' END}]) AS s FROM part)"""),
    "v_labelled": ((), """
SELECT d.doc_id AS id, text, lang, source,
 CASE WHEN quality + 2 * toxic = 0 THEN 'other' ELSE 'c' || (quality + 2 * toxic) END AS label,
 CASE WHEN md5(CAST(d.doc_id AS VARCHAR)) < 'c' THEN 'train' ELSE 'test' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "v_scores": ((), """
SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
 list_transform(range(0, 10), lambda c: list_sum(list_transform(range(c + 1, len(embedding) + 1, 20), lambda i: CAST(embedding[i] AS DOUBLE)))) AS trs,
 list_transform(range(0, 10), lambda c: list_sum(list_transform(range(c + 11, len(embedding) + 1, 20), lambda i: CAST(embedding[i] AS DOUBLE)))) AS asr FROM embeddings"""),
    "v_pairs": (("v_turns",), """
SELECT a.session_id, a.pos, a.role, a.content AS hyp, b.content AS ref, a.role || (a.session_id % 20) AS act_key
FROM v_turns a JOIN v_turns b ON a.session_id = b.session_id AND b.pos = a.pos + 1"""),
    "v_nbest": (("v_turns",), r"""
SELECT session_id AS utt_id, pos AS rank, content,
 list_filter(regexp_split_to_array(content, '\s+'), lambda t: t <> '') AS tokens,
 (length(content) % 7) / 7.0 AS am, (length(content) % 11) / 11.0 AS lm FROM v_turns"""),
    "v_lines": ((), f"""
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
 {_list(K.DOMAINS)}[l_partkey % 5 + 1] AS raw FROM lineitem"""),
    "v_lines2": (("v_lines",), """
SELECT *, CASE WHEN raw IN ('出租', '地铁') AND id < 3 THEN '酒店' ELSE raw END AS domain FROM v_lines"""),
    "v_subgoals": (("v_lines2",), """
SELECT l_orderkey AS goal_id, id, domain,
 CASE WHEN domain NOT IN ('出租', '地铁') AND id > 2 AND l_suppkey % 3 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END END AS ref,
 CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax
FROM v_lines2"""),
    "v_tuples": (("v_subgoals",), """
SELECT goal_id, id, domain, ref, c.o AS o, c.kind AS kind, c.slot AS slot, c.value AS value, c.is_list AS is_list FROM v_subgoals, unnest(list_filter([
 {'o': 0, 'kind': 'c', 'slot': '名称', 'value': CASE WHEN ref IS NOT NULL THEN ['出现在id=' || ref || '的周边' || domain || '里'] WHEN domain NOT IN ('出租', '地铁') AND qty % 4 = 0 THEN ['n' || qty] END, 'is_list': false},
 {'o': 1, 'kind': 'c', 'slot': '评分', 'value': CASE WHEN domain NOT IN ('出租', '地铁') AND disc >= 5 THEN [disc || '分以上'] END, 'is_list': false},
 {'o': 2, 'kind': 'c', 'slot': '推荐菜', 'value': CASE WHEN domain = '餐馆' AND disc % 2 = 1 THEN ['菜a', '菜b' || qty] END, 'is_list': true},
 {'o': 3, 'kind': 'c', 'slot': '出发地', 'value': CASE WHEN domain IN ('出租', '地铁') THEN ['id=1'] END, 'is_list': false},
 {'o': 4, 'kind': 'c', 'slot': '目的地', 'value': CASE WHEN domain IN ('出租', '地铁') THEN ['id=2'] END, 'is_list': false},
 {'o': 5, 'kind': 'r', 'slot': CASE WHEN domain IN ('出租', '地铁') THEN '车型' ELSE '地址' END, 'value': CAST([] AS VARCHAR[]), 'is_list': false},
 {'o': 6, 'kind': 'r', 'slot': '周边景点', 'value': CASE WHEN domain NOT IN ('出租', '地铁') AND tax % 2 = 1 THEN CAST([] AS VARCHAR[]) END, 'is_list': true}],
 lambda x: x.value IS NOT NULL)) AS t(c)"""),
    "v_gstate": (("v_tuples",), """
SELECT *, (goal_id + i) % 5 <> 0 AS expressed, CASE WHEN len(value) = 0 AND (goal_id + i) % 7 <> 0 THEN ['x'] ELSE value END AS filled
FROM (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY id, o) - 1 AS i FROM v_tuples)"""),
}


def cte_list(names) -> str:
    done: list[str] = []

    def add(n):
        if n in done:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            add(d)
        done.append(n)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in done)
