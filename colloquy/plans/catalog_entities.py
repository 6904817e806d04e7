"""Queries over entities and their constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.operators import entities as N, lookups as L
from colloquy.plans import views as V
from colloquy.plans.registry import query

KINDS = {"name": "substring", "price": "between", "rating": "between", "tags": "multiple_in", "near": "in"}


def constraints(spark, sf):
    return N.parse_constraints(
        V.beliefs_for_search(spark, sf), KINDS, name_slot="name", rating_slot="rating", price_slots=("price",), ticket_slot="price"
    )


def searchable(spark, sf):
    return N.entity_terms(V.entities(spark, sf), {"name": "name"}, {"tags": "tags", "near": "near"}, {"price": "price", "rating": "rating"})


_CONSTRAINTS = r"""
WITH b AS (SELECT * FROM v_beliefs WHERE value <> ''),
nm AS (SELECT DISTINCT query_id FROM b WHERE slot = 'name'),
b2 AS (SELECT * FROM b WHERE slot = 'name' OR query_id NOT IN (SELECT query_id FROM nm)),
con AS (
 SELECT query_id, slot, 'between' AS kind, NULL AS text, CAST(regexp_extract(value, '^(\d\.\d|\d)', 1) AS DOUBLE) AS lo, NULL::DOUBLE AS hi
  FROM b2 WHERE slot = 'rating' AND regexp_matches(value, '^\d')
 UNION ALL
 SELECT query_id, slot, 'between', NULL,
  CASE WHEN regexp_matches(value, '^\d+-\d+') THEN CAST(regexp_extract(value, '^(\d+)-', 1) AS DOUBLE)
   WHEN regexp_matches(value, '^\d+') AND contains(value, '以上') THEN CAST(regexp_extract(value, '^(\d+)', 1) AS DOUBLE)
   WHEN regexp_matches(value, '^\d+') AND contains(value, '以下') THEN NULL
   WHEN regexp_matches(value, '^\d+') THEN CAST(regexp_extract(value, '^(\d+)', 1) AS DOUBLE)
   WHEN value = '免费' THEN 0.0 WHEN value = '不免费' THEN 1.0 END,
  CASE WHEN regexp_matches(value, '^\d+-\d+') THEN CAST(regexp_extract(value, '^\d+-(\d+)', 1) AS DOUBLE)
   WHEN regexp_matches(value, '^\d+') AND contains(value, '以上') THEN NULL
   WHEN regexp_matches(value, '^\d+') THEN CAST(regexp_extract(value, '^(\d+)', 1) AS DOUBLE)
   WHEN value = '免费' THEN 0.0 END
  FROM b2 WHERE slot = 'price'
 UNION ALL
 SELECT query_id, slot, CASE slot WHEN 'name' THEN 'substring' WHEN 'tags' THEN 'multiple_in' ELSE 'in' END, value, NULL, NULL
  FROM b2 WHERE slot IN ('name', 'tags', 'near'))
"""
_MATCH = _CONSTRAINTS + """,
ent AS MATERIALIZED (SELECT * FROM v_entities),
w AS (SELECT query_id,
 max(CASE WHEN slot = 'rating' THEN lo END) AS rlo, max(CASE WHEN slot = 'price' THEN lo END) AS plo, max(CASE WHEN slot = 'price' THEN hi END) AS phi,
 max(CASE WHEN slot = 'name' THEN text END) AS nm, max(CASE WHEN slot = 'near' THEN text END) AS nr,
 max(CASE WHEN slot = 'tags' THEN text END) AS tg FROM con GROUP BY query_id),
found AS (SELECT query_id, key AS entity FROM w JOIN ent ON
 (rlo IS NULL OR rating >= rlo) AND (plo IS NULL OR coalesce(price >= plo, false)) AND (phi IS NULL OR coalesce(price <= phi, false))
 AND (nm IS NULL OR contains(name, nm))
 AND (nr IS NULL OR len(list_filter(near, lambda e: contains(e, nr))) > 0)
 AND (tg IS NULL OR len(list_filter(list_filter(string_split(tg, ' '), lambda t: t <> ''), lambda t: len(list_filter(tags, lambda e: contains(e, t))) = 0)) = 0))
"""
_B, _E = ("v_beliefs",), ("v_beliefs", "v_entities")


@query("parse_constraints", _CONSTRAINTS + "SELECT query_id, slot, kind, text, lo, hi FROM con", _B)
def _(spark, sf):
    return constraints(spark, sf)


@query("entity_search", _MATCH + "SELECT query_id, entity FROM found", _E)
def _(spark, sf):
    return N.entity_search(constraints(spark, sf), searchable(spark, sf))


@query(
    "result_bucket",
    _MATCH + """, n AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id)
SELECT w.query_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n = 1 THEN 1 WHEN n < 5 THEN 2 ELSE 3 END AS bucket
FROM w LEFT JOIN n ON n.query_id = w.query_id""",
    _E,
)
def _(spark, sf):
    c = constraints(spark, sf)
    return N.result_counts(c, N.entity_search(c, searchable(spark, sf), counted=True))


@query(
    "entities",
    """SELECT key, name, price, rating, array_to_string(tags, ',') AS tags, len(near) AS near_count,
 array_to_string(near[1:5], ',') AS first_near FROM v_entities""",
    ("v_entities",),
)
def _(spark, sf):
    return V.entities(spark, sf).select(
        "key", "name", "price", "rating", F.array_join("tags", ",").alias("tags"), F.size("near").cast("bigint").alias("near_count"),
        F.array_join(N.first_nearby("near"), ",").alias("first_near"),
    )


@query(
    "last_entity_per_name",
    """SELECT name, max(key) AS ord, arg_max(price, key) FILTER (true) AS price0, CAST(arg_max(CAST(rating * 10 AS BIGINT), key) AS BIGINT) AS rating10
FROM (SELECT p_name AS name, p_partkey AS key, p_retailprice AS price, p_size / 10.0 AS rating FROM part) GROUP BY name""",
)
def _(spark, sf):
    from colloquy.sources.readers import last_per_name

    p = V.table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("price0"),
        F.col("p_size").cast("bigint").alias("rating10"),
    )
    return last_per_name(p)


def trips(spark, sf):
    """Part names' second words travel between suppliers: customer rows as trips between name pieces."""
    c = V.table(spark, sf, "customer")
    piece = lambda k: F.format_string("%04d", k)
    return c.select(
        F.col("c_custkey").alias("query_id"),
        F.when(F.col("c_custkey") % 9 == 0, "").otherwise(piece(F.col("c_custkey") % 120)).alias("origin"),
        F.when(F.col("c_custkey") % 7 == 0, "Supp").otherwise(piece(F.col("c_nationkey"))).alias("destination"),
    )


_TRIPS = """WITH trips AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE printf('%04d', c_custkey % 120) END AS origin,
 CASE WHEN c_custkey % 7 = 0 THEN 'Supp' ELSE printf('%04d', c_nationkey) END AS destination FROM customer)
"""


@query(
    "station_lookup",
    _TRIPS + """, r AS (SELECT query_id, '起点' AS role, origin AS needle FROM trips WHERE origin <> '' AND destination <> ''
 UNION ALL SELECT query_id, '终点', destination FROM trips WHERE origin <> '' AND destination <> ''),
d AS (SELECT needle, min(s_suppkey) AS k FROM (SELECT DISTINCT needle FROM r) JOIN supplier ON contains(s_name, needle) GROUP BY needle)
SELECT query_id, role, '(' || role || ') ' || s_name AS name, 'st' || (s_suppkey % 7) AS station
FROM r JOIN d ON d.needle = r.needle JOIN supplier ON s_suppkey = k""",
)
def _(spark, sf):
    s = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.concat(F.lit("st"), F.col("s_suppkey") % 7).alias("station")
    )
    return N.station_lookup(trips(spark, sf), s)


@query(
    "taxi_lookup",
    _TRIPS + "SELECT query_id, '出租 (' || origin || ' - ' || destination || ')' AS name, '#CX' AS car, '#CP' AS plate FROM trips WHERE origin <> '' AND destination <> ''",
)
def _(spark, sf):
    return N.taxi_lookup(trips(spark, sf))


@query(
    "price_bands",
    """WITH p AS (SELECT CAST(floor(p_retailprice) AS BIGINT) + p_size * 4 - 100 AS price FROM part WHERE p_partkey % 17 <> 0),
b AS (SELECT unnest([100, 200, 300, 400, 500, 600, 700, 800, 900]) AS lo)
SELECT lo || '-' || (lo + 100) || '元' AS band, count(price) AS n FROM b LEFT JOIN p ON price BETWEEN lo AND lo + 100 GROUP BY lo
UNION ALL SELECT '1000元以上', count(*) FILTER (price > 1000) FROM p""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 17 != 0, F.floor("p_retailprice") + F.col("p_size") * 4 - 100).alias("price")
    )
    return N.band_counts(p, "price")


@query(
    "attribute_weights",
    """SELECT 'rating' AS attribute, CAST(p_size AS VARCHAR) AS item, count(*) AS weight FROM part GROUP BY p_size
UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest(tags) AS t FROM v_entities) GROUP BY t
UNION ALL SELECT 'name', name, 1 FROM (SELECT DISTINCT p_name AS name FROM part)""",
    ("v_entities",),
)
def _(spark, sf):
    e = V.table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("name"),
        F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("tags"),
    )
    tag = lambda d, a: d.select(F.lit(a).alias("attribute"), "item", "weight")
    return tag(N.attribute_weights(e, "size"), "rating").unionByName(tag(N.item_weights(e, "tags"), "tags")).unionByName(
        tag(N.constant_weights(e, "name"), "name")
    )


@query(
    "cooccurrence",
    """WITH x AS (SELECT l_orderkey, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT item FROM x GROUP BY item HAVING count(*) > 1)
SELECT DISTINCT a.item, b.item AS other FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item WHERE a.item IN (SELECT item FROM c)""",
)
def _(spark, sf):
    return L.cooccurrence(basket_items(spark, sf), "l_orderkey", "p_name")


@query(
    "edge_weights",
    """WITH x AS (SELECT DISTINCT l_orderkey, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT item, count(*) AS c FROM x GROUP BY item), t AS (SELECT count(DISTINCT l_orderkey) AS t FROM x),
n AS (SELECT a.item, b.item AS other, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.item < b.item GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT n.item, other, n, round(ln(n * CAST(t AS DOUBLE) / (CAST(c.c AS DOUBLE) * CAST(d.c AS DOUBLE))), 6) AS pmi
 FROM n JOIN c ON c.item = n.item JOIN c d ON d.item = other, t) WHERE pmi > 0""",
)
def _(spark, sf):
    return L.edge_weights(basket_items(spark, sf), "l_orderkey", "p_name")


@query(
    "label_edges",
    r"""WITH x AS (SELECT id, label, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS token FROM v_labelled),
k AS (SELECT token, count(DISTINCT id) AS k FROM x GROUP BY token HAVING count(DISTINCT id) >= 2), t AS (SELECT count(DISTINCT id) AS t FROM x)
SELECT x.token, label, count(*) AS n, round(count(*) * ln(any_value(t) / any_value(k)), 6) AS weight FROM x JOIN k ON k.token = x.token, t GROUP BY x.token, label""",
    ("v_labelled",),
)
def _(spark, sf):
    d = V.labelled(spark, sf).select("id", "label", F.explode(V.words(F.col("text"))).alias("token"))
    return L.label_edges(d, "token", "label", "id")


def basket_items(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return li.join(p, "l_partkey").select("l_orderkey", "p_name")


@query(
    "kb_type_values",
    """WITH t AS (SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'R_rating' WHEN p_partkey % 3 = 1 THEN 'R_type' ELSE 'R_brand' END AS relation,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_type ELSE p_brand END AS value FROM part)
SELECT type, value, min(ord) AS first FROM (SELECT 'R_restaurant' AS type, name AS value, ord FROM t UNION ALL SELECT relation, value, ord FROM t) GROUP BY type, value""",
)
def _(spark, sf):
    return L.kb_type_values(kb_triples(spark, sf))


def kb_triples(spark, sf):
    k = F.col("p_partkey") % 3
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"),
        F.when(k == 0, "R_rating").when(k == 1, "R_type").otherwise("R_brand").alias("relation"),
        F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.col("p_type")).otherwise(F.col("p_brand")).alias("value"),
    )


def placeholder_acts(spark, sf):
    """Numbered placeholder acts over the named slots, one query per session and turn."""
    a = V.named_acts(spark, sf).filter("role = 'sys'")
    span = F.col("intent").isin("Inform", "Recommend")
    return a.select(
        "session_id", "pos", F.col("act_ord").alias("ord"), "intent", "domain", "slot",
        F.when(span & (F.col("slot").contains("周边") | F.col("slot").isin("推荐菜", "名称")), (F.col("k") % 4 + 1).cast("string"))
        .when(span, "1").otherwise(F.col("value")).alias("value"),
        # the talk has moved on in some turns
        F.when((F.col("session_id") + F.col("pos")) % 6 == 0, "酒店").otherwise(F.col("domain")).alias("cur_domain"),
    ).filter(F.col("intent").isin("Inform", "Recommend", "General", "NoOffer"))


def ranked_results(spark, sf):
    """Each query sees up to three parts of its session as results."""
    q = placeholder_acts(spark, sf).select("session_id", "pos").distinct()
    r = q.select("session_id", "pos", F.explode(F.sequence(F.lit(0), (F.col("pos") % 4).cast("int") - 1)).alias("rank")).filter("rank >= 0 and pos % 4 > 0")
    e = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.create_map(
            F.lit("门票"), F.col("p_size").cast("string"), F.lit("评分"), (F.col("p_size") / F.lit(10.0)).cast("string"),
            F.lit("价格"), F.col("p_size").cast("string"), F.lit("人均消费"), F.col("p_size").cast("string"),
            F.lit("游玩时间"), F.col("p_type"), F.lit("酒店类型"), F.col("p_type"), F.lit("名称"), F.col("p_name"),
            F.lit("车型"), F.lit("#CX"), F.lit("车牌"), F.lit("#CP"), F.lit("地铁"), F.col("p_brand"),
        ).alias("scalars"),
        F.create_map(
            F.lit("周边景点"), F.split("p_name", " "), F.lit("周边餐馆"), F.array("p_brand"), F.lit("周边酒店"), F.array("p_type", "p_brand"),
            F.lit("推荐菜"), F.array(F.lit("老字号"), F.col("p_type"), F.lit("其他"), F.col("p_brand")),
            F.lit("酒店设施"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("叫醒服务"))).otherwise(F.array(F.lit("吹风机"))),
        ).alias("lists"),
    )
    end = F.when(F.col("rank") == 0, "(起点) ").when(F.col("rank") == 1, "(终点) ").otherwise("")
    return r.withColumn("key", F.col("session_id") + F.col("rank")).join(e, "key").select(
        "session_id", "pos", "rank", F.concat(end, "name").alias("name"), "scalars", "lists"
    )


@query(
    "lexicalize_acts",
    """WITH a AS (SELECT session_id, pos, act_ord AS ord, intent, domain, slot,
 CASE WHEN intent IN ('Inform', 'Recommend') AND (contains(slot, '周边') OR slot IN ('推荐菜', '名称')) THEN CAST(k % 4 + 1 AS VARCHAR)
  WHEN intent IN ('Inform', 'Recommend') THEN '1' ELSE value END AS value
 FROM v_named WHERE role = 'sys' AND intent IN ('Inform', 'Recommend', 'General', 'NoOffer')
  AND (intent IN ('General', 'NoOffer') OR (session_id + pos) % 6 <> 0 OR domain = '酒店')),
n AS (SELECT *, pos % 4 AS size, CASE WHEN intent IN ('Inform', 'Recommend') THEN CAST(value AS BIGINT) - 1 END AS i FROM a),
j AS (SELECT n.*, p.p_name AS first_name, CASE i WHEN 0 THEN '(起点) ' WHEN 1 THEN '(终点) ' ELSE '' END || q.p_name AS nth_name, p2.p_brand AS second_brand, p.p_size, p.p_type, p.p_brand, p.p_partkey FROM n
 LEFT JOIN part p ON size > 0 AND p.p_partkey = session_id LEFT JOIN part q ON i < size AND q.p_partkey = session_id + i
 LEFT JOIN part p2 ON size > 1 AND p2.p_partkey = session_id + 1),
v AS (SELECT session_id, pos, ord, intent, domain, slot, size, i, CASE
 WHEN intent IN ('General', 'NoOffer') THEN value
 WHEN domain = '地铁' THEN coalesce(CASE WHEN slot IN ('出发地附近地铁站', '出发地') THEN p_brand ELSE second_brand END, '无')
 WHEN domain = '出租' AND slot = '名称' THEN first_name
 WHEN domain = '出租' THEN CASE WHEN size > 0 AND slot = '车型' THEN '#CX' WHEN size > 0 AND slot = '车牌' THEN '#CP' END
 WHEN intent = 'Recommend' THEN nth_name
 WHEN slot = '周边景点' THEN string_split(first_name, ' ')[i + 1] WHEN slot = '周边餐馆' THEN CASE WHEN i = 0 THEN p_brand END
 WHEN slot = '周边酒店' THEN [p_type, p_brand][i + 1]
 WHEN slot = '推荐菜' THEN coalesce([p_type, p_brand][i + 1], CAST(i AS VARCHAR))
 WHEN contains(slot, '酒店设施') THEN CASE WHEN (p_partkey % 2 = 0) = (slot = '酒店设施-叫醒服务') THEN '是' ELSE '否' END
 WHEN slot IN ('门票', '价格', '人均消费') THEN p_size || '元' WHEN slot = '评分' THEN CAST(p_size / 10.0 AS VARCHAR) || '分'
 WHEN slot IN ('游玩时间', '酒店类型') THEN p_type WHEN slot = '名称' THEN first_name END AS value FROM j)
SELECT session_id, pos, ord, intent, domain, slot, value FROM v WHERE intent IN ('General', 'NoOffer') OR domain IN ('出租', '地铁')
 OR (size > i AND NOT (intent = 'Recommend' AND value IS NULL) AND NOT (contains(slot, '周边') AND value IS NULL))""",
    ("v_named",),
)
def _(spark, sf):
    return N.lexicalize(placeholder_acts(spark, sf), ranked_results(spark, sf), keys=("session_id", "pos"))
