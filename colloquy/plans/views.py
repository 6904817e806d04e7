"""Dialogue-shaped inputs derived from the generic tables.

The tables hold no dialogue acts, so each view maps their columns onto the data
model (sessions, acts, entities, goals, scores). ``oracle_views`` states the same
views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy import constants as K
from colloquy.operators.ordered import dense_position

ACT = ("intent", "domain", "slot", "value")

# slot names a domain cycles through in the named view
NAMED_SLOTS = {
    "景点": ("名称", "门票", "游玩时间", "评分", "周边景点", "周边餐馆", "周边酒店"),
    "餐馆": ("名称", "推荐菜", "人均消费", "评分", "周边景点", "周边酒店", "推荐菜"),
    "酒店": ("名称", "酒店类型", "酒店设施-叫醒服务", "价格", "评分", "周边餐馆", "酒店设施-吹风机"),
    "地铁": ("出发地", "目的地", "出发地附近地铁站", "目的地附近地铁站", "出发地", "目的地", "出发地"),
    "出租": ("出发地", "目的地", "车型", "车牌", "出发地", "目的地", "车型"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(col):
    """Whitespace tokens without empties."""
    return F.filter(F.split(col, r"\s+"), lambda t: t != "")


def _numbered_turns(rows):
    t = rows.select(
        F.col("conv_id").alias("session_id"),
        "turn",
        F.when(F.col("role") == "user", "usr").when(F.col("role") == "system", "note").otherwise("sys").alias("role"),
        F.col("text").alias("content"),
    )
    return dense_position(t, ["session_id"], ["turn"], F.expr("turn div 1024")).drop("turn")


def turns(spark, sf):
    """Every row of the conversations; instructions have the role ``note``."""
    return _numbered_turns(table(spark, sf, "conversations"))


def exchanges(spark, sf):
    """The turns of the two speakers, numbered without the instructions: for operators that pair speakers."""
    return _numbered_turns(table(spark, sf, "conversations").filter("role <> 'system'"))


def _numbered_events(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("session_id"),
        "event_type",
        F.floor(F.col("value") / 10).alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return dense_position(e, ["session_id"], ["ts", "event_id"], F.to_date("ts"), out="n")


def _placed(e):
    return e.withColumn("pos", F.expr("n div 3")).withColumn("act_ord", F.expr("n % 3")).withColumn(
        "role", F.when(F.col("pos") % 2 == 0, "usr").otherwise("sys")
    )


def _intent():
    return (
        F.when(F.col("event_type") == "click", "Inform")
        .when(F.col("event_type") == "view", "Request")
        .when(F.col("event_type") == "purchase", "Recommend")
        .when(F.col("event_type") == "error", "NoOffer")
        .otherwise("Select")
    )


def acts(spark, sf):
    """One row per act: d0..d4 domains, s0..s6 slots."""
    return _placed(_numbered_events(spark, sf)).select(
        "session_id",
        "pos",
        "act_ord",
        "role",
        _intent().alias("intent"),
        F.concat(F.lit("d"), F.col("k") % 5).alias("domain"),
        F.concat(F.lit("s"), F.col("k") % 7).alias("slot"),
        F.concat(F.lit("v"), F.col("v")).alias("value"),
        "event_id",
        "ts",
        "n",
        "k",
    )


def named_acts(spark, sf):
    """One row per act with the real domain, slot and marker names."""
    e = _placed(_numbered_events(spark, sf)).withColumn("intent0", _intent())
    domain = F.get(F.array(*[F.lit(d) for d in K.DOMAINS]), (F.col("k") % 5).cast("int"))
    e = e.withColumn("domain0", domain)
    slot = F.coalesce(
        *[
            F.when(F.col("domain0") == d, F.get(F.array(*[F.lit(s) for s in s7]), (F.col("k") % 7).cast("int")))
            for d, s7 in NAMED_SLOTS.items()
        ]
    )
    e = e.withColumn("slot0", slot)
    general = (F.col("intent0") == "Select") & (F.col("k") % 4 == 0)
    i = F.col("intent0")
    intent = F.when(general, "General").otherwise(i)
    dom = F.when(general, F.when(F.col("role") == "usr", "greet").otherwise("thank")).otherwise(F.col("domain0"))
    slot = (
        F.when(general | (i == "NoOffer"), "none")
        .when(i == "Select", K.SOURCE_DOMAIN)
        .when(i == "Recommend", K.NAME)
        .otherwise(F.col("slot0"))
    )
    v = F.col("v")
    value = (
        F.when(general | (i == "NoOffer"), "none")
        .when(i == "Select", F.get(F.array(*[F.lit(d) for d in K.DOMAINS[:4]]), (v % 4).cast("int")))
        .when(i == "Request", "")
        .when(i == "Recommend", F.concat(F.lit("v"), v))
        .when(F.col("slot0").contains(K.FACILITY), F.when(v % 2 == 0, K.YES).otherwise(K.NO))
        .when((F.col("slot0") == K.TICKET_SLOT) & (v % 5 == 0), K.FREE)
        .when(v == 7, K.ABSENT)
        .otherwise(F.concat(F.lit("v"), v))
    )
    return e.select(
        "session_id", "pos", "act_ord", "role", intent.alias("intent"), dom.alias("domain"), slot.alias("slot"),
        value.alias("value"), "event_id", "ts", "n", "k",
    )


def act_turns(act_rows, acts_col="acts", extra=()):
    """Turn rows holding their acts in order (a turn has a handful of acts)."""
    return act_rows.groupBy("session_id", "pos", "role", *extra).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("act_ord", F.struct(*ACT).alias("act")))), lambda x: x["act"]
        ).alias(acts_col)
    )


def predgold(spark, sf, source=None):
    """Turn rows with gold acts and a systematically perturbed copy as prediction."""
    a = (source or acts)(spark, sf)
    act = F.struct(*ACT)
    changed = F.struct(
        "intent",
        "domain",
        "slot",
        F.when(F.col("event_id") % 7 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")).alias("value"),
    )
    copies = F.when(F.col("event_id") % 11 == 0, 0).when(F.col("event_id") % 13 == 0, 2).otherwise(1)
    return (
        a.select("session_id", "pos", "role", "act_ord", act.alias("act"), F.array_repeat(changed, copies).alias("p"))
        .groupBy("session_id", "pos", "role")
        .agg(F.array_sort(F.collect_list(F.struct("act_ord", "act", "p"))).alias("_t"))
        .select(
            "session_id",
            "pos",
            "role",
            F.transform("_t", lambda x: x["act"]).alias("gold"),
            F.flatten(F.transform("_t", lambda x: x["p"])).alias("pred"),
            F.concat(F.lit("g"), F.col("session_id") % 5).alias("goal_type"),
        )
    )


def entities(spark, sf):
    """Entity rows: typed scalars plus list attributes (tags, near)."""
    part = table(spark, sf, "part")
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    names = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    near = (
        pairs.join(names, pairs.l_suppkey == names.s_suppkey)
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sort_array(F.collect_set("s_name")).alias("near"))
    )
    return part.join(near, "p_partkey", "left").select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")).alias("price"),
        (F.col("p_size") / F.lit(10.0)).alias("rating"),
        F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("tags"),
        F.coalesce("near", F.array().cast("array<string>")).alias("near"),
    )


def beliefs_for_search(spark, sf):
    """One belief row per part: (query_id, slot, value) strings as a tracker would leave them."""
    p = table(spark, sf, "part")
    lo = F.floor("p_retailprice")
    kind = F.col("p_partkey") % 6
    word = F.split("p_name", " ")
    near = F.format_string("Supplier#%09d", F.col("p_partkey") % 100)
    rows = F.array(
        F.struct(F.lit("price").alias("slot"), F.when(kind == 0, F.concat(lo, F.lit("-"), lo + 1, F.lit("元")))
                 .when(kind == 1, F.concat(lo + 99, F.lit("以上"))).when(kind == 2, F.lit("便宜")).otherwise("").alias("value")),
        F.struct(F.lit("rating").alias("slot"), F.when(kind.isin(2, 3), F.lit("4.5分以上")).when(kind == 1, F.lit("高")).otherwise("").alias("value")),
        F.struct(F.lit("tags").alias("slot"), F.when(kind.isin(1, 4), F.concat(F.get(word, F.lit(0)), F.lit("  "), F.col("p_brand"))).otherwise("").alias("value")),
        F.struct(F.lit("near").alias("slot"), F.when(kind.isin(2, 3), near).otherwise("").alias("value")),
        F.struct(F.lit("name").alias("slot"), F.when(kind == 5, F.col("p_name")).otherwise("").alias("value")),
    )
    return p.select(F.col("p_partkey").alias("query_id"), F.inline(rows))


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    l = table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"),
        "text",
        "lang",
        "source",
        F.when(F.col("quality") + 2 * F.col("toxic") == 0, "other")
        .otherwise(F.concat(F.lit("c"), F.col("quality") + 2 * F.col("toxic")))
        .alias("label"),
        F.when(F.md5(F.col("doc_id").cast("string")) < "c", "train").otherwise("test").alias("split"),
    )


def scores(spark, sf):
    """Two systems' class scores over ten labels, folded from all dimensions.

    Dimension i counts for class i % 10: of the first system in even rows of ten, of the second in odd ones.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))

    def folded(half):
        mine = lambda c: F.filter(v, lambda x, i: (i % 10 == c) & (F.floor(i / 10) % 2 == half))
        return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(mine(c), F.lit(0.0), lambda a, x: a + x))

    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        folded(0).alias("trs"),
        folded(1).alias("asr"),
    )


def pairs(spark, sf):
    """Turn text as hypothesis and the following turn as reference."""
    t = turns(spark, sf)
    nxt = t.select("session_id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("ref"))
    return t.join(nxt, ["session_id", "pos"]).select(
        "session_id",
        "pos",
        "role",
        F.col("content").alias("hyp"),
        "ref",
        F.concat("role", F.col("session_id") % 20).alias("act_key"),
    )


def nbest(spark, sf):
    """Turns of a conversation as ranked hypotheses with two scores."""
    return turns(spark, sf).select(
        F.col("session_id").alias("utt_id"),
        F.col("pos").alias("rank"),
        "content",
        words(F.col("content")).alias("tokens"),
        ((F.length("content") % 7) / F.lit(7.0)).alias("am"),
        ((F.length("content") % 11) / F.lit(11.0)).alias("lm"),
    )


def subgoals(spark, sf):
    """Order lines as sub-goals of a goal; some lines refer to an earlier line."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax"
    )
    li = dense_position(
        li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        F.expr("l_linenumber div 64"), out="id", start=1,
    )
    raw = F.get(F.array(*[F.lit(d) for d in K.DOMAINS]), (F.col("l_partkey") % 5).cast("int"))
    moving = raw.isin(*K.TRANSPORT)
    domain = F.when(moving & (F.col("id") < 3), F.lit(K.HOTEL)).otherwise(raw)
    li = li.withColumn("domain", domain)
    hop = ~F.col("domain").isin(*K.TRANSPORT) & (F.col("id") > 2) & (F.col("l_suppkey") % 3 == 0)
    ref = F.when(hop, F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(2))
    return li.select(
        F.col("l_orderkey").alias("goal_id"),
        "id",
        "domain",
        ref.alias("ref"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
    )


def said(spark, sf):
    """Named act turns with an utterance that mentions most of the act values."""
    a = named_acts(spark, sf)
    surface = F.when(F.col("slot").contains(K.FACILITY), F.get(F.split("slot", "-"), F.lit(1))).otherwise(F.col("value"))
    a = a.withColumn("phrase", F.when(F.col("event_id") % 17 == 0, "好的").otherwise(F.concat(F.lit("我要 "), surface, F.lit(" 吧"))))
    return a.groupBy("session_id", "pos", "role").agg(
        F.array_sort(F.collect_list(F.struct("act_ord", F.struct(*ACT).alias("act"), "phrase"))).alias("_t")
    ).select(
        "session_id", "pos", "role", F.transform("_t", lambda x: x["act"]).alias("acts"),
        F.array_join(F.transform("_t", lambda x: x["phrase"]), "，").alias("content"),
    )


def goals(spark, sf):
    """Goal rows: ``subs`` array of sub-goals with constraints and requests."""
    from colloquy.operators.goals import constraint as con

    g = subgoals(spark, sf)
    moving = F.col("domain").isin(*K.TRANSPORT)
    d, ref = F.col("domain"), F.col("ref")
    name = F.when(ref.isNotNull(), F.concat(F.lit("出现在id="), ref.cast("string"), F.lit("的周边"), d, F.lit("里"))).when(
        ~moving & (F.col("qty") % 4 == 0), F.concat(F.lit("n"), F.col("qty"))
    )
    rating = F.when(~moving & (F.col("disc") >= 5), F.concat(F.col("disc"), F.lit("分以上")))
    dishes = F.when((d == K.RESTAURANT) & (F.col("disc") % 2 == 1), F.array(F.lit("菜a"), F.concat(F.lit("菜b"), F.col("qty"))))
    cons = F.filter(
        F.array(
            F.when(name.isNotNull(), con(K.NAME, F.array(name))),
            F.when(rating.isNotNull(), con(K.RATING, F.array(rating))),
            F.when(dishes.isNotNull(), con(K.DISH, dishes, True)),
            F.when(moving, con(K.ORIGIN_SLOT, F.array(F.lit("id=1")))),
            F.when(moving, con(K.DESTINATION_SLOT, F.array(F.lit("id=2")))),
        ),
        lambda x: x.isNotNull(),
    )
    reqs = F.filter(
        F.array(F.when(moving, "车型").otherwise("地址"), F.when(~moving & (F.col("tax") % 2 == 1), "周边景点")),
        lambda x: x.isNotNull(),
    )
    method = F.when(moving, "交通").when(ref.isNull(), K.STANDALONE).otherwise(F.concat(F.lit("id="), ref.cast("string"), F.lit("的周边")))
    sub = F.struct(
        F.col("id").cast("int").alias("id"), "domain", method.alias("method"), F.col("ref").cast("int").alias("ref"),
        cons.alias("constraints"), reqs.alias("requests"),
    )
    return g.select("goal_id", sub.alias("sub")).groupBy("goal_id").agg(F.array_sort(F.collect_list("sub")).alias("subs"))
