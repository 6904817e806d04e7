"""Queries over labelled texts, class scores, vectors and belief records."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import encode as E, features as Fe
from colloquy.operators import filters as Fi, lookups as L, metrics as M, sampling as Sa, vectors as Ve, vocab as Vo
from colloquy.operators.staging import stage
from colloquy.plans import views as V
from colloquy.plans.registry import query
from colloquy.sources import readers as R, writers as Wr

_L = ("v_labelled",)

# -- lines as they would lie in a file ---------------------------------------------------------

_TSV = r"""
WITH ln AS (SELECT id, '  ' || id || chr(9) || CASE WHEN id % 13 = 0 THEN '' ELSE regexp_replace(text, '\t', ' ', 'g') END || chr(9) ||
 CASE WHEN id % 17 = 0 THEN '' ELSE label END || CASE WHEN id % 19 = 0 THEN chr(9) || 'more' ELSE '' END || ' ' AS value FROM v_labelled),
f AS (SELECT id, string_split(regexp_replace(value, '^\s+|\s+$', '', 'g'), chr(9)) AS f FROM ln)
"""


def tsv_lines(spark, sf):
    d = V.labelled(spark, sf)
    i = F.col("id")
    return d.select(
        "id",
        F.concat(
            F.lit("  "), i, F.lit("\t"), F.when(i % 13 == 0, "").otherwise(F.regexp_replace("text", "\t", " ")), F.lit("\t"),
            F.when(i % 17 == 0, "").otherwise(F.col("label")), F.when(i % 19 == 0, "\tmore").otherwise(""), F.lit(" "),
        ).alias("value"),
    )


@query("labelled_rows", _TSV + "SELECT id, f[3] AS label, f[2] AS text FROM f WHERE len(f) = 3 AND f[2] <> ''", _L)
def _(spark, sf):
    r = R.labelled_rows(tsv_lines(spark, sf), 3, order=(2, 1))
    return r.select("id", F.col("f2").alias("label"), F.col("f1").alias("text"))


@query(
    "label_text_rows",
    r"""WITH ln AS (SELECT id, regexp_replace(text || ' ' || label || '  ', '^\s+|\s+$', '', 'g') AS l FROM v_labelled),
f AS (SELECT id, l, string_split(l, ' ') AS f FROM ln)
SELECT id, f[len(f)] AS label, regexp_replace(substr(l, 1, length(l) - length(f[len(f)])), '^\s+|\s+$', '', 'g') AS text FROM f WHERE len(f) >= 2""",
    _L,
)
def _(spark, sf):
    d = V.labelled(spark, sf).select("id", F.concat("text", F.lit(" "), "label", F.lit("  ")).alias("value"))
    return R.label_text_rows(d)


@query(
    "asr_pairs",
    r"""SELECT session_id, pos, hyp0 AS asr, ref0 AS transcript, act_key AS label FROM (SELECT *, regexp_replace(hyp, '[\t\n]', ' ', 'g') AS hyp0, regexp_replace(ref, '[\t\n]', ' ', 'g') AS ref0 FROM v_pairs)""",
    ("v_pairs",),
)
def _(spark, sf):
    p = V.pairs(spark, sf)
    flat = lambda c: F.regexp_replace(c, "[\t\n]", " ")
    lines = p.select("session_id", "pos", F.concat_ws("\t", F.lit("u"), flat("ref"), F.lit("-"), flat("hyp"), "act_key").alias("value"))
    return R.asr_pair_rows(lines)


@query(
    "score_rows",
    """SELECT id, CAST(id AS VARCHAR) AS key, CAST(len(trs) AS BIGINT) AS n, round(trs[1], 6) AS first, round(trs[10], 6) AS last FROM v_scores""",
    ("v_scores",),
)
def _(spark, sf):
    s = V.scores(spark, sf)
    lines = s.select("id", F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("trs", lambda x: x.cast("string")), "\t")).alias("value"))
    r = R.score_rows(lines)
    return r.select("id", "key", F.size("scores").cast("bigint").alias("n"), F.round(F.get("scores", F.lit(0)), 6).alias("first"), F.round(F.get("scores", F.lit(9)), 6).alias("last"))


@query("label_vocabulary", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM v_labelled)", _L)
def _(spark, sf):
    return Vo.numbered(V.labelled(spark, sf).select("label").distinct(), "label", chunk=F.substring("label", 1, 16))


# -- filters and class balance ---------------------------------------------------------------------


@query(
    "cap_label",
    "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM v_labelled) WHERE label <> 'other' OR rn <= 20",
    _L,
)
def _(spark, sf):
    return Fi.cap_label(V.labelled(spark, sf).select("id", "label"), "label", "other", 20, "id", F.floor(F.col("id") / 4096))


@query("drop_unknown_labels", "SELECT id, label FROM v_labelled WHERE label IN (SELECT label FROM v_labelled GROUP BY label HAVING count(*) > 20)", _L)
def _(spark, sf):
    d = V.labelled(spark, sf).select("id", "label")
    known = d.groupBy("label").count().filter("count > 20").select("label")
    return Fi.drop_unknown_labels(d, known)


@query("label_weight", "WITH c AS (SELECT label, count(*) AS n FROM v_labelled GROUP BY label) SELECT label, n, round(1 - n / (SELECT sum(n) FROM c), 6) AS weight FROM c", _L)
def _(spark, sf):
    return Vo.label_weight(V.labelled(spark, sf), "label")


@query("seeded_shuffle", "SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS rank FROM v_labelled WHERE split = 'train'", _L)
def _(spark, sf):
    return Sa.seeded_shuffle(V.labelled(spark, sf).filter("split = 'train'").select("id"), "id")


@query(
    "prepared_corpus",
    "SELECT id, label, 'T' AS part FROM v_labelled WHERE split = 'train' UNION ALL SELECT id, label, unnest(['D', 'E']) FROM v_labelled WHERE split = 'test'",
    _L,
)
def _(spark, sf):
    d = V.labelled(spark, sf).select("id", "label", "split")
    return Wr.prepared_corpus(d.filter("split = 'train'"), d.filter("split = 'test'")).drop("split")


@query(
    "batch_assign",
    """SELECT e AS epoch, id, (row_number() OVER (PARTITION BY e ORDER BY md5('0|' || e || '|' || id), id) - 1) // 32 AS batch
FROM v_labelled, (SELECT unnest([0, 1, 2]) AS e)""",
    _L,
)
def _(spark, sf):
    return Sa.batch_assign(V.labelled(spark, sf).select("id"), "id", 32, 3)


@query("batch_assign_in_order", "SELECT 0 AS epoch, id, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM v_labelled", _L)
def _(spark, sf):
    return Sa.batch_assign(V.labelled(spark, sf).select("id"), "id", 32, shuffle=False, chunk=F.expr("id div 4096"))


@query(
    "balanced_resample",
    """WITH m AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || id), id) AS m FROM v_labelled),
s AS (SELECT label, count(*) AS size FROM v_labelled GROUP BY label), l AS (SELECT list(label ORDER BY label) AS ls, list(size ORDER BY label) AS ss FROM s),
n AS (SELECT count(*) AS n FROM v_labelled),
d AS (SELECT draw, CAST('0x' || substr(md5('0a|' || draw), 1, 13) AS BIGINT) / 4503599627370496.0 AS a, CAST('0x' || substr(md5('0b|' || draw), 1, 13) AS BIGINT) / 4503599627370496.0 AS b
 FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS draw)),
p AS (SELECT draw, ls[CAST(floor(a * len(ls)) AS BIGINT) + 1] AS label, CAST(floor(b * ss[CAST(floor(a * len(ls)) AS BIGINT) + 1]) AS BIGINT) + 1 AS m FROM d, l)
SELECT p.draw, p.label, m.id FROM p JOIN m ON m.label = p.label AND m.m = p.m""",
    _L,
)
def _(spark, sf):
    d = V.labelled(spark, sf).select("id", "label")
    return Sa.balanced_resample(d, "label", d.count(), "id")


@query(
    "weighted_choice",
    """WITH w AS (SELECT p_type AS item, count(*) AS w FROM part GROUP BY p_type), c AS (SELECT item, sum(w) OVER (ORDER BY item) AS hi, sum(w) OVER () AS total FROM w),
d AS (SELECT c_custkey AS draw, CAST('0x' || substr(md5('0|' || c_custkey), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM customer)
SELECT draw, arg_min(item, hi) AS item FROM d, c WHERE u * total < hi GROUP BY draw""",
)
def _(spark, sf):
    from colloquy.operators.entities import attribute_weights

    w = attribute_weights(V.table(spark, sf, "part").select("p_type"), "p_type")
    draws = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("draw"))
    return Sa.weighted_choice(w, draws)


@query(
    "pad_or_cut",
    r"""SELECT id, array_to_string(list_resize(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:40], 40, '<PAD>'), ' ') AS padded,
 array_to_string(list_resize(string_split(text, ' ')[1:40], 40, '<PAD>'), ' ') AS padded_single FROM v_labelled""",
    _L,
)
def _(spark, sf):
    return V.labelled(spark, sf).select(
        "id", F.array_join(E.pad_or_cut(V.words(F.col("text")), 40, "<PAD>"), " ").alias("padded"),
        F.array_join(E.pad_or_cut(F.split("text", " "), 40, "<PAD>"), " ").alias("padded_single"),
    )


@query("one_hot", "SELECT id, array_to_string(list_transform(['c1', 'c2', 'c3', 'other'], lambda l: CASE WHEN l = label THEN 1 ELSE 0 END), '') AS vec FROM v_labelled", _L)
def _(spark, sf):
    return V.labelled(spark, sf).select("id", F.array_join(E.one_hot("label", ["c1", "c2", "c3", "other"]), "").alias("vec"))


# -- class scores -------------------------------------------------------------------------------------

_SC = ("v_scores",)
_ARG = "list_position({0}, list_max({0})) - 1"
_SOFT = "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"


@query("accuracy", f"SELECT count(*) AS n, round(avg(CASE WHEN {_ARG.format('trs')} = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_scores", _SC)
def _(spark, sf):
    return M.accuracy(V.scores(spark, sf), "trs", "label")


_REPORT = f"""WITH p AS (SELECT CASE WHEN label = 0 THEN 'other' ELSE 'l' || label END AS e, CASE WHEN {_ARG.format('trs')} = 0 THEN 'other' ELSE 'l' || ({_ARG.format('trs')}) END AS a FROM v_scores)
"""


def named_scores(spark, sf):
    name = lambda c: F.when(c == 0, "other").otherwise(F.concat(F.lit("l"), c))
    return V.scores(spark, sf).select(name(F.col("label")).alias("e"), name(M.argmax("trs")).alias("a"))


@query("label_report", _REPORT + "SELECT e AS label, count(*) AS n, round(avg(CASE WHEN e = a THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY e", _SC)
def _(spark, sf):
    return M.class_report(named_scores(spark, sf), "e", "a")[0]


@query(
    "total_report",
    _REPORT + """SELECT round(avg(CASE WHEN e = a THEN 1.0 ELSE 0.0 END), 6) AS total, round(avg(CASE WHEN e = a THEN 1.0 ELSE 0.0 END) FILTER (e <> 'other'), 6) AS business,
 round(avg(CASE WHEN e = a THEN 1.0 ELSE 0.0 END) FILTER (e = 'other'), 6) AS other, 0.6::DOUBLE AS threshold FROM p""",
    _SC,
)
def _(spark, sf):
    return M.class_report(named_scores(spark, sf), "e", "a", empty_business=1.0)[1]


@query(
    "run_metrics",
    f"SELECT 'r1' AS run_id, 1.0::DOUBLE AS e1, 0.5::DOUBLE AS e2, 0.1::DOUBLE AS e3, count(*) AS n, round(avg(CASE WHEN {_ARG.format('asr')} = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_scores",
    _SC,
)
def _(spark, sf):
    return Wr.run_metrics(M.accuracy(V.scores(spark, sf), "asr", "label"), "r1", 1.0, 0.5, 0.1)


@query(
    "softmax_argmax",
    f"SELECT id, round(({_SOFT.format('trs')})[1], 6) AS p0, round(ln(({_SOFT.format('trs')})[2]), 6) AS log1, {_ARG.format('trs')} AS best FROM v_scores",
    _SC,
)
def _(spark, sf):
    return V.scores(spark, sf).select(
        "id", F.round(F.get(M.softmax("trs"), F.lit(0)), 6).alias("p0"), F.round(F.get(M.log_softmax("trs"), F.lit(1)), 6).alias("log1"), M.argmax("trs").alias("best")
    )


@query(
    "mean_kl",
    f"""WITH s AS (SELECT {_SOFT.format('asr')} AS p, {_SOFT.format('trs')} AS q FROM v_scores)
SELECT round(avg(list_sum(list_transform(range(1, 11), lambda i: q[i] * ln(q[i] / (p[i] + 1e-10) + 1e-10)))), 6) AS floored,
 round(avg(list_sum(list_transform(range(1, 11), lambda i: q[i] * ln(q[i] / p[i])))), 6) AS plain, round(avg(list_sum(list_transform(range(1, 11), lambda i: q[i] * (ln(q[i]) - ln(p[i]))))), 6) AS log FROM s""",
    _SC,
)
def _(spark, sf):
    k = lambda f: F.round(F.avg(M.kl("asr", "trs", f)), 6).alias(f)
    return V.scores(spark, sf).agg(k("floored"), k("plain"), k("log"))


@query(
    "weighted_loss",
    f"""WITH s AS (SELECT -ln(({_SOFT.format('trs')})[label + 1]) AS t, -ln(({_SOFT.format('asr')})[label + 1]) AS a, {_SOFT.format('asr')} AS p, {_SOFT.format('trs')} AS q FROM v_scores),
m AS (SELECT avg(t) AS t, avg(a) AS a, avg(list_sum(list_transform(range(1, 11), lambda i: q[i] * ln(q[i] / (p[i] + 1e-10) + 1e-10)))) AS k FROM s)
SELECT round(t, 6) AS trs_loss, round(a, 6) AS asr_loss, round(1.0 * t + 0.5 * a + 0.1 * k, 6) AS loss FROM m""",
    _SC,
)
def _(spark, sf):
    m = V.scores(spark, sf).agg(
        F.avg(M.cross_entropy("trs", "label")).alias("t"), F.avg(M.cross_entropy("asr", "label")).alias("a"), F.avg(M.kl("asr", "trs")).alias("k")
    )
    return m.select(F.round("t", 6).alias("trs_loss"), F.round("a", 6).alias("asr_loss"), F.round(1.0 * F.col("t") + 0.5 * F.col("a") + 0.1 * F.col("k"), 6).alias("loss"))


@query(
    "masked_mean_loss",
    """SELECT round(sum(list_sum(list_transform(trs[1:CAST(id % 10 + 1 AS BIGINT)], lambda x: abs(x)))) / sum(id % 10 + 1), 6) AS loss,
 (SELECT round(sum(list_sum(list_transform(range(1, CAST(id % 10 + 2 AS BIGINT)), lambda i: least(trs[i], asr[i])))) / count(*), 6) FROM v_scores) AS coverage FROM v_scores""",
    _SC,
)
def _(spark, sf):
    s = V.scores(spark, sf).withColumn("len", (F.col("id") % 10 + 1).cast("int")).withColumn("losses", F.transform("trs", F.abs))
    return M.masked_mean_loss(s, "losses", "len").crossJoin(M.coverage_loss(s, "trs", "asr", "len").withColumnRenamed("loss", "coverage"))


@query(
    "asr_error_analysis",
    f"""SELECT {_ARG.format('trs')} = label AS first_ok, {_ARG.format('asr')} = label AS second_ok, count(*) AS n FROM v_scores GROUP BY ALL""",
    _SC,
)
def _(spark, sf):
    return M.recognition_outcomes(V.scores(spark, sf), "trs", "asr", "label").groupBy("first_ok", "second_ok").agg(F.count(F.lit(1)).alias("n"))


@query(
    "asr_error_rows",
    f"""SELECT id, label, {_ARG.format('trs')} AS first_pred, {_ARG.format('asr')} AS second_pred, {_ARG.format('trs')} = label AS first_ok, {_ARG.format('asr')} = label AS second_ok FROM v_scores""",
    _SC,
)
def _(spark, sf):
    return M.recognition_outcomes(V.scores(spark, sf), "trs", "asr", "label").drop("trs", "asr")


# -- vectors ---------------------------------------------------------------------------------------------


@query(
    "attach_vectors",
    """SELECT o.o_orderkey AS key, vec_id IS NOT NULL AS hit, round(coalesce(embedding[1], 0.0)::DOUBLE, 6) AS v0, CAST(coalesce(len(embedding), 64) AS BIGINT) AS dim FROM orders o LEFT JOIN embeddings ON vec_id = o_orderkey""",
)
def _(spark, sf):
    return attached(spark, sf).select("key", "hit", F.round(F.get("vec", F.lit(0)), 6).alias("v0"), F.size("vec").cast("bigint").alias("dim"))


@query("vector_coverage", "SELECT count(*) AS n, count(vec_id) AS hits, round(count(vec_id) / count(*) * 100, 4) AS coverage FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey")
def _(spark, sf):
    return L.coverage(attached(spark, sf))


def attached(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return L.attach_vectors(o, e, "key", 64)


@query(
    "vectors_with_extra_rows",
    "SELECT vec_id AS key, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings UNION ALL SELECT (SELECT count(*) FROM embeddings) + unnest([0, 1]), 64",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return R.with_extra_vectors(e, 64, e.count()).select("key", F.size("vec").cast("bigint").alias("dim"))


@query(
    "weighted_pool",
    """SELECT label, CAST(dim - 1 AS BIGINT) AS dim, round(sum(x * w), 6) AS value FROM (SELECT label, (vec_id % 7) / 7.0 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL""",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select("label", ((F.col("vec_id") % 7) / F.lit(7.0)).alias("w"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return Ve.weighted_pool(e, "label", "vec", "w").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "pool_hypotheses",
    """SELECT label, CAST(dim - 1 AS BIGINT) AS dim, round(max(x), 6) AS top, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL""",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    top = Ve.pool(e, "label", "vec", "max").withColumnRenamed("value", "top")
    mean = Ve.pool(e, "label", "vec", "mean").withColumnRenamed("value", "mean")
    return top.join(mean, ["label", "dim"]).select("label", F.col("dim").cast("bigint").alias("dim"), F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"))


# -- belief records -------------------------------------------------------------------------------------------

_RAW = ["guesthouse", "nigh", "4", "center", "we", "no", "t", "ch", "free", "museum", "hotel with free parking and free wifi", "3 star hotel", "cent", "any", "moderate", "norwich", "cambridge", "art"]
_SLOTS_EN = ["hotel-type", "hotel-internet", "hotel-pricerange", "hotel-star", "hotel-area", "restaurant-area", "attraction-area", "attraction-type", "train-day", "restaurant-pricerange"]


def _repair_sql():
    spelling = "CASE v0 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LABEL_SPELLING.items()) + " ELSE v0 END"
    steps = []
    for n, group in enumerate(K.LABEL_REPAIRS, 1):
        cases = ""
        for how, name, values, new in group:
            cond = f"slot = '{name}'" if how == "is" else f"contains(slot, '{name}')"
            if values is not None:
                cond += " AND v%d IN (%s)" % (n, ", ".join(f"'{v}'" for v in values))
            cases += f" WHEN {cond} THEN " + (f"v{n}" if new is None else f"'{new}'")
        steps.append(f"r{n + 1} AS (SELECT *, CASE{cases} ELSE v{n} END AS v{n + 1} FROM r{n})")
    return f", r1 AS (SELECT *, {spelling} AS v1 FROM raw), " + ", ".join(steps)


def _lit_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_RAWSQL = f"""WITH raw AS (SELECT o_orderkey AS id, {_lit_list(_SLOTS_EN)}[o_custkey % {len(_SLOTS_EN)} + 1] AS slot, {_lit_list(_RAW)}[(o_orderkey + o_custkey) % {len(_RAW)} + 1] AS v0 FROM orders)"""


def raw_labels(spark, sf):
    o = V.table(spark, sf, "orders")
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), pick(_SLOTS_EN, F.col("o_custkey")).alias("slot"), pick(_RAW, F.col("o_orderkey") + F.col("o_custkey")).alias("value"))


@query("repair_labels", _RAWSQL + _repair_sql() + " SELECT id, slot, v3 AS value FROM r3")
def _(spark, sf):
    b = raw_labels(spark, sf).withColumn("belief", F.create_map("slot", "value"))
    r = b.select("id", F.explode(Fi.repair_labels("belief", _SLOTS_EN)).alias("slot", "value"))
    return r


@query(
    "domain_filter",
    """WITH b AS (SELECT user_id, event_id, 'd' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) || '-s' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS slot, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS d FROM events),
u AS (SELECT user_id FROM b GROUP BY user_id HAVING bool_or(d = 3) AND user_id % 2 = 0)
SELECT user_id, slot, count(*) AS n FROM b WHERE user_id IN (SELECT user_id FROM u) AND contains(slot, 'd3') GROUP BY ALL
UNION ALL SELECT user_id, slot, count(*) FROM b WHERE user_id % 2 = 1 AND NOT contains(slot, 'd3') AND user_id IN (SELECT user_id FROM b GROUP BY user_id HAVING list_distinct(list(d)) <> [3]) GROUP BY ALL""",
)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = V.table(spark, sf, "events").select("user_id", F.concat(F.lit("d"), k % 5).alias("d"), F.concat(F.lit("d"), k % 5, F.lit("-s"), k % 7).alias("slot"))
    n = e.groupBy("user_id", "d", "slot").agg(F.count(F.lit(1)).alias("n"))
    dial = n.groupBy("user_id").agg(
        F.collect_set("d").alias("domains"), F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("belief")
    )
    test = Fi.domain_filter(dial.filter("user_id % 2 = 0"), exclude="d3", split="test")
    train = Fi.domain_filter(dial.filter("user_id % 2 = 1"), exclude="d3", split="train")
    return test.unionByName(train).select("user_id", F.explode("belief").alias("slot", "n"))


@query(
    "slot_gate",
    """WITH b AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS pr, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderstatus END, o_orderkey) AS st FROM orders GROUP BY o_custkey)
SELECT id, 'a-priority:' || pr || ':ptr a-status:' || st || ':' || CASE WHEN st = 'none' THEN 'none' ELSE 'ptr' END || ' a-area:none:none' AS gates FROM b""",
)
def _(spark, sf):
    g = Fe.slot_gate(["a-priority", "a-status", "a-area"], "belief")
    text = F.transform(g, lambda x: F.concat_ws(":", x["slot"], x["value"], x["gate"]))
    return order_beliefs(spark, sf).select("id", F.array_join(text, " ").alias("gates"))


def order_beliefs(spark, sf):
    o = V.table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.col("o_orderstatus"))
    b = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("pr"), F.max_by(status, "o_orderkey").alias("st"))
    return b.select("id", F.create_map(F.lit("a-priority"), "pr", F.lit("a-status"), "st").alias("belief"))


@query(
    "apply_gates",
    r"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE 'ptr' END AS g1, string_split(p_name || ' EOS tail', ' ') AS w1, CASE WHEN p_partkey % 5 = 0 THEN ['none', 'EOS'] ELSE [p_type] END AS w2 FROM part)
SELECT id, concat_ws(' ', CASE WHEN g1 = 'ptr' THEN 'x-name-' || array_to_string(w1[1:list_position(w1, 'EOS') - 1], ' ') END, CASE WHEN id % 5 <> 0 THEN 'x-type-' || w2[1] END) AS belief FROM t""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    row = lambda slot, gate, ws: F.struct(F.lit(slot).alias("slot"), gate.alias("gate"), ws.alias("words"))
    rows = F.array(
        row("x-name", F.when(F.col("p_partkey") % 4 == 0, "none").otherwise("ptr"), F.split(F.concat("p_name", F.lit(" EOS tail")), " ")),
        row("x-type", F.lit("ptr"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("none"), F.lit("EOS"))).otherwise(F.array("p_type"))),
    )
    return p.select(F.col("p_partkey").alias("id"), F.array_join(Fe.apply_gates(rows), " ").alias("belief"))


@query(
    "parse_belief",
    """SELECT o_orderkey AS id, o_orderstatus || '-' || 'prio' AS slot, o_orderpriority AS value FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat_ws("-", "o_orderstatus", F.lit(" prio "), "o_orderpriority")).alias("b"))
    return o.select("id", F.inline(Fe.parse_belief("b", ["F-prio", "O-prio"])))


@query(
    "belief_memory",
    r"""SELECT o_orderkey AS id, string_agg('o|day|t' || (i - 1) || '|' || w, ' ' ORDER BY i) AS memory FROM (SELECT o_orderkey, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
 FROM (SELECT o_orderkey, list_filter(regexp_split_to_array(o_orderpriority, '\s+'), lambda w: w <> '') AS ws FROM orders)) GROUP BY o_orderkey""",
)
def _(spark, sf):
    b = F.array(F.struct(F.lit("o").alias("domain"), F.lit("book day").alias("slot"), F.col("o_orderpriority").alias("value")))
    o = V.table(spark, sf, "orders")
    m = F.transform(Fe.belief_memory(b), lambda r: F.array_join(r, "|"))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(m, " ").alias("memory"))


@query(
    "belief_target_ids",
    r"""WITH t AS (SELECT o_orderkey AS id, list_filter(regexp_split_to_array(o_orderpriority, '\s+'), lambda w: w <> '') AS ws FROM orders),
u AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), v AS (SELECT w, 3 + row_number() OVER (ORDER BY f) AS vid FROM (SELECT w, min(id * 100 + i) AS f FROM u WHERE id % 3 = 0 GROUP BY w))
SELECT id, string_agg(CAST(coalesce(vid, 0) AS VARCHAR), ' ' ORDER BY i) || ' 2' AS ids FROM u LEFT JOIN v ON v.w = u.w GROUP BY id""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.words(F.col("o_orderpriority")).alias("tokens"))
    vocab = Vo.first_seen_vocabulary(o.filter("id % 3 = 0"), "tokens", ["id"], specials=list(K.TRACKER_SPECIALS)).select(F.col("item").alias("token"), "id")
    out = L.token_ids(o, "tokens", vocab, K.TRACKER_SPECIALS["UNK"], ["id"], append=[K.TRACKER_SPECIALS["EOS"]])
    return out.select("id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_SPLIT_SQL = "CASE WHEN session_id % 10 < 8 THEN 'train' WHEN session_id % 10 = 8 THEN 'val' ELSE 'test' END"
_PROFILE = r"""WITH t AS (SELECT 'g' || (s.session_id % 5) AS goal_type, """ + _SPLIT_SQL + r""" AS split, s.session_id, s.pos, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS w FROM v_said s),
n AS (SELECT session_id, pos, count(*) AS a, bool_or(intent = 'NoOffer') AS no, bool_or(intent = 'Select') AS se FROM v_named GROUP BY ALL),
p0 AS (SELECT goal_type, split, t.session_id, count(*) AS t, sum(len(w)) AS w, sum(a) AS a, max(CASE WHEN no THEN 1 ELSE 0 END) AS no, max(CASE WHEN se THEN 1 ELSE 0 END) AS se FROM t JOIN n ON n.session_id = t.session_id AND n.pos = t.pos GROUP BY ALL),
g AS (SELECT goal_id AS session_id, count(DISTINCT id) AS sub_goals, count(*) AS tuples, max(CASE WHEN ref IS NOT NULL THEN 1 ELSE 0 END) AS gc FROM v_tuples GROUP BY goal_id),
p AS (SELECT p0.*, coalesce(sub_goals, 0) AS sub_goals, coalesce(tuples, 0) AS tuples, coalesce(gc, 0) AS gc FROM p0 LEFT JOIN g ON g.session_id = p0.session_id),
"""
_PROFILE_COLS = """count(*) AS dialogues, CAST(sum(t) AS BIGINT) AS turns, round(avg(sub_goals), 4) AS mean_sub_goals, round(avg(tuples), 4) AS mean_tuples, round(avg(t), 4) AS mean_turns,
 round(sum(w) / sum(t), 4) AS mean_tokens, round(sum(a) / sum(t), 4) AS mean_acts, round(avg(no), 4) AS no_offer_rate, round(avg(se), 4) AS multi_query_rate, round(avg(gc), 4) AS goal_change_rate"""


def profiled(spark, sf):
    from colloquy.operators.goals import goal_tuples

    split = F.when(F.col("session_id") % 10 < 8, "train").when(F.col("session_id") % 10 == 8, "val").otherwise("test")
    t = stage(V.said(spark, sf).select(
        "session_id", "pos", "acts", V.words(F.col("content")).alias("tokens"), F.concat(F.lit("g"), F.col("session_id") % 5).alias("goal_type"), split.alias("split")
    ))
    g = V.goals(spark, sf).select(
        F.col("goal_id").alias("session_id"), F.size("subs").alias("sub_goals"), F.size(goal_tuples("subs")).alias("tuples"),
        F.exists("subs", lambda s: s["ref"].isNotNull()).cast("int").alias("goal_change"),
    )
    return t, g


@query(
    "corpus_profile",
    _PROFILE + f"""v AS (SELECT goal_type, count(DISTINCT x) AS vocabulary FROM (SELECT goal_type, unnest(w) AS x FROM t) GROUP BY goal_type)
SELECT p.goal_type, {_PROFILE_COLS}, any_value(vocabulary) AS vocabulary FROM p JOIN v ON v.goal_type = p.goal_type GROUP BY p.goal_type""",
    ("v_said", "v_tuples"),
)
def _(spark, sf):
    """By goal type; sessions without a goal count with none."""
    from colloquy.operators.profile import corpus_profile

    t, g = profiled(spark, sf)
    return corpus_profile(t, g, "goal_type")


@query(
    "corpus_profile_splits",
    _PROFILE + f"""v AS (SELECT split, goal_type, count(DISTINCT x) AS vocabulary FROM (SELECT split, goal_type, unnest(w) AS x FROM t) GROUP BY CUBE (split, goal_type)),
o AS (SELECT split, goal_type, {_PROFILE_COLS} FROM p GROUP BY CUBE (split, goal_type))
SELECT o.*, vocabulary FROM o JOIN v ON o.split IS NOT DISTINCT FROM v.split AND o.goal_type IS NOT DISTINCT FROM v.goal_type""",
    ("v_said", "v_tuples"),
)
def _(spark, sf):
    """Split by goal type with all totals in one pass."""
    from colloquy.operators.profile import corpus_profile

    t, g = profiled(spark, sf)
    return corpus_profile(t, g, ["split", "goal_type"], totals=True)
