"""File sources and sinks: the tables' rows written as files of the reference formats, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import vocab as Vo
from colloquy.operators.staging import stage, stage_path
from colloquy.plans import views as V
from colloquy.plans.registry import query
from colloquy.sources import dialogues as D, readers as R, writers as Wr


def session_files(spark, sf, path, parts=2):
    """Sessions of named acts as JSON objects keyed by session; what is said is made of the events' own JSON texts."""
    e = V.named_acts(spark, sf).join(V.table(spark, sf, "events").select("event_id", "props"), "event_id")
    turn = e.groupBy("session_id", "pos", "role").agg(F.array_sort(F.collect_list(F.struct("act_ord", F.array(*V.ACT).alias("act"), "props"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(F.lit('\\"}{['), x["props"])), "|")
    message = F.struct(F.col("role"), said.alias("content"), F.transform("t", lambda x: x["act"]).alias("dialog_act"))
    s = turn.select("session_id", F.struct("pos", message.alias("m")).alias("m")).groupBy("session_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    body = F.struct(F.concat(F.lit("g"), F.col("session_id") % 5).alias("type"), F.transform("ms", lambda x: x["m"]).alias("messages"))
    lines = s.select("session_id", Wr.json_member(F.col("session_id").cast("string"), body).alias("entry"))
    Wr.write_json_document(lines, path, "entry", ["session_id"], parts=parts)


@query(
    "session_file_acts",
    r"""SELECT CAST(session_id AS VARCHAR) AS session_id, 'g' || (session_id % 5) AS goal_type, pos, role, act_ord, intent, domain, slot, value,
 string_agg('\"}{[' || props, '|') OVER (PARTITION BY session_id, pos ORDER BY act_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS content
FROM v_named JOIN (SELECT event_id, props FROM events) USING (event_id)""",
    ("v_named",),
)
def _(spark, sf):
    """Sessions from JSON files that are cut into byte ranges; texts hold quotes, backslashes and brackets."""
    path = stage_path(spark, "sessions")
    session_files(spark, sf, path)
    t = R.explode_turns(R.read_sessions(spark, path, "train"))
    acts = R.explode_acts(t, keep=("session_id", "goal_type", "pos", "role", "content"))
    return acts.withColumn("pos", F.col("pos").cast("bigint")).withColumn("act_ord", F.col("act_ord").cast("bigint"))


@query(
    "entity_file",
    """SELECT p_name AS name, p_type AS "type", CAST(p_size AS BIGINT) AS size, p_brand || ' [' || p_name || ']}' AS note FROM (
SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS back FROM part) WHERE back = 1""",
)
def _(spark, sf):
    """Entities from one array of [name, attributes]; of several with one name the last stands."""
    path = stage_path(spark, "entities")
    p = V.table(spark, sf, "part")
    note = F.concat("p_brand", F.lit(" ["), "p_name", F.lit("]}"))
    attrs = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.struct(note.alias("note")).alias("more")))
    name = F.to_json(F.array("p_name"))
    item = F.concat(F.substring(name, F.lit(1), F.char_length(name) - 1), F.lit(", "), attrs, F.lit("]"))
    Wr.write_json_document(p.select("p_partkey", item.alias("entry")), path, "entry", ["p_partkey"], brackets="[]")
    at = lambda k, t: F.get_json_object("attrs", f"$.{k}").cast(t)
    return R.read_entities(spark, path).select("name", at("type", "string").alias("type"), at("size", "long").alias("size"), at("more.note", "string").alias("note"))


@query("vocabulary_file", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, string_split(p_name, ' ')[1] AS token FROM part")
def _(spark, sf):
    """Line-numbered tokens; the sorted files of a folder are numbered as one."""
    path = stage_path(spark, "vocabulary")
    V.table(spark, sf, "part").orderBy("p_partkey").select(F.concat_ws(" ", "p_name", "p_size")).write.text(path)
    return R.read_vocab(spark, path)


@query(
    "vector_file",
    """SELECT key, i - 1 AS i, CAST(vec[i] AS DOUBLE) AS x FROM (SELECT key, vec, unnest(range(1, len(vec) + 1)) AS i FROM
 (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS key, embedding AS vec FROM embeddings))""",
)
def _(spark, sf):
    """Line-numbered vectors, all their elements."""
    path = stage_path(spark, "vectors")
    e = V.table(spark, sf, "embeddings").orderBy("vec_id")
    e.select(F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")).write.text(path)
    v = R.read_vectors(spark, path).select("key", F.posexplode("vec").alias("i", "x"))
    return v.withColumn("i", F.col("i").cast("bigint"))


_EX = r"""WITH x AS (SELECT session_id, pos, regexp_replace(content, '\s+', ' ', 'g') AS said FROM v_exchanges),
ex AS (SELECT u.session_id, u.pos // 2 AS i, trim(u.said, ' ') AS usr, trim(s.said, ' ') AS bot FROM x u JOIN x s ON s.session_id = u.session_id AND s.pos = u.pos + 1 WHERE u.pos % 2 = 0),
d AS (SELECT session_id, dense_rank() OVER (ORDER BY session_id) - 1 AS dialogue FROM (SELECT DISTINCT session_id FROM ex)),
"""


def dialogue_file(spark, sf, path):
    """Exchanges as numbered lines, each dialogue led by a line of knowledge and followed by a blank one."""
    t = V.exchanges(spark, sf).withColumn("said", F.trim(F.regexp_replace("content", r"\s+", " ")))
    usr = t.filter("pos % 2 = 0").select("session_id", F.expr("pos div 2").alias("i"), F.col("said").alias("usr"))
    bot = t.filter("pos % 2 = 1").select("session_id", F.expr("pos div 2").alias("i"), F.col("said").alias("bot"))
    ex = stage(usr.join(bot, ["session_id", "i"]))
    talk = ex.select("session_id", (F.col("i") + 1).alias("at"), F.concat(F.col("i") + 2, F.lit(" "), "usr", F.lit("\t"), "bot").alias("value"))
    known = ex.filter("i = 0").select("session_id", F.lit(0).cast("bigint").alias("at"), F.concat(F.lit("1 s"), "session_id", F.lit(" R_first "), F.char_length("usr")).alias("value"))
    blank = ex.groupBy("session_id").agg((F.max("i") + 2).alias("at")).withColumn("value", F.lit(""))
    talk.unionByName(known).unionByName(blank).orderBy("session_id", "at").select("value").write.text(path)


@query(
    "dialogue_file_lines",
    _EX + """l AS (SELECT session_id, i + 1 AS k, 'talk' AS kind, usr, bot, NULL AS kb FROM ex
 UNION ALL SELECT session_id, 0, 'kb', NULL, NULL, 's' || session_id || ' R_first ' || length(usr) FROM ex WHERE i = 0)
SELECT dialogue, row_number() OVER (PARTITION BY dialogue ORDER BY k) - 1 AS line, kind, usr, bot, kb FROM l JOIN d USING (session_id)""",
    ("v_exchanges",),
)
def _(spark, sf):
    """Numbered dialogues from files cut into byte ranges: every line with its dialogue and place."""
    path = stage_path(spark, "dialogues")
    dialogue_file(spark, sf, path)
    lines = stage(D.read_numbered_dialogues(spark, path))
    start = lines.groupBy("dialogue").agg(F.min("n").alias("start"))
    return lines.join(start, "dialogue").select("dialogue", (F.col("n") - F.col("start")).alias("line"), "kind", "usr", "bot", "kb")


@query(
    "dialogue_file_totals",
    _EX + """p AS (SELECT session_id, count(*) FILTER (usr <> '<SILENCE>') AS u, count(*) AS b, sum(len(string_split(bot, ' '))) AS w FROM ex GROUP BY session_id)
SELECT count(*) AS dialogues, CAST(sum(u) AS BIGINT) AS user_turns, CAST(sum(b) AS BIGINT) AS bot_turns, count(*) AS kb_lines, round(sum(w) / sum(b), 6) AS reply_words FROM p""",
    ("v_exchanges",),
)
def _(spark, sf):
    path = stage_path(spark, "dialogues")
    dialogue_file(spark, sf, path)
    return D.dialogue_totals(D.read_numbered_dialogues(spark, path))


@query(
    "word_id_file",
    f"""SELECT item AS token, row_number() OVER (ORDER BY o) AS id FROM (SELECT w AS item, min(session_id * 100000000 + pos * 10000 + i) AS o FROM
 (SELECT session_id, pos, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM (SELECT session_id, pos, list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '') AS toks FROM v_turns)) GROUP BY w)""",
    ("v_turns",),
)
def _(spark, sf):
    """Vocabulary with ids from 1, written as a report table and read back."""
    t = V.turns(spark, sf).withColumn("tokens", V.words(F.col("content")))
    vocab = Vo.first_seen_vocabulary(t, "tokens", ["session_id", "pos"]).select(F.col("item").alias("token"), "id")
    path = stage_path(spark, "word-ids")
    Wr.write_report(Wr.word_ids(vocab), path)
    return spark.read.option("sep", "\t").option("quote", "").schema("token string, id long").csv(path)
