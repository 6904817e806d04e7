"""Streaming jobs and extension points run over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy import plugins as P
from colloquy.functions import acts as A
from colloquy.operators import metrics as M, state as S, vocab as Vo
from colloquy.operators.staging import stage, stage_dir, stage_path
from colloquy.plans import views as V
from colloquy.plans.catalog_state import TRACK
from colloquy.plans.registry import query
from colloquy.streaming import jobs as J
from colloquy.streaming.tracker import stream_state_tracker


BATCHES = 4


def run_stream(spark, df, mode="append"):
    """Drive a stream over its available input into files next to its checkpoint and read them back."""
    base = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (
        df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def deliveries(spark, sf, copies=True, end=False):
    """Events as they arrive in ``BATCHES`` batches: every 13th a day late, every 7th delivered again six hours later.

    ``end`` adds a last batch with one event of no user, ten days on, that moves the watermark past all others.
    """
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    again = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = e.withColumn("_copy", F.explode(again)) if copies else e.withColumn("_copy", F.lit(0))
    late = F.when(F.col("event_id") % 13 == 0, 86_400).otherwise(0)
    e = e.withColumn("_at", F.unix_micros("ts") + (late + F.col("_copy") * 21_600) * F.lit(1_000_000).cast("long"))
    span = e.agg(F.min("_at").alias("_lo"), (F.max("_at") - F.min("_at") + 1).alias("_span"), F.max("ts").alias("_end"))
    whole = e.crossJoin(span)  # one row
    rows = whole.withColumn("batch", F.floor((F.col("_at") - F.col("_lo")) / F.col("_span") * BATCHES).cast("int")).select(*V.table(spark, sf, "events").columns, "batch")
    if end:
        none = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in ("ts", "event_id", "batch")}
        mark = span.select((F.col("_end") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(BATCHES).alias("batch"), *[c.alias(n) for n, c in none.items()])
        rows = rows.unionByName(mark)
    return stage(rows, "deliveries")


def run_batches(spark, rows, start):
    """Deliver batch by batch; the stream is started anew from its checkpoint for each."""
    source, schema = stage_path(spark, "source"), rows.drop("batch").schema
    own = J.stateful_session(spark)
    for k in range(BATCHES + 1):
        part = rows.filter(F.col("batch") == k).drop("batch")
        if not part.isEmpty():
            part.write.mode("append").parquet(source)
            start(own.readStream.schema(schema).parquet(source)).trigger(availableNow=True).start().awaitTermination()


def batched_files(spark, rows, make):
    """Rows that the append stream ``make`` writes over all batches."""
    base, schema = stage_path(spark, "stream"), []

    def start(stream):
        out = make(stream)
        schema[:] = [out.schema]
        return out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")

    run_batches(spark, rows, start)
    return spark.read.schema(schema[0]).parquet(f"{base}/out")


def batched_report(spark, rows, make, keys, compact_every=2):
    """Latest row per key that the update stream ``make`` writes over all batches."""
    base = stage_path(spark, "report")
    run_batches(
        spark, rows,
        lambda stream: make(stream).writeStream.outputMode("update").foreachBatch(J.report_sink(f"{base}/out", keys, compact_every))
        .option("checkpointLocation", f"{base}/state"),
    )
    return J.report_table(spark, f"{base}/out", keys)


@query("act_distribution_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return _text_time(J.act_distribution(V.table(spark, sf, "events"), "event_type"), "start")


def _text_time(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS turns, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS succeeded,
 max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM s GROUP BY user_id, sid"""


@query("session_summary", _SESSIONS)
def _(spark, sf):
    return _text_time(J.session_summary(V.table(spark, sf, "events")).drop("end"), "start")


def scored_events(spark, sf):
    """Predictions arriving at event times."""
    e = V.table(spark, sf, "events").select("event_id", "ts")
    s = V.scores(spark, sf).select(F.col("id").alias("event_id"), "label", F.col("trs").alias("scores"))
    return e.join(s, "event_id").select("ts", "label", "scores")


@query(
    "label_metrics_windows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, label, count(*) AS n,
 CAST(sum(CASE WHEN list_position(trs, list_max(trs)) - 1 = label THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM events JOIN v_scores ON id = event_id GROUP BY ALL""",
    ("v_scores",),
)
def _(spark, sf):
    return _text_time(J.label_metrics(scored_events(spark, sf), width="1 day"), "start")


@query("dedup_turns", "SELECT conv_id AS session_id, turn AS pos FROM conversations")
def _(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"))
    twice = c.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ts", F.timestamp_seconds(F.col("pos")))
    return J.dedup_turns(twice).select("session_id", "pos")


@query("stream_act_distribution", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    """All windows: late events change theirs in update mode, the last count of each stands."""
    rows = deliveries(spark, sf, copies=False)
    out = batched_report(spark, rows, lambda s: J.act_distribution(s, "event_type", delay="2 days"), ("start", "event_type"))
    return _text_time(out, "start")


@query("stream_session_summary", _SESSIONS)
def _(spark, sf):
    """Repeated deliveries go, late events join their session, and what an idle gap closes is written once."""

    def make(stream):
        once = J.dedup_turns(stream, ("event_id",), delay="2 days")
        return J.session_summary(once.filter("user_id is not null"), delay=None)

    return _text_time(batched_files(spark, deliveries(spark, sf, end=True), make).drop("end"), "start")


@query(
    "stream_label_metrics",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, label, count(*) AS n,
 CAST(sum(CASE WHEN list_position(trs, list_max(trs)) - 1 = label THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM events JOIN v_scores ON id = event_id GROUP BY ALL""",
    ("v_scores",),
)
def _(spark, sf):
    """Metrics per window and label, upserted as predictions arrive."""
    s = V.scores(spark, sf).select(F.col("id").alias("event_id"), "label", F.col("trs").alias("scores"))
    rows = deliveries(spark, sf, copies=False).join(s, "event_id").select("ts", "label", "scores", "batch")
    return _text_time(batched_report(spark, stage(rows), lambda p: J.label_metrics(p, width="1 day", delay="2 days"), ("start", "label")), "start")


@query("stream_dedup", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(spark, sf):
    """Deliveries repeated within the watermark, also in a later batch after a restart, pass once."""
    out = batched_files(spark, deliveries(spark, sf), lambda s: J.dedup_turns(s, ("event_id",), delay="2 days"))
    return _text_time(out.select("event_id", "user_id", "event_type", "ts"), "ts")


@query(
    "stream_state_tracker",
    TRACK + """, ut AS (SELECT DISTINCT session_id, pos FROM usr), tch AS (SELECT DISTINCT session_id, domain, slot FROM chg),
g AS (SELECT ut.session_id, ut.pos, t.domain, t.slot, last_value(chg.value IGNORE NULLS) OVER (PARTITION BY ut.session_id, t.domain, t.slot ORDER BY ut.pos ROWS UNBOUNDED PRECEDING) AS value
 FROM ut JOIN tch t ON t.session_id = ut.session_id LEFT JOIN chg ON chg.session_id = ut.session_id AND chg.pos = ut.pos AND chg.domain = t.domain AND chg.slot = t.slot)
SELECT * FROM g WHERE value <> ''""",
    ("v_named",),
)
def _(spark, sf):
    """The online tracker over all sessions; its rows carry the belief after every user turn."""
    t = V.act_turns(V.named_acts(spark, sf)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 60))
    # turns come in several batches, some of them before their predecessors, some twice
    late = F.col("pos") + F.when((F.col("session_id") + F.col("pos")) % 5 == 0, 4).otherwise(0)
    seen = F.when(F.col("pos") % 7 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    t = t.withColumn("batch", F.least(F.lit(BATCHES - 1), F.expr("pos div 8")).cast("int")).withColumn("_more", F.explode(seen))
    t = t.withColumn("batch", F.least(F.lit(BATCHES), F.greatest(F.col("batch"), F.least(F.lit(BATCHES - 1), F.floor(late / 8))) + F.col("_more")).cast("int")).drop("_more")
    out = batched_files(spark, stage(t), lambda s: stream_state_tracker(s, delay="30 days", idle_ms=30 * 86_400_000))
    return out.select("session_id", "pos", F.inline("belief"))


@query(
    "plugin_acts",
    r"""SELECT session_id, pos, 'Inform+len+words+' || len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) || ' General+context+turns+' || least(pos, 3) AS acts FROM v_turns""",
    ("v_turns",),
)
def _(spark, sf):
    """A keyword model plugged in over text and context."""

    def make():
        def f(text, context):
            return [("Inform", "len", "words", str(len(text.split()))), ("General", "context", "turns", str(len(context)))]

        return f

    t = S.context_last_k(V.turns(spark, sf), 3)
    p = P.predict_acts(t, make)
    return p.select("session_id", "pos", A.act_texts("pred").alias("acts"))


@query("plugin_tokens", r"SELECT session_id, pos, array_to_string(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> ''), ' ') AS tokens FROM v_turns", ("v_turns",))
def _(spark, sf):
    cut = P.tokenizer(lambda: (lambda text: text.lower().split()))
    return V.turns(spark, sf).select("session_id", "pos", F.array_join(cut("content"), " ").alias("tokens"))


@query("plugin_tracker", "SELECT session_id, pos, CAST(sum(count(*)) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS acts FROM v_named GROUP BY session_id, pos", ("v_named",))
def _(spark, sf):
    def make():
        def step(state, role, acts):
            n = (state or 0) + len(acts)
            return n, (n,)

        return step

    return P.track_sessions(V.act_turns(V.named_acts(spark, sf)), make, "session_id long, pos long, acts long")


_BAYES = r"""
WITH tk AS (SELECT id, label, split, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS t FROM v_labelled),
c AS (SELECT label, t, count(*) AS n FROM tk WHERE split = 'train' GROUP BY ALL),
r AS (SELECT label, count(*) AS n FROM v_labelled WHERE split = 'train' GROUP BY label),
w AS (SELECT label, n, round(1 - n / (SELECT sum(n) FROM r), 6) AS w FROM r),
s AS (SELECT label, sum(n) AS said FROM c GROUP BY label),
m AS (SELECT w.label, w, CAST(round(ln(n * w / (SELECT sum(n * w) FROM w)) * 1000000) AS BIGINT) AS prior,
 CAST(round(ln(coalesce(said, 0) * w + (SELECT count(DISTINCT t) FROM c)) * 1000000) AS BIGINT) AS base FROM w LEFT JOIN s ON s.label = w.label),
g AS (SELECT c.label, t, CAST(round(ln(n * w + 1) * 1000000) AS BIGINT) AS gain FROM c JOIN m ON m.label = c.label),
x AS (SELECT id, t, count(*) AS n FROM tk WHERE split = 'test' GROUP BY ALL),
k AS (SELECT id, sum(n) AS n FROM x WHERE t IN (SELECT t FROM c) GROUP BY id),
a AS (SELECT id, label, sum(n * gain) AS gain FROM x JOIN g ON g.t = x.t GROUP BY ALL),
sc AS (SELECT d.id, d.label AS truth, m.label, CAST(prior + coalesce(a.gain, 0) - coalesce(k.n, 0) * base AS BIGINT) AS score
 FROM v_labelled d CROSS JOIN m LEFT JOIN a ON a.id = d.id AND a.label = m.label LEFT JOIN k ON k.id = d.id WHERE split = 'test'),
p AS (SELECT id, truth, first(label ORDER BY score DESC, label) AS pred FROM sc GROUP BY ALL)
"""


def baseline(spark, sf):
    """Trained on the train split with balanced classes, scored on the test split."""
    d = V.labelled(spark, sf).select("id", V.words(F.col("text")).alias("tokens"), "label", "split")
    train = d.filter("split = 'train'")
    return P.intent_baseline(train, d.filter("split = 'test'"), weights=Vo.label_weight(train, "label"))


@query("intent_baseline", _BAYES + "SELECT truth AS label, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY truth", ("v_labelled",))
def _(spark, sf):
    return M.class_report(baseline(spark, sf), "label", "pred")[0]


@query("intent_scores", _BAYES + "SELECT sc.id, sc.label, score, sc.label = pred AS best FROM sc JOIN p ON p.id = sc.id", ("v_labelled",))
def _(spark, sf):
    """Every class score of every test text."""
    b = baseline(spark, sf).select("id", "pred", F.inline("scores"))
    return b.select("id", "label", "score", (F.col("label") == F.col("pred")).alias("best"))
