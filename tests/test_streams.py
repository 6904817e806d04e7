"""Online jobs on hand-made streams."""

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import jobs as J
from colloquy.streaming.tracker import stream_state_tracker

ACTS = "array<struct<intent:string,domain:string,slot:string,value:string>>"
TURN = f"session_id long, pos long, role string, acts {ACTS}, sec long"


def feed(spark, path, batches, make, schema, mode="append"):
    """Write each batch as files of its own and run the stream over all of them, one file per trigger."""
    src, out = str(path / "src"), str(path / "out")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = J.stateful_session(spark).readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(src)
    df = make(stream.withColumn("ts", F.timestamp_seconds("sec")))
    q = (
        df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", str(path / "state"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_tracker_orders_turns_and_ignores_repeats(spark, tmp_path):
    hotel = lambda v: [("Inform", "酒店", "名称", v)]
    batches = [
        [(1, 2, "usr", hotel("late"), 1000)],
        [(1, 0, "usr", hotel("first"), 1001), (1, 0, "usr", hotel("again"), 1002)],
        [(1, 1, "sys", [("NoOffer", "酒店", "none", "none")], 1003)],
        [(1, 3, "sys", [], 1004), (1, 4, "usr", [("Request", "酒店", "价格", "")], 1005)],
        [(2, 1, "sys", [], 1006), (2, 2, "usr", hotel("gap"), 1006)],
        [(3, 0, "usr", hotel("x"), 9_000_000)],
    ]
    rows = feed(spark, tmp_path, batches, stream_state_tracker, TURN).orderBy("session_id", "pos").collect()
    seen = {(r.session_id, r.pos): [tuple(b) for b in r.belief] for r in rows}
    assert seen[(1, 0)] == [("酒店", "名称", "first")]
    assert seen[(1, 2)] == [("酒店", "名称", "late")]
    assert (1, 4) in seen and [tuple(p) for r in rows if (r.session_id, r.pos) == (1, 4) for p in r.pending] == [("酒店", "价格")]
    # the gap in session 2 never closes; idleness past the watermark releases what waited
    assert seen[(2, 2)] == [("酒店", "名称", "gap")]
    assert len(rows) == len(seen)


def test_dedup_within_watermark(spark, tmp_path):
    t = [(1, 0, "usr", [], 100), (1, 0, "usr", [], 130), (1, 1, "sys", [], 140)]
    out = feed(spark, tmp_path, [t, t], lambda s: J.dedup_turns(s).select("session_id", "pos"), TURN)
    assert out.count() == 2


def test_label_metrics_report(spark, tmp_path):
    schema = "label long, scores array<double>, sec long"
    spark.createDataFrame([(0, [1.0, 0.0], 10), (0, [0.0, 1.0], 20), (1, [0.0, 1.0], 30)], schema).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src")).withColumn("ts", F.timestamp_seconds("sec"))
    q = (
        J.label_metrics(stream).writeStream.outputMode("update").foreachBatch(J.report_sink(str(tmp_path / "report")))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {r.label: (r.n, r.right) for r in J.report_table(spark, str(tmp_path / "report")).collect()}
    assert got == {0: (2, 1), 1: (1, 1)}


def test_tracker_needs_its_session(spark, tmp_path):
    spark.createDataFrame([], TURN).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(spark.createDataFrame([], TURN).schema).parquet(str(tmp_path / "src"))
    with pytest.raises(ValueError, match="stateful_session"):
        stream_state_tracker(stream.withColumn("ts", F.timestamp_seconds("sec")))


def test_tracker_keeps_and_changes_beliefs(spark, tmp_path):
    """Appends, moved names, cleared domains and answered requests over restarts of the batch."""
    turns = [
        (1, 0, "usr", [("Inform", "餐馆", "推荐菜", "a"), ("Inform", "餐馆", "推荐菜", "b"), ("Inform", "餐馆", "名称", "r")], 10),
        (1, 1, "sys", [("Inform", "餐馆", "电话", "1")], 11),
        (1, 2, "usr", [("Select", "酒店", "源领域", "餐馆"), ("Request", "酒店", "价格", "")], 12),
        (1, 3, "sys", [("Inform", "酒店", "价格", "9")], 13),
        (1, 4, "usr", [("Inform", "酒店", "酒店设施-叫醒服务", "是"), ("Select", "餐馆", "源领域", "餐馆")], 14),
        (1, 5, "sys", [("NoOffer", "酒店", "none", "none")], 15),
        (1, 6, "usr", [("General", "thank", "none", "none"), ("Request", "餐馆", "电话", "")], 16),
    ]
    rows = feed(spark, tmp_path, [[t] for t in turns], stream_state_tracker, TURN).orderBy("pos").collect()
    got = [(r.pos, r.cur_domain, {f"{b.domain}.{b.slot}": b.value for b in r.belief}, [tuple(p) for p in r.pending]) for r in rows]
    assert got[0] == (0, "餐馆", {"餐馆.名称": "r", "餐馆.推荐菜": "a b"}, [])
    assert got[1] == (2, "酒店", {"餐馆.名称": "r", "餐馆.推荐菜": "a b", "酒店.周边餐馆": "r"}, [("酒店", "价格")])
    assert got[2] == (4, "餐馆", {"餐馆.周边餐馆": "r", "酒店.周边餐馆": "r", "酒店.酒店设施": "叫醒服务"}, [])
    assert got[3] == (6, "餐馆", {"酒店.周边餐馆": "r", "酒店.酒店设施": "叫醒服务"}, [("餐馆", "电话")])


def test_report_sink_folds_and_replays(spark, tmp_path):
    """Batches win by id, a replay replaces itself, folded changes are removed."""
    path = str(tmp_path / "report")
    sink = J.report_sink(path, ("k",), compact_every=3)
    want = {}
    for b in range(11):
        rows = {f"k{b % 4}": b, "all": b}
        want |= rows
        for again in range(2 if b in (2, 5, 7) else 1):
            sink(spark.createDataFrame(list(rows.items()), "k string, v int"), b)
        assert {r.k: r.v for r in J.report_table(spark, path, ("k",)).collect()} == want
    assert sorted(p.name for p in (tmp_path / "report" / "folded").iterdir() if p.is_dir()) == ["batch=5", "batch=8"]
    assert sorted(int(p.name[6:]) for p in (tmp_path / "report" / "changes").iterdir() if p.is_dir()) == [6, 7, 8, 9, 10]


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    """A row a day late joins its session, one older than the delay does not."""
    schema = "user_id long, event_type string, sec long"
    day = 86_400
    batches = [
        [(1, "click", 10 * day), (1, "purchase", 10 * day + 60)], [(2, "click", 10 * day), (1, "error", 10 * day + 90), (3, "click", 13 * day)],
        [(3, "view", 13 * day + 60)], [(4, "click", 9 * day), (5, "click", 30 * day)],
    ]
    out = feed(spark, tmp_path, batches, lambda s: J.session_summary(s, delay="2 days"), schema)
    assert {(r.user_id, r.turns, r.succeeded, r.failed) for r in out.collect()} == {(1, 3, 1, 1), (2, 1, 0, 0), (3, 2, 0, 0)}


def test_act_distribution_counts_all_events(spark):
    """Also those of windows that the watermark has not closed."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in entry.queries()["stream_act_distribution"](spark, sf).collect():
        got[r.event_type] = got.get(r.event_type, 0) + r.n
    want = {r.event_type: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()}
    assert got == want
