"""Small hand-written cases for the rules that are easy to get wrong."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import acts as A, encode as E, features as Fe
from colloquy.operators import entities as N, filters as Fi, generation as G, goals as Go, metrics as M, state as S, tagging as Tg, text as X
from colloquy.operators import ordered as O, sampling as Sa
from colloquy.sources import dialogues as D, readers as R, writers as Wr

ACTS = "array<struct<intent:string,domain:string,slot:string,value:string>>"


def one(df):
    return df.collect()[0]


def test_micro_prf_counts_duplicates_and_guards_zero(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["x"]), ([], [])], "pred array<string>, gold array<string>")
    r = one(M.micro_prf(df))
    assert (r.tp, r.fp, r.fn) == (2, 1, 2)
    empty = one(M.micro_prf(df.filter("size(pred) > 5")))
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_belief_scores_cases(spark):
    rows = [([], []), (["s-v"], []), (["s-w"], ["s-v"]), (["a-b-x"], ["a-b-y"])]
    df = spark.createDataFrame(rows, "pred array<string>, gold array<string>")
    r = one(M.belief_scores(df, 10))
    # a wrong value of a missed slot counts once; only-gold-empty scores zero, both empty one
    assert r.turn_acc == pytest.approx((1 + 0.9 + 0.9 + 0.9) / 4)
    assert r.belief_f1 == pytest.approx(0.25)
    assert r.joint_acc == pytest.approx(0.25)


def test_delexicalize_numbers_same_key_only(spark):
    acts = [("Inform", "d", "s", "x"), ("Request", "d", "s", ""), ("Inform", "d", "s", "y"), ("Inform", "d", "s", "z")]
    df = spark.createDataFrame([(acts,)], f"acts {ACTS}")
    assert one(df.select(A.delexicalize("acts").alias("d"))).d == ["Inform+d+s+1", "Request+d+s+", "Inform+d+s+2", "Inform+d+s+3"]


def constraints_of(spark, rows):
    kinds = {"价格": "between", "评分": "between", "门票": "between", "名称": "substring", "酒店设施": "multiple_in", "周边景点": "in"}
    c = N.parse_constraints(spark.createDataFrame(rows, "query_id long, slot string, value string"), kinds)
    return {(r.query_id, r.slot): (r.kind, r.text, r.lo, r.hi) for r in c.collect()}


def test_parse_constraints(spark):
    rows = [
        (1, "价格", "100-200元"), (2, "价格", "500以上"), (3, "价格", "20元以下"), (4, "价格", "300元"), (5, "门票", "免费"), (6, "门票", "不免费"),
        (7, "评分", "4.5分以上"), (8, "评分", "高"), (9, "评分", "5分"), (10, "名称", "x"), (10, "价格", "1-2"), (11, "价格", "便宜"), (12, "周边景点", ""),
    ]
    c = constraints_of(spark, rows)
    bounds = {k[0]: v[2:] for k, v in c.items()}
    assert bounds[1] == (100, 200) and bounds[2] == (500, None) and bounds[3] == (None, 20) and bounds[4] == (300, 300)
    assert bounds[5] == (0, 0) and bounds[6] == (1, None) and bounds[7] == (4.5, None) and bounds[9] == (5, None)
    assert bounds[11] == (None, None)
    assert (8, "评分") not in c and (12, "周边景点") not in c
    assert [k for k in c if k[0] == 10] == [(10, "名称")]


def test_entity_search_against_brute_force(spark):
    rnd = random.Random(3)
    ents = [
        (i, rnd.choice(["ab", "abc", "hotel x", "x", "no"]), rnd.choice([None, 50.0, 150.0, 250.0]), rnd.sample(["wifi", "pool", "gym", "免费wifi"], 2), rnd.sample(["a1", "b22", "c333"], 2))
        for i in range(60)
    ]
    e = spark.createDataFrame(ents, "key long, name string, price double, tags array<string>, near array<string>")
    terms = N.entity_terms(e, {"name": "name"}, {"tags": "tags", "near": "near"}, {"price": "price"})
    qs = []
    for q in range(40):
        cons = []
        if rnd.random() < 0.4:
            cons.append(("name", "substring", rnd.choice(["ab", "x", "hotel", "a"]), None, None))
        if rnd.random() < 0.5:
            cons.append(("price", "between", None, rnd.choice([None, 50.0, 100.0]), rnd.choice([None, 150.0, 200.0])))
        if rnd.random() < 0.4:
            cons.append(("tags", "multiple_in", rnd.choice(["wifi  pool", "wifi", "gym"]), None, None))
        if rnd.random() < 0.3:
            cons.append(("near", "in", rnd.choice(["b2", "333", "zz"]), None, None))
        qs += [(q, *c) for c in cons] or [(q, "price", "between", None, None, None)]
    c = spark.createDataFrame(qs, "query_id long, slot string, kind string, text string, lo double, hi double")

    def ok(ent, con):
        _, slot, kind, text, lo, hi = con
        if kind == "between":
            v = ent[2]
            return (lo is None or (v is not None and v >= lo)) and (hi is None or (v is not None and v <= hi))
        held = {"name": [ent[1]], "tags": ent[3], "near": ent[4]}[slot]
        need = text.split() if kind == "multiple_in" else [text]
        return all(any(t in h for h in held) for t in need)

    want = {(q, ent[0]) for q in {x[0] for x in qs} for ent in ents if all(ok(ent, x) for x in qs if x[0] == q)}
    got = N.entity_search(c, terms).collect()
    assert len(got) == len(want) and {(r.query_id, r.entity) for r in got} == want
    counted = N.entity_search(c, terms, counted=True)
    assert {(r.query_id, r.n) for r in counted.collect()} == {(q, sum(q == k for k, _ in want)) for q, _ in want}
    assert {(r.query_id, r.n) for r in N.result_counts(c, counted).collect()} == {(x[0], sum(x[0] == k for k, _ in want)) for x in qs}


def test_counts_of_spans_equal_counts_of_slots(spark):
    """Two trackers with unequal spans: counts at every user turn, over several chunks, against a plain replay."""
    rnd = random.Random(3)
    slots = [("d", "a"), ("d", "b"), ("e", "a")]
    turns = [(s, p, "usr" if rnd.random() < 0.6 else "sys") for s in range(6) for p in range(700 if s == 0 else 40)]
    def changes():
        return [(s, p, d, sl, rnd.choice(["", "x", "y"])) for s, p, _ in turns for d, sl in slots if rnd.random() < 0.05]
    gold, pred = changes(), changes()
    frame = lambda rows: spark.createDataFrame(rows, "session_id long, pos long, domain string, slot string, value string")
    t = spark.createDataFrame(turns, "session_id long, pos long, role string")
    got = {(r.session_id, r.pos): (r.gold, r.pred, r.hits, r.wrong) for r in S.turn_counts(frame(gold), frame(pred), t).collect()}
    held = S.at_turns(S.slot_spans(frame(gold), t), t).collect()
    g, p = {(x[0], x[1], x[2], x[3]): x[4] for x in gold}, {(x[0], x[1], x[2], x[3]): x[4] for x in pred}
    now, want, cells, session = ({}, {}), {}, set(), None
    for s, pos, role in turns:
        if s != session:
            now, session = ({}, {}), s
        for at in slots:
            for state, new in zip(now, (g, p)):
                state[at] = new.get((s, pos, *at), state.get(at, ""))
        if role == "usr":
            pairs = [(now[0][at], now[1][at]) for at in slots]
            want[s, pos] = (sum(a != "" for a, _ in pairs), sum(b != "" for _, b in pairs), sum(a == b != "" for a, b in pairs), sum(a == "" != b for a, b in pairs))
            cells |= {(s, pos, *at, now[0][at]) for at in slots if now[0][at]}
    assert got == want
    assert len(held) == len(cells) and {(r.session_id, r.pos, r.domain, r.slot, r.value) for r in held} == cells


def random_sessions(n=120, turns=12):
    rnd = random.Random(11)
    slots = {"景点": ["名称", "门票"], "餐馆": ["名称", "推荐菜"], "酒店": ["名称", "酒店设施-wifi", "价格"], "地铁": ["出发地", "目的地"]}
    out = []
    for s in range(n):
        for pos in range(turns):
            acts = []
            for _ in range(rnd.randint(0, 3)):
                d = rnd.choice(list(slots))
                i = rnd.choice(["Inform", "Inform", "Request", "Select", "NoOffer", "Recommend"] if pos % 2 else ["Inform", "Inform", "Request", "Select"])
                slot = rnd.choice(slots[d])
                v = rnd.choice(list(slots)) if i == "Select" else "是" if "设施" in slot else "" if i == "Request" else f"v{rnd.randint(0, 9)}"
                acts.append((i, d, "源领域" if i == "Select" else slot, v))
            out.append((s, pos, "sys" if pos % 2 else "usr", acts))
    return out


def fold(turns):
    """Belief {(domain, slot): value} and open requests after the last user turn, act by act."""
    belief, asked, left = {}, [], []
    for _, role, acts in turns:
        if role == "sys":
            left = acts
            continue
        groups = [[a[1] for a in source if a[0] in intents] for source, intents in ((acts, ["Select"]), (acts, ["Request"]), (acts, ["Inform"]), (left, ["Inform", "Recommend"]))]
        domain = next((max(g, key=lambda d: (g.count(d), -g.index(d))) for g in groups if g), None)
        intents = [a[0] for a in left]
        if "NoOffer" in intents and "Inform" not in intents:
            belief = {at: v for at, v in belief.items() if at[0] != domain}
        asked = [r for r in asked if r not in [(a[1], a[2]) for a in left if a[0] in ("Inform", "Recommend")]]
        for _, to, _, source in [a for a in acts if a[0] == "Select"]:
            name = belief.get((source, K.NAME))
            if name and to == source:
                belief = {at: v for at, v in belief.items() if at[0] != to}
            if name:
                belief[to, K.NEARBY + source] = name
        for _, to, slot, value in [a for a in acts if a[0] == "Inform"]:
            if K.FACILITY in slot and value == K.YES:
                slot, value = K.FACILITY, slot.split("-")[1]
            if slot in (K.DISH, K.FACILITY):
                belief[to, slot] = f"{belief.get((to, slot)) or ''} {value}".strip()
            elif slot in K.OVERWRITE_SLOTS:
                belief[to, slot] = value
        asked += [(a[1], a[2]) for a in acts if a[0] == "Request"]
    return belief, asked


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_tracker_equals_sequential_fold(spark, partitions):
    rows = random_sessions()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        t = spark.createDataFrame(rows, f"session_id long, pos long, role string, acts {ACTS}")
        got = {(r.session_id, r.domain, r.slot): r.value for r in S.final_state(t).collect()}
        open_requests = {(r.session_id, r.domain, r.slot): r.n for r in S.pending_requests(t).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, pending = {}, {}
    for s in {r[0] for r in rows}:
        belief, asked = fold([r[1:] for r in rows if r[0] == s])
        want.update({(s, *at): v for at, v in belief.items() if v})
        session = {"pending": asked}
        for d, sl in session["pending"]:
            pending[(s, d, sl)] = pending.get((s, d, sl), 0) + 1
    assert got == want
    assert open_requests == pending


def test_chunked_windows_equal_plain_ones(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5000).alias("x"))
    d = O.dense_position(df, ["k"], ["x"], F.floor(F.col("x") / 100))
    assert d.groupBy("k").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).filter("`max(pos)` + 1 <> `count(DISTINCT pos)`").count() == 0
    v = d.withColumn("v", F.when(F.col("x") % 5 == 0, F.col("x")))
    got = {(r.k, r.x): r.l for r in O.carry_last(v, ["k"], "x", F.floor(F.col("x") / 100), "v", "l").collect()}
    last = {}
    for r in sorted(v.collect(), key=lambda r: r.x):
        last[r.k] = r.v if r.v is not None else last.get(r.k)
        assert got[(r.k, r.x)] == last[r.k]
    w = {(r.k, r.pos): r.p for r in O.with_preceding(d, ["k"], "pos", 2, lambda w: {"p": F.lag("x", 2).over(w)}, chunk_rows=16).collect()}
    by = {(r.k, r.pos): r.x for r in d.collect()}
    assert all(w[(k, p)] == by.get((k, p - 2)) for k, p in by)


def test_bio_decode_cases(spark):
    rows = [
        (["a", "##b", "c"], ["B+I+d+s", "I+I+d+s", "I+I+d+s"]), (["a", "b"], ["B+I+d+s", "I+I+d+x"]), (["a"], ["I+I+d+s"]),
        (["a", "b"], ["B+I+d+s", "B+I+d+s"]), (["##a", "b"], ["B+I+d+s", "O"]),
    ]
    df = spark.createDataFrame(rows, "w array<string>, t array<string>")
    got = [[a.value for a in r.a] for r in df.select(Tg.bio_decode("w", "t").alias("a")).collect()]
    assert got == [["abc"], ["a"], [], ["a", "b"], ["##a"]]


def test_tags_round_trip_and_template_round_trip(spark):
    acts = [("Inform", "餐馆", "名称", "v1"), ("Inform", "餐馆", "推荐菜", "v22"), ("Inform", "餐馆", "推荐菜", "v33"), ("General", "greet", "none", "none")]
    df = spark.createDataFrame([("我 要 v1 和 v22 和 v33 吧", acts)], f"content string, acts {ACTS}")
    r = one(df.withColumn("tok", Tg.default_tokens("content")).withColumn("tag", Tg.bio_encode("tok", Tg.spans("content", "acts"))).select(Tg.bio_decode("tok", "tag").alias("a")))
    assert [tuple(a) for a in r.a] == acts[:3]
    d = one(df.withColumn("d", A.delexicalize_text("content", "acts")).select("d.text", "d.usable", A.fill_template("d.text", "acts").alias("back")))
    assert d.text == "我 要 [Inform+餐馆+名称] 和 [Inform+餐馆+推荐菜1] 和 [Inform+餐馆+推荐菜2] 吧" and d.usable
    assert d.back == "我 要 v1 和 v22 和 v33 吧"


def test_absent_value_makes_turn_unusable_and_unknown_intent_keeps_order(spark):
    df = spark.createDataFrame([("你好", [("Inform", "餐馆", "名称", "v1")])], f"content string, acts {ACTS}")
    assert not one(df.select(A.delexicalize_text("content", "acts")["usable"].alias("u"))).u
    names = spark.createDataFrame([(["General+bye+none", "Inform+餐馆+名称"],), (["General+bye+none", "Foo+x+y", "Inform+餐馆+名称"],)], "n array<string>")
    got = [r.o for r in names.select(A.canonical_order("n", "usr").alias("o")).collect()]
    assert got == [["Inform+餐馆+名称", "General+bye+none"], ["General+bye+none", "Foo+x+y", "Inform+餐馆+名称"]]


def test_bleu_broadcasts_no_ngrams(spark):
    """Staged tokens compress well, so their file size says nothing of their n-grams: they must not be sent to the driver."""
    df = spark.createDataFrame([("k", ["a", "b", "a"], ["a", "b"]), ("k", ["b"], ["c", "d"]), (None, ["a"], ["a"])], "key string, h array<string>, r array<string>")
    counts = G.bleu_counts(df, "key", "h", "r", [])
    joins = [line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "BroadcastHashJoin" in line]
    r = one(counts)
    assert (r.hit1, r.total1, r.hit2, r.total2, r.hyp_len, r.ref_len) == (3, 5, 1, 2, 4, 4)


def test_bleu_rules(spark):
    df = spark.createDataFrame([("k", ["a", "b", "c"], ["a", "b", "c", "d"]), ("k", ["a", "b"], ["a", "x"])], "key string, h array<string>, r array<string>")
    c = one(G.bleu_counts(df, "key", "h", "r", []))
    assert (c.hit1, c.total1, c.hit2, c.total2, c.hit4, c.total4) == (5, 5, 3, 3, 0, 0)
    # 'a b c' is as far from length 2 as from 4: the shorter one counts
    assert (c.hyp_len, c.ref_len) == (5, 4)
    assert one(G.bleu(G.bleu_counts(df, "key", "h", "r", []), style="plain")).bleu == 0.0


def test_wer_cases(spark):
    df = spark.createDataFrame([(["what", "is", "it"], ["what", "is"]), ([], ["a"]), ([f"w{i}" for i in range(400)], [f"x{i}" for i in range(400)])], "r array<string>, h array<string>")
    rows = X.wer(df, "r", "h").collect()
    assert rows[0].wer == pytest.approx(33.333333) and rows[1].wer is None and rows[2].edits == 400


def test_slot_error_counts_redundant_and_missing(spark):
    want = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "t int, slot string, want int")
    got = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "t int, slot string, got int")
    r = one(G.slot_error(want, got, ["t"]))
    assert (r.total, r.redundant, r.missing) == (3, 1, 2) and r.slot_error == 100.0


def test_encode_pair_cuts_longest_first(spark):
    df = spark.createDataFrame([([f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]), (["a"] * 9, None)], "a array<string>, b array<string>")
    r = df.select(E.encode_pair("a", "b", 12).alias("e")).collect()

    def pop(a, b, m):
        a, b = list(a), list(b)
        while len(a) + len(b) > m:
            (a if len(a) > len(b) else b).pop()
        return len(a), len(b)

    ka, kb = pop(range(8), range(8), 9)
    assert r[0].e.tokens.index("[SEP]") == ka + 1 and sum(r[0].e.segments) == kb + 1 and sum(r[0].e.mask) == 12
    assert r[1].e.size == 11 and sum(r[1].e.segments) == 0
    pairs = [(x, y) for x in range(0, 15) for y in range(0, 15)]
    lens = spark.createDataFrame(pairs, "x int, y int").select("x", "y", *[c.alias(n) for c, n in zip(E.pair_lengths(F.col("x"), F.col("y"), 12), "pq")])
    assert all((q.p, q.q) == pop(range(q.x), range(q.y), 9) for q in lens.collect())


def test_labelled_lines(spark):
    lines = spark.createDataFrame([("1\thello\tx",), ("2\thello\t",), ("3\t\tx",), ("4\ta\tb\tc",), ("  5\tb\ty \t",)], "value string")
    assert [tuple(r) for r in R.labelled_rows(lines, 3).collect()] == [("1", "hello", "x"), ("5", "b", "y")]


def test_price_bands_overlap(spark):
    got = {r.band: r.n for r in N.band_counts(spark.createDataFrame([(200,), (1000,), (1001,), (None,)], "p int"), "p").collect()}
    assert got["100-200元"] == 1 and got["200-300元"] == 1 and got["900-1000元"] == 1 and got["1000元以上"] == 1 and got["300-400元"] == 0


def test_label_repairs(spark):
    b = {"hotel-type": "guesthouse", "hotel-area": "cent", "train-day": "we", "attraction-area": "museum", "hotel-star": "3 star hotel"}
    df = spark.createDataFrame([(b,)], "b map<string,string>")
    r = one(df.select(Fi.repair_labels("b").alias("r"))).r
    assert r == {"hotel-type": "guest house", "hotel-area": "centre", "train-day": "wednesday", "attraction-area": "none", "hotel-star": "3"}
    twice = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "b array<struct<slot:string,value:string>>")
    assert one(twice.select(Fi.belief_list_to_map("b").alias("m"))).m == {"a": "3", "b": "2"}


def test_readers_and_writers(spark, tmp_path):
    session = {"s1": {"type": "单领域", "goal": [[1, "餐馆", "名称", "x", False], [1, "餐馆", "推荐菜", ["a", "b"], False]], "messages": [
        {"role": "usr", "content": "hi", "dialog_act": [["General", "greet", "none", "none"], ["Inform", "餐馆", "名称", "x"]], "user_state": [[1, "餐馆", "名称", "x", True]]},
        {"role": "sys", "content": "yo", "dialog_act": [], "sys_state": {"餐馆": {"名称": "x", "selectedResults": []}}, "sys_state_init": {}}]}}
    with zipfile.ZipFile(tmp_path / "train.json.zip", "w") as z:
        z.writestr("train.json", json.dumps(session, ensure_ascii=False))
    s = R.read_sessions(spark, str(tmp_path / "train.json.zip"), "train")
    t = R.explode_turns(s).orderBy("pos").collect()
    assert [(r.pos, r.role, r.content) for r in t] == [(0, "usr", "hi"), (1, "sys", "yo")] and t[0].acts[1].value == "x"
    g = one(s)
    assert g.goal[1].value == ["a", "b"] and g.goal[1].is_list and not g.goal[0].is_list
    assert R.explode_acts(R.explode_turns(s)).count() == 3

    (tmp_path / "db.json").write_text(json.dumps([["A", {"价格": 1}], ["B", {"价格": None}], ["A", {"价格": 3}]], ensure_ascii=False))
    e = {r.name: json.loads(r.attrs) for r in R.read_entities(spark, str(tmp_path / "db.json")).collect()}
    assert e == {"A": {"价格": 3}, "B": {"价格": None}}

    (tmp_path / "v.txt").write_text("a 5\nb 3\nc 1\n")
    assert [(r.id, r.token) for r in R.read_vocab(spark, str(tmp_path / "v.txt")).orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "e.txt").write_text("2 3\nx 1 2 3\ny 4 5 6\n")
    assert {r.key: r.vec for r in R.read_vectors(spark, str(tmp_path / "e.txt"), keyed=True, header=True).collect()} == {"x": [1, 2, 3], "y": [4, 5, 6]}
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    v = R.with_extra_vectors(R.read_vectors(spark, str(tmp_path / "m.txt")), 2, 2)
    assert sorted(r.key for r in v.collect()) == [0, 1, 2, 3]
    (tmp_path / "s.tsv").write_text("k\t0.1\t0.9\n")
    assert one(R.read_scores(spark, str(tmp_path / "s.tsv"))).scores == [0.1, 0.9]
    (tmp_path / "o.json").write_text(json.dumps({"餐馆-Price Range": [], "hotel-book day": [], "餐馆-book Day": []}, ensure_ascii=False))
    assert {r.slot for r in R.read_ontology(spark, str(tmp_path / "o.json")).collect()} == {"餐馆-pricerange", "餐馆-book day"}

    rows = spark.createDataFrame([("1", "t")], "id string, label string")
    Wr.write_prepared_corpus(rows, rows, str(tmp_path / "corpus"))
    assert sorted(p.name for p in (tmp_path / "corpus").iterdir() if p.is_dir()) == ["part=D", "part=E", "part=T"]
    Wr.append_run(rows, str(tmp_path / "runs"), "a")
    Wr.append_run(rows, str(tmp_path / "runs"), "b")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_numbered_dialogues(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 resto R_cuisine thai\n2 hello there\thi resto\n3 <SILENCE>\tthai resto\n\n1 a\tb\n")
    lines = D.read_numbered_dialogues(spark, str(tmp_path / "d.txt"))
    t = one(D.dialogue_totals(lines))
    assert (t.dialogues, t.user_turns, t.bot_turns, t.kb_lines) == (2, 2, 3, 1)
    m = D.memory_rows(lines).filter("dialogue = 0").orderBy("n", "block", "k").collect()
    assert m[0].row == ["thai", "R_cuisine", "resto", "PAD"] and m[1].row == ["hello", "$u", "turn1", "word0"]


def test_goal_rules(spark):
    t = "array<struct<id:int,domain:string,slot:string,value:array<string>,is_list:boolean,expressed:boolean>>"
    rows = [
        ([(1, "餐馆", "名称", ["x"], False, True)],),
        ([(1, "餐馆", "名称", ["x"], False, True), (2, "酒店", "名称", ["出现在id=1的周边酒店里"], False, False), (3, "出租", "出发地", ["id=1"], False, False)],),
        ([(1, "餐馆", "推荐菜", ["id"], True, True), (2, "酒店", "名称", ["y"], False, True)],),
    ]
    df = spark.createDataFrame(rows, f"s {t}")
    r = df.select(Go.infer_goal_type("s").alias("g"), Go.goal_completed("s").alias("c"), Go.reward("s").alias("r"), Go.current_subgoal("s").alias("n")).collect()
    assert [x.g for x in r] == [K.GOAL_SINGLE, K.GOAL_CROSS_TRANSPORT, K.GOAL_MULTI]
    assert [(x.c, x.r, x.n) for x in r] == [(True, 80.0, None), (False, -1.0, 2), (False, -1.0, 1)]
    acts = df.transform(lambda d: Go.resolve_references(d, "s")).select(A.act_texts("acts").alias("a")).collect()[1].a
    assert acts == "Select+酒店+源领域+餐馆 Inform+餐馆+名称+x Inform+出租+出发地+x"


def test_wordpiece(spark):
    vocab = spark.createDataFrame([(w,) for w in ("un", "##aff", "##able", "a", "##b")], "token string")
    df = spark.createDataFrame([(1, ["unaffable", "ab", "", "zz", "a" * 101])], "id int, t array<string>")
    want = ["un", "##aff", "##able", "a", "##b", "[UNK]", "[UNK]"]
    assert one(X.wordpiece(df, "t", vocab, ["id"])).pieces == want


def test_wordpiece_looks_up_by_hash(spark):
    """Null and empty tokens, null and empty rows; no token searches the map of its row entry by entry."""
    vocab = spark.createDataFrame([(w,) for w in ("a", "##b", "c")], "token string")
    rows = [(1, ["ab", None, "", "c", "ab"]), (2, None), (3, []), (4, ["x"]), (5, [""]), (6, ["c"])]
    out = X.wordpiece(spark.createDataFrame(rows, "id int, t array<string>").coalesce(1), "t", vocab, ["id"])
    got = {r.id: r.pieces for r in out.collect()}
    assert got == {1: ["a", "##b", "[UNK]", "c", "a", "##b"], 2: None, 3: [], 4: ["[UNK]"], 5: [], 6: ["c"]}
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def _greedy(tokens, vocab, longest=100):
    """Word pieces by the definition."""
    out = []
    for t in tokens or []:
        i, cut = 0, []
        while t and i < len(t) <= longest:
            j = max((j for j in range(i + 1, len(t) + 1) if ("##" if i else "") + t[i:j] in vocab), default=0)
            if not j:
                break
            cut.append(("##" if i else "") + t[i:j])
            i = j
        out += cut if t and i == len(t) else [] if t == "" else ["[UNK]"]
    return out


def test_wordpiece_asks_once_per_block(spark, monkeypatch):
    """A block looks a token up once, however many of its rows hold it; repeated and null keys, accents, null and empty tokens."""
    vocab = {"a", "##b", "ab", "##c", "é", "##é", "##éa", "b", "日", "##𝒳"}
    words = ["ab", "abc", "abé", "éé", "éa", "bbb", "", None, "日", "b𝒳", "zz", "c", "a" * 101, "abababab"]
    rows = [(k // 2 if k % 17 else None, [words[(k * i + i // 5) % len(words)] for i in range(k % 40)] if k % 23 else None, k) for k in range(240)]
    df = spark.createDataFrame(rows, "id int, t array<string>, place long").repartition(5)
    pieces = spark.createDataFrame([(w,) for w in vocab], "token string")
    asked, staged = [], X.stage
    monkeypatch.setattr(X, "stage", lambda d: asked.append(staged(d)) or asked[-1])
    monkeypatch.setattr(X, "BLOCKS", 6)
    for place in ("place", None):
        got = X.wordpiece(df, "t", pieces, ["id"], place=place)
        assert got.columns == ["id", "t", "place", "pieces"]
        assert asked[-1].count() <= 7 * len(words)
        found = {r.place: r.pieces for r in got.collect()}
        want = {k: None if t is None else _greedy(t, vocab if i is not None else ()) for i, t, k in rows}
        assert found == want
        assert "hashpartitioning(id#" not in got._jdf.queryExecution().executedPlan().toString()
    assert X.wordpiece(df.limit(0), "t", pieces, ["id"]).collect() == []


def test_pairs_of_a_form_spread(spark):
    """One form's pairs are many tasks' work; repeated and null keys and entities each form their own pair."""
    asking = [(k if k % 50 else None, 1) for k in range(200)] + [(7, 1), (300, 2), (301, 3)]
    found = [(1, e if e % 30 else None) for e in range(100)] + [(1, 5), (2, 9), (4, 9)]
    want = sorted(((q, e) for q, f in asking for g, e in found if f == g), key=str)
    out = N._pairs(spark.createDataFrame(asking, "q long, form long"), spark.createDataFrame(found, "form long, entity long"), "q", queries=20, entities=16, together=4)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(((r.q, r.entity) for r in got), key=str) == want
    assert len({r.task for r in got}) > 1
    none = spark.createDataFrame([], "form long, entity long")
    assert N._pairs(spark.createDataFrame(asking, "q long, form long"), none, "q").collect() == []


def test_state_diff_moves_states_once(spark):
    """Turns at the edges of spans, one that came twice, a first turn and a null session; one shuffle and no join."""
    state = lambda *on: [(i, f"s{i}", e) for i, e in enumerate(on)]
    rows = [(1, p, state(p % 4 == 0, True)) for p in range(0, 20, 2)] + [(2, 0, state(True)), (2, 0, state(False)), (2, 2, state(True, False)), (2, 6, state(False))]
    rows += [(None, 0, state(True)), (None, 2, state(False))]
    df = spark.createDataFrame(rows, "session_id long, pos long, state array<struct<id:int,slot:string,expressed:boolean>>")
    out = S.state_diff(df, chunk_rows=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = sorted(((r.session_id or 0, r.pos, [c.slot for c in r.changed], r.last_id) for r in out.collect()), key=str)
    want = [(1, p, ["s0"] if p else [], 1) for p in range(0, 20, 2)]
    want += [(2, 0, [], 0), (2, 0, [], 1), (2, 2, [], 0), (2, 2, ["s0"], 0), (2, 6, [], 1), (0, 0, [], 0), (0, 2, [], 1)]
    assert got == sorted(want, key=str)


def test_basic_tokens_variants(spark):
    df = spark.createDataFrame([("Héllo,你好 [SEP] [unused1] a_b\x00!",)], "t string")
    assert one(df.select(X.basic_tokens("t").alias("x"))).x == ["hello", ",", "你", "好", "[SEP]", "[unused1]", "a", "_", "b", "!"]
    low = one(df.select(X.basic_tokens("t", keep="underscore").alias("x"))).x
    assert low[-1] == "a_b!" and "[" in low


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [0.0, 0.0, 0.0], 1)], "a array<double>, b array<double>, y int")
    r = one(df.select(M.argmax("a").alias("m"), M.softmax("b").alias("s"), M.cross_entropy("b", "y").alias("c"), M.kl("a", "a", "plain").alias("k")))
    assert r.m == 1 and r.s == pytest.approx([1 / 3] * 3) and r.c == pytest.approx(1.0986, abs=1e-4) and r.k == pytest.approx(0)
    empty = one(M.class_report(spark.createDataFrame([("other", "other")], "e string, a string"), "e", "a", empty_business=1.0)[1])
    assert (empty.total, empty.business, empty.other) == (1.0, 1.0, 1.0)


def test_sampling(spark):
    df = spark.range(101)
    assert Fi.sample_fraction(df, 10, "id").count() == 10
    b = Sa.batch_assign(df, "id", 10, 2).groupBy("epoch", "batch").count().collect()
    assert sorted(r["count"] for r in b) == [1, 1] + [10] * 20
    head = Fi.sample_fraction(df, 10, "id", shuffle=False, chunk=F.expr("id div 16"))
    assert sorted(r.id for r in head.collect()) == list(range(10))
    first = Sa.batch_assign(df, "id", 5, 2, shuffle=False, chunk=F.expr("id div 16")).filter("batch = 0").groupBy("epoch").agg(F.sort_array(F.collect_list("id")).alias("i"))
    assert [r.i for r in first.collect()] == [list(range(5))] * 2
    with pytest.raises(ValueError):
        Sa.batch_assign(df, "id", 5, shuffle=False)
    hot = df.withColumn("y", F.when(F.col("id") < 100, "big").otherwise("small"))
    n = {r.y: r["count"] for r in Sa.balanced_resample(hot, "y", 2000, "id").groupBy("y").count().collect()}
    assert sum(n.values()) == 2000 and abs(n["small"] - 1000) < 150


def test_belief_columns(spark):
    rows = [([("d-s", "ptr", ["a", "b", "EOS", "c"]), ("d-t", "none", ["x"]), ("d-u", "ptr", ["none", "EOS"])],)]
    df = spark.createDataFrame(rows, "r array<struct<slot:string,gate:string,words:array<string>>>")
    assert one(df.select(Fe.apply_gates("r").alias("b"))).b == ["d-s-a b"]
    p = spark.createDataFrame([(["d-s-v-w"],)], "b array<string>").select(Fe.parse_belief("b").alias("p"))
    assert tuple(one(p).p[0]) == ("d-s", "v-w")


def test_long_look_back(spark):
    from pyspark.sql import functions as F

    from colloquy.operators.ordered import with_preceding

    df = spark.range(5000).select(F.lit("a").alias("key"), F.col("id").alias("pos"))
    got = with_preceding(df, ["key"], "pos", 3000, lambda w: {"n": F.count(F.lit(1)).over(w.rowsBetween(-3000, 0))})
    assert {r.pos: r.n for r in got.collect()}[4500] == 3001


def test_reference_numbers_of_two_digits(spark):
    from colloquy.operators.goals import reference_id

    assert spark.range(1).select(reference_id(__import__("pyspark").sql.functions.lit("near id=12")).alias("r")).first().r == 12


def test_accents_of_every_script(spark):
    df = spark.createDataFrame([("Tiếng Việt Ελλάδα Ǻ e\u0301",)], "t string")
    r = one(df.select(F.array_join(X.basic_tokens("t"), " ").alias("b"), X.normalize_string("t").alias("n")))
    assert r.b == "tieng viet ελλαδα a e" and r.n == "tieng viet a e"


def test_edit_distance_beyond_the_surrogates(spark):
    n = 45_000
    a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    r = one(spark.range(1).select(X._as_chars(F.array(F.lit("t41983"), F.lit("t41984"), F.lit("t45000")), lambda t: F.array_position(a, t)).alias("c")))
    assert len(set(r.c)) == 3 and "?" not in r.c and "\ufffd" not in r.c


def test_constant_order_states_base_intents_only():
    assert not [x for order in K.INTENT_ORDER.values() for x in order if "1" in x]
    assert all(len(set(order)) == len(order) for order in K.INTENT_ORDER.values())
