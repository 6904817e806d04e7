"""Frequent keys, counted models and draws against plain rules."""

import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from colloquy.functions import encode as E, features as Fe
from colloquy.operators import bayes, lookups as L, sampling as Sa, state as St, text as X, vocab as Vo


def test_spread_join_equals_plain_join(spark):
    """One key with half of the rows, keys without a partner and null keys."""
    words = ["the"] * 500 + [f"w{i % 97}" for i in range(400)] + [None] * 50 + ["lonely"] * 50
    rows = spark.createDataFrame(list(enumerate(words)), "id long, k string").repartition(4)
    table = spark.createDataFrame([("the", 1), ("the", 2), *((f"w{i}", i) for i in range(90)), (None, 7), ("unused", 8)], "k string, v int")
    want = sorted(tuple(r) for r in rows.join(table, "k").select("id", "k", "v").collect())
    for share, copies in ((L.HOT_SHARE, L.COPIES), (3, 5), (1, 2)):
        got = L.spread_join(rows, table, "k", ["id"], share, copies)
        assert sorted(tuple(r) for r in got.select("id", "k", "v").collect()) == want
    places = rows.filter("k = 'the'").select(F.countDistinct(F.pmod(F.xxhash64("id"), F.lit(L.COPIES)))).first()[0]
    assert places == L.COPIES
    assert L.spread_join(rows.limit(0), table, "k", ["id"]).count() == 0
    assert L.spread_join(rows, table.limit(0), "k", ["id"]).count() == 0


def test_token_maps_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, []), (3, None), (4, ["z"])], "id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    got = {r.id: r.ids for r in L.token_ids(rows, "tokens", vocab, 0, ["id"], append=[9]).collect()}
    assert got == {1: [5, 6, 5, 0, 9], 2: [9], 3: None, 4: [0, 9]}


def brute_bayes(train, test, weight):
    """Scores by label, counted with plain dictionaries."""
    docs, seen = Counter(l for l, _ in train), defaultdict(Counter)
    for l, toks in train:
        seen[l].update(toks)
    types = {t for c in seen.values() for t in c}
    whole = sum(n * weight[l] for l, n in docs.items())
    m = lambda x: round(math.log(x) * 1e6)
    out = {}
    for i, toks in test.items():
        known = [t for t in toks if t in types]
        out[i] = {
            l: m(docs[l] * weight[l] / whole) + sum(m(seen[l][t] * weight[l] + 1) for t in known) - len(known) * m(sum(seen[l].values()) * weight[l] + max(len(types), 1))
            for l in docs
        }
    return out


def test_naive_bayes_equals_counting(spark):
    train = [("x", ["a", "a", "b"]), ("x", ["a", "c"]), ("y", ["c", "d", "d"]), ("y", []), ("z", ["d", "e", "#"]), ("z", ["a"] * 300)]
    test = {1: ["a", "b"], 2: ["d", "e", "e", "new"], 3: [], 4: ["new"], 5: ["c"] * 4, 6: ["a"] * 50}
    weight = {"x": 0.5, "y": 0.75, "z": 0.25}
    tr = spark.createDataFrame([*train, (None, ["a"]), ("x", None)], "label string, tokens array<string>")
    te = spark.createDataFrame([*test.items(), (7, None)], "id long, tokens array<string>")
    w = spark.createDataFrame(list(weight.items()), "label string, weight double")
    out = bayes.scores(bayes.fit(tr, "tokens", "label", w), te, "tokens", ["id"]).collect()
    want = brute_bayes([*train, ("x", [])], {**test, 7: []}, weight)
    assert {r.id: {s.label: s.score for s in r.scores} for r in out} == want
    assert {r.id: r.pred for r in out} == {i: min(s, key=lambda l: (-s[l], l)) for i, s in want.items()}


def test_naive_bayes_ties_and_empty_tables(spark):
    tr = spark.createDataFrame([("b", ["t"]), ("a", ["t"])], "label string, tokens array<string>")
    te = spark.createDataFrame([(1, ["t"])], "id long, tokens array<string>")
    model = bayes.fit(tr, "tokens", "label")
    assert bayes.scores(model, te, "tokens", ["id"]).first().pred == "a"
    assert bayes.scores(model, te.limit(0), "tokens", ["id"]).count() == 0
    nothing = bayes.scores(bayes.fit(tr.limit(0), "tokens", "label"), te, "tokens", ["id"]).first()
    assert nothing.pred is None and nothing.scores == []


def test_weighted_choice_over_many_small_and_one_large_weight(spark):
    weights = [("big", 5000.0), *((f"i{k:03}", 0.25 * (k % 4)) for k in range(300)), (None, 3.0)]
    w = spark.createDataFrame(weights, "item string, weight double")
    draws = spark.range(2000).withColumnRenamed("id", "draw")
    got = {r.draw: r.item for r in Sa.weighted_choice(w, draws).collect()}
    line, at = [], 0.0
    for name, size in sorted((n, x) for n, x in weights if n and x > 0):
        at += size
        line.append((at, name))
    u = lambda d: int(hashlib.md5(f"0|{d}".encode()).hexdigest()[:13], 16) / 16**13
    assert got == {d: next(n for hi, n in line if u(d) * at < hi) for d in range(2000)}
    assert {r.item for r in Sa.weighted_choice(w.limit(0), draws).collect()} == {None}


def test_lengths_ranked_by_counting(spark):
    rows = [(b, i, (i * 7) % 5 if i % 11 else None) for b in (0, 1) for i in range(3000 if b else 40)]
    df = spark.createDataFrame(rows, "batch long, id long, n int").withColumn("one", F.lit(0))
    for got in (Sa.sort_batch_by_length(df, "batch", "n", ["id"]), Sa.sort_batch_by_length(df, "batch", "n", ["one", "id"], F.expr("id div 64"))):
        order = defaultdict(list)
        for b, i, n in sorted(rows, key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1])):
            order[b].append(i)
        assert {(r.batch, r.id): r["rank"] for r in got.collect()} == {(b, i): k + 1 for b, ids in order.items() for k, i in enumerate(ids)}


def test_numbers_run_over_chunks(spark):
    words = sorted({f"{a}{b}" for a in "abcé中" for b in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "name string").repartition(7)
    rising = {r.name: r.id for r in Vo.numbered(df, "name", chunk=F.substring("name", 1, 1)).collect()}
    order = sorted(words, key=lambda w: w.encode())
    assert rising == {w: i for i, w in enumerate(order)}
    assert {r.name: r.id for r in Vo.feature_cardinality(df).collect()} == {w: i for i, w in enumerate(reversed(order))}


def test_edit_distance_of_empty_and_shortened(spark):
    none = F.array().cast("array<string>")
    a = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: (i * 750).cast("string"))
    row = spark.range(1).select(X.edit_distance(a, F.slice(a, 2, 58)).alias("e"), X.edit_distance(a, none).alias("none"), X.edit_distance(none, none).alias("zero"))
    assert tuple(row.first()) == (2, 60, 0)
    # among 3,000 tokens some share a hash
    many = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    pair = spark.range(1).select(many.alias("a"), F.slice(many, 2, 2998).alias("b"))
    codes = pair.select(F.size(F.array_distinct(F.transform("a", lambda t: F.pmod(F.xxhash64(t), F.lit(X._CODES))))).alias("n")).first().n
    assert codes < 3000
    assert pair.select(X.edit_distance("a", "b").alias("e")).first().e == 2


def test_item_pairs_of_long_and_equal_lists(spark):
    """A list longer than a part, copies of lists, repeated and null items."""
    lists = {0: [f"x{i}" for i in range(60)], 1: ["a", "b", "b"], 2: ["b", "a"], 3: ["a"], 4: ["c", None, "a"], 5: [None], 6: ["x1", "a", "x2"]}
    rows = spark.createDataFrame([(k, x) for k, xs in lists.items() for x in xs], "key long, item string")
    want = Counter()
    for xs in lists.values():
        s = {x for x in xs if x is not None}
        want.update((a, b) for a in s for b in s if a != b)
    for part in (256, 7, 1):
        got = {(r.item, r.other): r.n for r in L.item_pairs(rows, "key", "item", part=part).collect()}
        assert got == dict(want)
    often = {(r.item, r.other): r.n for r in L.item_pairs(rows, "key", "item", 2).collect()}
    assert often == {p: n for p, n in want.items() if n >= 2}
    assert L.item_pairs(rows.limit(0), "key", "item").count() == 0
    edges = {(r.item, r.other): (r.n, r.pmi) for r in L.edge_weights(rows, "key", "item").collect()}
    assert edges == {("x1", "x2"): (2, round(math.log(2 * 6 / 4), 6)), ("a", "b"): (2, round(math.log(2 * 6 / 10), 6))}


def test_history_across_spans(spark):
    rows = [(s, i, f"s{i}" if i % 3 else "", f"u{s}.{i}") for s in (1, 2) for i in range(0, 40 if s == 1 else 3)]
    df = spark.createDataFrame(rows, "session_id long, i long, sys string, usr string")
    for n in (512, 4, 1):
        got = {(r.session_id, r.i): (r.history, r.turn_text) for r in St.dialog_history(df, chunk_rows=n).collect()}
        text, want = {1: "", 2: ""}, {}
        for s, i, a, b in rows:
            text[s] += f"{a} ; {b} ; "
            want[s, i] = (text[s].strip(" "), f"{a} ; {b}".strip(" "))
        assert got == want


def test_act_ids_and_vectors_of_the_data(spark):
    """Acts outside the vocabulary have no id; an absent list is an empty one; ids read back as names."""
    act = "struct<intent:string,domain:string,slot:string,value:string>"
    rows = [(1, "usr", [("Inform", "d", "s", "v"), ("Request", "d", "t", "")]), (2, "sys", [("Inform", "d", "s", "w"), ("Inform", "d", "s", "x")]), (3, "sys", [])]
    turns = spark.createDataFrame(rows, f"pos long, role string, acts array<{act}>")
    vocab = Vo.act_vocabulary(turns)
    assert sorted(map(tuple, vocab.collect())) == [("sys", "Inform+d+s+1", 0), ("sys", "Inform+d+s+2", 1), ("usr", "Inform+d+s+1", 0), ("usr", "Request+d+t+", 1)]
    more = turns.unionByName(spark.createDataFrame([(4, "usr", [("Select", "d", "s", "new"), ("Request", "d", "t", "")]), (5, "usr", None)], turns.schema))
    got = {r.pos: (r.act_ids, r.act_names) for r in Vo.act_ids(more, vocab, ["pos"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [0, 1], 2: [0, 1], 3: [], 4: [1], 5: None}
    assert got[4][1] == {1: "Request+d+t+"}
    assert tuple(Vo.act_dims(vocab).first()) == (2, 2) and tuple(Vo.act_dims(vocab.limit(0)).first()) == (0, 0)
    ids = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    one = spark.range(1).select(Fe.state_vector(ids(1), F.lit(None).cast("array<int>"), ids(1, 0), F.lit(3), F.lit(1), 2, 3).alias("v"), E.hot_ids(ids(0, 1, 1)).alias("h"), E.multi_hot_ids(ids(), 0).alias("z")).first()
    assert (one.v, one.h, one.z) == ([0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 1], [1, 2], [])
