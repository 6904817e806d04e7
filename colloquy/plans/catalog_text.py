"""Queries over utterance text: tokens, tags, vocabularies, error rates, n-best lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import constants as K
from colloquy.functions import acts as A, encode as E, features as Fe
from colloquy.operators import lookups as L, tagging as G, text as X, vocab as Vo
from colloquy.operators.ordered import with_preceding
from colloquy.operators.sampling import sort_batch_by_length, top_hypotheses
from colloquy.operators.staging import stage
from colloquy.plans import views as V
from colloquy.plans.registry import query

_W = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_CJK = r"list_filter(regexp_split_to_array(regexp_replace({}, '([一-鿿])', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"


# -- tagging -----------------------------------------------------------------------------

_SPANS = f"""
WITH base AS (SELECT session_id, pos, content, {_CJK.format('content')} AS toks FROM v_said),
sp AS (SELECT b.session_id, b.pos, act_ord, intent || '+' || domain || '+' || slot AS label, a.value,
 len({_CJK.format("substr(content, 1, CAST(instr(content, a.value) AS BIGINT) - 1)")}) AS s, len({_CJK.format('a.value')}) AS l
 FROM base b JOIN v_named a ON a.session_id = b.session_id AND a.pos = b.pos
 WHERE intent IN ('Inform', 'Recommend') AND NOT contains(slot, '酒店设施') AND a.value <> '' AND contains(content, a.value)),
tk AS (SELECT session_id, pos, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS j FROM base),
tg AS (SELECT tk.session_id, tk.pos, tk.j, tk.w, arg_min(CASE WHEN j = s THEN 'B+' ELSE 'I+' END || label, act_ord) AS tag
 FROM tk LEFT JOIN sp ON sp.session_id = tk.session_id AND sp.pos = tk.pos AND j >= s AND (j < s + l OR j = s) GROUP BY ALL),
tags AS (SELECT session_id, pos, j, w, coalesce(tag, 'O') AS tag FROM tg)
"""


def tagged(spark, sf):
    t = V.said(spark, sf).withColumn("tokens", G.default_tokens("content"))
    return t.withColumn("tags", G.bio_encode("tokens", G.spans("content", "acts")))


@query("bio_encode", _SPANS + "SELECT session_id, pos, string_agg(w, ' ' ORDER BY j) AS tokens, string_agg(tag, ' ' ORDER BY j) AS tags FROM tags GROUP BY ALL", ("v_said",))
def _(spark, sf):
    return tagged(spark, sf).select("session_id", "pos", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))


@query(
    "golden_acts",
    _SPANS + """, g AS (SELECT a.session_id, a.pos, a.act_ord, intent, domain, slot, CASE WHEN sp.s IS NULL THEN a.value
 ELSE array_to_string(b.toks[sp.s + 1:sp.s + sp.l], '') END AS value FROM v_named a JOIN base b ON a.session_id = b.session_id AND a.pos = b.pos
 LEFT JOIN sp ON sp.session_id = a.session_id AND sp.pos = a.pos AND sp.act_ord = a.act_ord)
SELECT session_id, pos, string_agg(intent || '+' || domain || '+' || slot || '+' || value, ' ' ORDER BY act_ord) AS golden FROM g GROUP BY ALL""",
    ("v_said",),
)
def _(spark, sf):
    t = V.said(spark, sf).withColumn("tokens", G.default_tokens("content"))
    return t.select("session_id", "pos", A.act_texts(G.golden_acts("tokens", "content", "acts")).alias("golden"))


@query(
    "bio_decode",
    _SPANS + r""", t2 AS (SELECT session_id, pos, j, w, CASE WHEN (session_id + j) % 11 = 0 THEN 'O' ELSE tag END AS tag FROM tags),
run AS (SELECT *, sum(CASE WHEN prefix(tag, 'B') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, pos ORDER BY j) AS r FROM t2),
lab AS (SELECT *, first_value(tag) OVER (PARTITION BY session_id, pos, r ORDER BY j) AS b FROM run WHERE r > 0),
ok AS (SELECT *, min(CASE WHEN prefix(tag, 'B') OR (prefix(tag, 'I') AND substr(tag, 3) = substr(b, 3)) THEN 1 ELSE 0 END)
 OVER (PARTITION BY session_id, pos, r ORDER BY j) AS keep FROM lab),
d AS (SELECT session_id, pos, r, substr(any_value(b), 3) || '+' || string_agg(CASE WHEN prefix(tag, 'I') THEN regexp_replace(w, '^##', '') ELSE w END, '' ORDER BY j) AS act
 FROM ok WHERE keep = 1 GROUP BY ALL)
SELECT s.session_id, s.pos, coalesce(string_agg(act, ' ' ORDER BY r), '') AS acts FROM v_said s LEFT JOIN d ON d.session_id = s.session_id AND d.pos = s.pos GROUP BY ALL""",
    ("v_said",),
)
def _(spark, sf):
    t = tagged(spark, sf)
    broken = F.transform("tags", lambda x, j: F.when((F.col("session_id") + j) % 11 == 0, "O").otherwise(x))
    return t.select("session_id", "pos", A.act_texts(G.bio_decode("tokens", broken)).alias("acts"))


@query(
    "tag_vocabulary",
    _SPANS + """SELECT item, row_number() OVER (ORDER BY s, p, j) - 1 AS id FROM (SELECT tag AS item, min(o) AS o, arg_min(session_id, o) AS s, arg_min(pos, o) AS p, arg_min(j, o) AS j
 FROM (SELECT *, session_id * 100000000 + pos * 10000 + j AS o FROM tags) GROUP BY tag)""",
    ("v_said",),
)
def _(spark, sf):
    return Vo.first_seen_vocabulary(tagged(spark, sf), "tags", ["session_id", "pos"]).select("item", "id")


@query(
    "tag_ids",
    _SPANS + """, voc AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (SELECT DISTINCT tag FROM tags WHERE NOT prefix(tag, 'I')))
SELECT s.session_id, s.pos, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY j), '') AS ids, coalesce(string_agg(CASE WHEN id IS NOT NULL THEN t.tag END, ' ' ORDER BY j), '') AS names
FROM v_said s LEFT JOIN tags t ON t.session_id = s.session_id AND t.pos = s.pos LEFT JOIN voc ON voc.tag = t.tag GROUP BY ALL""",
    ("v_said",),
)
def _(spark, sf):
    t = stage(tagged(spark, sf).select("session_id", "pos", "tags"))
    names = t.select(F.explode("tags").alias("tag")).filter("tag not like 'I%'").distinct()
    vocab = Vo.numbered(names, "tag", chunk=F.substring("tag", 1, 16)).select(F.col("tag").alias("token"), F.col("id").cast("int").alias("value"))
    mapped = L.token_maps(t, "tags", vocab, ["session_id", "pos"])
    back = F.map_from_arrays(F.map_values("_m"), F.map_keys("_m"))
    ids = mapped.withColumn("ids", E.tags_to_ids("tags", F.col("_m"))).withColumn("names", F.transform("ids", lambda i: F.try_element_at(back, i)))
    return ids.select(
        "session_id", "pos", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.array_join("names", " ").alias("names")
    )


@query(
    "align_tags_to_pieces",
    _SPANS + """, x AS (SELECT session_id, pos, j, tag, unnest(range(0, 1 + length(w) // 3)) AS k FROM tags)
SELECT session_id, pos, string_agg(tag, ' ' ORDER BY j, k) AS piece_tags, string_agg(CAST(j AS VARCHAR), ' ' ORDER BY j, k) AS words FROM x GROUP BY ALL""",
    ("v_said",),
)
def _(spark, sf):
    t = tagged(spark, sf).withColumn("n", F.transform("tokens", lambda w: (1 + F.floor(F.length(w) / 3)).cast("int")))
    return t.select(
        "session_id", "pos", F.array_join(G.align_tags_to_pieces("tags", "n"), " ").alias("piece_tags"),
        F.array_join(F.transform(G.piece_word_index("n"), lambda i: i.cast("string")), " ").alias("words"),
    )


# -- vocabularies and lengths -----------------------------------------------------------------


@query(
    "first_seen_vocabulary",
    f"""SELECT item, 3 + row_number() OVER (ORDER BY o) AS id, freq FROM (SELECT w AS item, min(session_id * 100000000 + pos * 10000 + i) AS o, count(*) AS freq FROM
 (SELECT session_id, pos, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS i FROM v_turns) WHERE w NOT IN ('UNK', 'PAD', 'EOS', 'SOS') GROUP BY w)""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf).withColumn("tokens", F.split("content", " "))
    return Vo.first_seen_vocabulary(t, "tokens", ["session_id", "pos"], specials=list(K.TRACKER_SPECIALS))


@query(
    "length_histogram",
    f"""WITH h AS (SELECT role, CAST(len({_W.format('content')}) AS BIGINT) AS length, count(*) AS n FROM v_turns GROUP BY ALL)
SELECT role, length, n, max(length) OVER (PARTITION BY role) AS longest FROM h""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf).withColumn("len", F.size(V.words(F.col("content"))))
    return Vo.length_histogram(t, "len", ["role"])


@query(
    "context_length_histogram",
    f"""WITH c AS (SELECT coalesce(sum(len({_W.format('content')})) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS len FROM v_turns),
h AS (SELECT CAST(len AS BIGINT) AS length, count(*) AS n FROM c GROUP BY ALL) SELECT length, n, max(length) OVER () AS longest FROM h""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf).withColumn("len", F.size(V.words(F.col("content"))).cast("bigint"))
    t = with_preceding(t, ["session_id"], "pos", 3, lambda w: {"ctx": F.coalesce(F.sum("len").over(w.rowsBetween(-3, -1)), F.lit(0))})
    return Vo.length_histogram(t, "ctx")


@query(
    "token_ids",
    f"""WITH tk AS (SELECT session_id, pos, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT session_id, pos, {_W.format('content')} AS toks FROM v_turns)),
voc AS (SELECT t, row_number() OVER (ORDER BY c, t) + 3 AS id FROM (SELECT t, count(*) AS c FROM tk GROUP BY t HAVING count(*) > 3)),
r AS (SELECT session_id, pos, string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY i) || ' 2' AS ids FROM tk LEFT JOIN voc ON voc.t = tk.t GROUP BY ALL)
SELECT v.session_id, v.pos, coalesce(ids, '2') AS ids FROM v_turns v LEFT JOIN r ON r.session_id = v.session_id AND r.pos = v.pos""",
    ("v_turns",),
)
def _(spark, sf):
    t = stage(V.turns(spark, sf).select("session_id", "pos", V.words(F.col("content")).alias("tokens")))
    voc = Vo.token_vocabulary(t, "tokens")
    out = L.token_ids(t, "tokens", voc, 3, ["session_id", "pos"], append=[2])
    return out.select("session_id", "pos", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query(
    "sample_fraction",
    """WITH r AS (SELECT session_id, pos, row_number() OVER (ORDER BY md5('10|' || session_id || '|' || pos), session_id, pos) AS rn, count(*) OVER () AS n FROM v_turns)
SELECT session_id, pos FROM r WHERE rn <= floor(n * 30.0 / 100.0)""",
    ("v_turns",),
)
def _(spark, sf):
    from colloquy.operators.filters import sample_fraction

    return sample_fraction(V.turns(spark, sf).select("session_id", "pos"), 30, ["session_id", "pos"])


@query(
    "sample_fraction_in_order",
    """WITH r AS (SELECT session_id, pos, row_number() OVER (ORDER BY session_id, pos) AS rn, count(*) OVER () AS n FROM v_turns)
SELECT session_id, pos FROM r WHERE rn <= floor(n * 30.0 / 100.0)""",
    ("v_turns",),
)
def _(spark, sf):
    from colloquy.operators.filters import sample_fraction

    t = V.turns(spark, sf).select("session_id", "pos")
    return sample_fraction(t, 30, ["session_id", "pos"], shuffle=False, chunk=F.expr("session_id div 64"))


@query(
    "sort_batch_by_length",
    f"""SELECT session_id // 16 AS batch, session_id, pos, row_number() OVER (PARTITION BY session_id // 16 ORDER BY len({_W.format('content')}) DESC, session_id, pos) AS rank FROM v_turns""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf).withColumn("batch", F.expr("session_id div 16")).withColumn("len", F.size(V.words(F.col("content"))))
    return sort_batch_by_length(t, "batch", "len", ["session_id", "pos"], F.expr("pos div 1024")).select("batch", "session_id", "pos", "rank")


@query(
    "truncate_text",
    f"SELECT session_id, pos, array_to_string({_W.format('content')}[1:7], ' ') AS tokens, array_to_string(string_split(content, ' ')[1:5], ' ') AS words FROM v_turns",
    ("v_turns",),
)
def _(spark, sf):
    return V.turns(spark, sf).select(
        "session_id", "pos", F.array_join(E.truncate(V.words(F.col("content")), 7), " ").alias("tokens"), E.truncate_words("content", 5).alias("words")
    )


@query(
    "pad_batch",
    f"""WITH t AS (SELECT session_id, pos, session_id // 16 AS batch, {_W.format('content')} AS toks FROM v_turns), m AS (SELECT batch, max(len(toks)) AS n FROM t GROUP BY batch)
SELECT session_id, pos, array_to_string(list_resize(toks, n, '[PAD]'), ' ') AS tokens, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i < len(toks) THEN 1 ELSE 0 END), '') AS mask
FROM t JOIN m ON m.batch = t.batch""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf).select("session_id", "pos", F.expr("session_id div 16").alias("batch"), V.words(F.col("content")).alias("toks"))
    widths = t.groupBy("batch").agg(F.max(F.size("toks")).alias("n"))
    j = t.join(widths, "batch")
    padded = F.concat("toks", F.array_repeat(F.lit("[PAD]"), F.col("n") - F.size("toks")))
    return j.select(
        "session_id", "pos", F.array_join(padded, " ").alias("tokens"),
        F.array_join(E.length_mask(F.size("toks"), F.col("n")), "").alias("mask"),
    )


# -- tokenisers and normalisers ------------------------------------------------------------------

_BASIC = r"""list_filter(regexp_split_to_array(
 regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\p{Cf}\p{Co}]', '', 'g'), '[\t\n\r\p{Zs}]', ' ', 'g'))), '\p{Mn}', '', 'g'),
 '([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}])', ' \1 ', 'g'), ' '), lambda w: w <> '')"""


@query("basic_tokens", f"SELECT doc_id, array_to_string({_BASIC}, ' ') AS tokens FROM documents")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.basic_tokens("text").alias("toks"))
    return d.select("doc_id", F.array_join("toks", " ").alias("tokens"))


@query(
    "normalize_string",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '([,.!?])', ' \1 ', 'g'), '[^a-zA-Z,.!?]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents""",
)
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.normalize_string("text").alias("text"))


@query("whitespace_segment", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.whitespace_segment("text").alias("text"))


@query(
    "expand_contractions",
    f"""SELECT doc_id, array_to_string(list_transform({_W.format('text')}, lambda w: CASE w WHEN 'the' THEN 'the one' WHEN 'and' THEN '&' WHEN 'que' THEN 'quoi' ELSE w END), ' ') AS text FROM documents""",
)
def _(spark, sf):
    pairs = E.literal_map({"the": "the one", "and": "&", "que": "quoi"})
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.expand_contractions(V.words(F.col("text")), pairs), " ").alias("text"))


@query(
    "wordpiece",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {_BASIC} AS toks FROM documents), tk AS (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM d),
ty AS (SELECT DISTINCT t FROM tk),
voc AS (SELECT DISTINCT CASE WHEN i > 1 THEN '##' ELSE '' END || substr(t, i, 2) AS piece FROM (SELECT t, unnest(range(1, length(t) + 1, 2)) AS i FROM ty)),
rec AS (SELECT t, CAST(1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS out FROM ty WHERE length(t) <= 100
 UNION ALL SELECT r.t, r.pos + CASE WHEN v2.piece IS NOT NULL THEN 2 ELSE 1 END, list_append(r.out, coalesce(v2.piece, v1.piece))
 FROM rec r LEFT JOIN voc v2 ON r.pos < length(r.t) AND v2.piece = CASE WHEN r.pos > 1 THEN '##' ELSE '' END || substr(r.t, r.pos, 2)
 LEFT JOIN voc v1 ON v1.piece = CASE WHEN r.pos > 1 THEN '##' ELSE '' END || substr(r.t, r.pos, 1)
 WHERE r.pos <= length(r.t) AND (v2.piece IS NOT NULL OR v1.piece IS NOT NULL)),
done AS (SELECT t, out FROM rec WHERE pos = length(t) + 1)
SELECT d.doc_id, coalesce(p, '') AS pieces FROM d LEFT JOIN (SELECT doc_id, string_agg(coalesce(array_to_string(out, ' '), '[UNK]'), ' ' ORDER BY i) AS p
 FROM tk LEFT JOIN done ON done.t = tk.t GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
)
def _(spark, sf):
    """Pieces of every document against the one- and two-letter pieces of the corpus' own vocabulary."""
    d = stage(V.table(spark, sf, "documents").select("doc_id", X.basic_tokens("text").alias("toks"), F.monotonically_increasing_id().alias("place")))
    tokens = d.select(F.explode(F.array_distinct("toks")).alias("t")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("t"), F.lit(2)), lambda i: F.concat(F.when(i > 1, "##").otherwise(""), F.substring("t", i, F.lit(2))))
    vocab = tokens.select(F.explode(cut).alias("token")).distinct()
    return X.wordpiece(d, "toks", stage(vocab), ["doc_id"], place="place").select("doc_id", F.array_join("pieces", " ").alias("pieces"))


# -- error rates ------------------------------------------------------------------------------------

_WER = r"""
WITH RECURSIVE p AS (SELECT session_id, pos, """ + _W.format("ref") + " AS r, " + _W.format("hyp") + r""" AS h FROM v_pairs),
d AS (SELECT session_id, pos, r, h, CAST(0 AS BIGINT) AS i, range(0, len(h) + 1) AS prev FROM p
 UNION ALL
 SELECT session_id, pos, r, h, i, list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(cand[1:j], lambda c, k: c + j - k))) AS prev FROM (
  SELECT session_id, pos, r, h, i + 1 AS i, [i + 1] || list_transform(range(1, len(h) + 1), lambda j: least(prev[j + 1] + 1, prev[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END)) AS cand
  FROM d WHERE i < len(r))),
e AS (SELECT session_id, pos, CAST(prev[len(h) + 1] AS BIGINT) AS edits, CAST(len(r) AS BIGINT) AS ref_len FROM d WHERE i = len(r))
"""


@query("wer", _WER + "SELECT session_id, pos, edits, ref_len, CASE WHEN ref_len > 0 THEN round(edits / ref_len * 100, 6) END AS wer FROM e", ("v_pairs",))
def _(spark, sf):
    return word_errors(spark, sf).select("session_id", "pos", "edits", "ref_len", "wer")


@query(
    "corpus_wer",
    _WER + """SELECT role, count(*) AS n, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_len) AS BIGINT) AS ref_len,
 round(sum(edits) / sum(ref_len) * 100, 6) AS wer FROM e JOIN (SELECT session_id, pos, role FROM v_pairs) USING (session_id, pos) GROUP BY ALL""",
    ("v_pairs",),
)
def _(spark, sf):
    return X.corpus_wer(word_errors(spark, sf), ["role"])


def word_errors(spark, sf):
    p = V.pairs(spark, sf).select("session_id", "pos", "role", V.words(F.col("hyp")).alias("h"), V.words(F.col("ref")).alias("r"))
    return X.wer(p, "r", "h")


@query(
    "encode_pair",
    f"""WITH p AS (SELECT session_id, pos, {_W.format('hyp')} AS a, {_W.format('ref')} AS b FROM v_pairs),
l AS (SELECT *, len(a) AS la, len(b) AS lb, CASE WHEN len(a) + len(b) <= 61 THEN len(a) WHEN len(b) <= 30 THEN 61 - len(b) WHEN len(a) <= 31 THEN len(a) ELSE 31 END AS ka FROM p),
k AS (SELECT *, CASE WHEN la + lb <= 61 THEN lb ELSE 61 - ka END AS kb FROM l),
t AS (SELECT *, ['[CLS]'] || a[1:ka] || ['[SEP]'] || b[1:kb] || ['[SEP]'] AS toks FROM k)
SELECT session_id, pos, array_to_string(list_resize(toks, 64, '[PAD]'), ' ') AS tokens,
 array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN i >= ka + 2 AND i < len(toks) THEN 1 ELSE 0 END), '') AS segments,
 array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN i < len(toks) THEN 1 ELSE 0 END), '') AS mask FROM t""",
    ("v_pairs",),
)
def _(spark, sf):
    p = V.pairs(spark, sf)
    e = p.select("session_id", "pos", E.encode_pair(V.words(F.col("hyp")), V.words(F.col("ref")), 64).alias("e"))
    return e.select(
        "session_id", "pos", F.array_join("e.tokens", " ").alias("tokens"), F.array_join("e.segments", "").alias("segments"),
        F.array_join("e.mask", "").alias("mask"),
    )


# -- n-best ---------------------------------------------------------------------------------------------


@query("top_hypotheses", "SELECT utt_id, rank, content FROM v_nbest WHERE rank < 3", ("v_nbest",))
def _(spark, sf):
    return top_hypotheses(V.nbest(spark, sf), 3).select("utt_id", "rank", "content")


@query(
    "flatten_nbest",
    """WITH x AS (SELECT utt_id, unnest(range(0, 10)) AS r FROM (SELECT DISTINCT utt_id FROM v_nbest)),
p AS (SELECT x.utt_id, r, array_to_string(list_resize(coalesce(tokens, []), 80, '<PAD>')[1:80], ' ') AS row FROM x LEFT JOIN v_nbest n ON n.utt_id = x.utt_id AND n.rank = x.r)
SELECT utt_id, string_agg(row, ' ' ORDER BY r) AS flat, max(CASE WHEN r = 1 THEN row END) AS second FROM p GROUP BY utt_id""",
    ("v_nbest",),
)
def _(spark, sf):
    from colloquy.operators.sampling import flatten_nbest

    f = flatten_nbest(V.nbest(spark, sf), 10, 80, "<PAD>")
    return f.select("utt_id", F.array_join("flat", " ").alias("flat"), F.array_join(F.get(E.unflatten("flat", 80, 10), F.lit(1)), " ").alias("second"))


@query(
    "combine_am_lm",
    """SELECT utt_id, round(sum(am), 6) AS am, round(sum(lm), 6) AS lm, round(sum((am + lm) / 2), 6) AS am_lm, count(*) AS n
FROM v_nbest GROUP BY utt_id""",
    ("v_nbest",),
)
def _(spark, sf):
    n = V.nbest(spark, sf).groupBy("utt_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "am", "lm"))), lambda x: F.array(x["am"], x["lm"]))).alias("pairs")
    )
    total = lambda m: F.round(F.aggregate(E.combine_am_lm("pairs", m), F.lit(0.0), lambda a, x: a + x), 6).alias(m)
    return n.select("utt_id", total("am"), total("lm"), total("am_lm"), (F.size("pairs") / 2).cast("bigint").alias("n"))


@query(
    "header_positions",
    """WITH g AS (SELECT utt_id, list(CAST(rank * 3 AS BIGINT) ORDER BY rank) AS ids, list(am ORDER BY rank) AS s FROM v_nbest WHERE rank < 20 GROUP BY utt_id)
SELECT utt_id, array_to_string(list_resize(list_transform(ids, lambda i: i + 1), 20, 0), ' ') AS ids, round(list_sum(s), 6) AS total, CAST(len(list_resize(s, 20, 0.0)) AS BIGINT) AS width FROM g""",
    ("v_nbest",),
)
def _(spark, sf):
    n = top_hypotheses(V.nbest(spark, sf), 20).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("rank", "am"))).alias("h"))
    e = n.select("utt_id", E.header_positions(F.transform("h", lambda x: x["rank"] * 3), F.transform("h", lambda x: x["am"])).alias("e"))
    return e.select(
        "utt_id", F.array_join(F.transform("e.ids", lambda i: i.cast("string")), " ").alias("ids"),
        F.round(F.aggregate("e.scores", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("e.scores").cast("bigint").alias("width"),
    )


# -- memory records and KB words -------------------------------------------------------------------------


@query(
    "memory_triples",
    """SELECT session_id, pos, string_agg(w || '|' || CASE role WHEN 'usr' THEN '$u' ELSE '$s' END || '|turn' || (pos // 2 + 1) || '|word' || (i - 1), ' ' ORDER BY i) AS memory
FROM (SELECT session_id, pos, role, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS i FROM v_turns) GROUP BY ALL""",
    ("v_turns",),
)
def _(spark, sf):
    t = V.turns(spark, sf)
    m = Fe.memory_triples("content", F.when(F.col("role") == "usr", "$u").otherwise("$s"), F.expr("pos div 2 + 1"))
    return t.select("session_id", "pos", F.array_join(F.transform(m, lambda r: F.array_join(r, "|")), " ").alias("memory"))


@query(
    "kb_memory",
    """SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey || '|R_rating|' || p_size || '|PAD'
 ELSE p_brand || '|R_brand|b' || p_partkey || '|PAD' END AS memory FROM part""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    line = F.when(
        F.col("p_partkey") % 3 == 0, F.concat(F.lit("b"), "p_partkey", F.lit(" R_rating "), "p_size")
    ).otherwise(F.concat(F.lit("b"), "p_partkey", F.lit(" R_brand "), "p_brand"))
    return p.select(F.col("p_partkey").alias("ord"), F.array_join(Fe.kb_memory(line), "|").alias("memory"))


@query(
    "delexicalize_sentences",
    """WITH t AS (SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'R_rating' WHEN p_partkey % 3 = 1 THEN 'R_type' ELSE 'R_brand' END AS relation,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_type ELSE p_brand END AS value FROM part),
tv AS (SELECT type, value, min(ord) AS first FROM (SELECT 'R_restaurant' AS type, name AS value, ord FROM t UNION ALL SELECT relation, value, ord FROM t) GROUP BY ALL),
o AS (SELECT type, CASE WHEN type = 'R_restaurant' THEN -1 ELSE min(first) END AS o FROM tv GROUP BY type),
wt AS (SELECT value, arg_min(tv.type, o) AS type FROM tv JOIN o ON o.type = tv.type WHERE tv.type <> 'R_rating' GROUP BY value),
tk AS (SELECT p_partkey, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM (SELECT p_partkey, [p_brand, 'is', p_type, 'size', CAST(p_size AS VARCHAR), p_name] AS toks FROM part)),
s AS (SELECT p_partkey AS id, string_agg(coalesce(type, w), ' ' ORDER BY i) AS delex FROM tk LEFT JOIN wt ON wt.value = w GROUP BY p_partkey)
SELECT s.id, delex, dense_rank() OVER (ORDER BY delex) - 1 AS candidate FROM s""",
)
def _(spark, sf):
    from colloquy.plans.catalog_entities import kb_triples

    types = stage(L.kb_type_values(kb_triples(spark, sf)))
    p = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array("p_brand", F.lit("is"), "p_type", F.lit("size"), F.col("p_size").cast("string"), "p_name").alias("tokens")
    )
    d = stage(L.delexicalize_sentences(p, "tokens", types, ["id"]).select("id", "delex"))
    ids = Vo.numbered(d.select("delex").distinct(), "delex", out="candidate", chunk=F.substring("delex", 1, 32))
    return d.join(ids, "delex").select("id", "delex", "candidate")


@query(
    "numbered_dialogues",
    r"""WITH t AS (SELECT *, string_split(content, ' ') AS w FROM v_exchanges),
ex AS (SELECT u.session_id, u.pos // 2 AS i, u.content AS usr, s.content AS bot, u.w AS uw, s.w AS bw FROM t u JOIN t s ON s.session_id = u.session_id AND s.pos = u.pos + 1 WHERE u.pos % 2 = 0),
mem AS (SELECT session_id, 2 * i AS blk, i AS vis, unnest(uw) AS word, generate_subscripts(uw, 1) - 1 AS k FROM ex
 UNION ALL SELECT session_id, 2 * i + 1, i + 1, unnest(bw), generate_subscripts(bw, 1) - 1 FROM ex),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY blk, k) - 1 AS p FROM mem),
q AS (SELECT DISTINCT session_id, i, unnest(bw) AS word FROM ex),
l AS (SELECT q.session_id, q.i, q.word, max(m.p) AS last_pos FROM q JOIN m ON m.session_id = q.session_id AND m.word = q.word AND m.vis <= q.i GROUP BY ALL)
SELECT session_id, i + 1 AS turn_id, word, last_pos FROM l""",
    ("v_exchanges",),
)
def _(spark, sf):
    from colloquy.sources.dialogues import memory_positions

    t = V.exchanges(spark, sf)
    usr = t.filter("pos % 2 = 0").select("session_id", F.expr("pos div 2 + 1").alias("turn_id"), F.col("content").alias("usr"))
    bot = t.filter("pos % 2 = 1").select("session_id", F.expr("pos div 2 + 1").alias("turn_id"), F.col("content").alias("bot"))
    return memory_positions(usr.join(bot, ["session_id", "turn_id"]), "session_id")
