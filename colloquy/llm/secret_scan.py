"""Secrets in texts: plain finds, and the scattered parts of credentials that only together mean something.

One scan matches every kind of part in the whole text; a match's place is the running sum of the lengths of the pieces
between matches. Plain finds (assignments, access identifiers, hexadecimal strings) are always reported. Weak candidates
(names of accounts, token-like strings, endpoints) are not, unless complementary parts co-occur: parts are joined by
interval, within one paragraph and at most ``REACH`` code points apart. An account name needs a secret, a token-like string
an identifier, an endpoint both; a weak candidate that overlaps a plain find is that find and goes.

The join runs over bins of ``REACH`` code points. Spans of a kind do not overlap, so a bin holds a bounded number of them
and its pairs grow with the text, never with its square. Rows are numbered once in a staged table, so repeated or null
identifiers stay apart and a lost executor cannot renumber them. Built-in functions only; only finds are shuffled.

A null text counts as empty; texts without finds return with counts 0 and no spans; an empty table gives no rows; repeated
rows are scanned each on their own; only the two named columns are read, so others cannot clash. Patterns are linear
in a text of any length. Of parts with one start the kind listed first comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy.operators.staging import stage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""((?i:user(?:name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@-]+"
BREAK = r"\n[\x20\t\r]*\n"
# Kinds in the order of the report; the last one only bounds scopes.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint", "break")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, ACCOUNT, OPAQUE, ENDPOINT, BREAK)))
LEAST_VALUE = {"assign": 6, "account": 3}
PLAIN, WEAK = KINDS[:3], KINDS[3:6]
IDENTIFIERS, SECRETS = ("access", "account"), ("assign", "hex", "opaque")
NEEDS = {"account": ("secret",), "opaque": ("identifier",), "endpoint": ("identifier", "secret")}
REACH = 200


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, found, keep>>: the matches of a kind in order, each with the length of the piece before it."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.char_length)
    if kind in LEAST_VALUE:
        keep = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.char_length(v) >= LEAST_VALUE[kind])
    elif kind == "opaque":
        keep = F.transform(found, lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
    else:
        keep = F.transform(found, lambda v: F.lit(True))
    rows = F.transform(
        F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), keep.alias("keep")), lambda x: x["found"].isNotNull()),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["found"].alias("found"), x["keep"].alias("keep")),
    )
    return F.when(text.rlike(PATTERNS[kind]), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,found:string,keep:boolean>>"))


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*[KINDS.index(n) for n in names])


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts (row, kind, start) whose complements lie in their scope within ``reach``."""
    near = parts.join(parts.filter(_kind(*WEAK)).select("row").distinct(), "row", "left_semi")
    line = W.partitionBy("row").orderBy("start")
    plain = _kind(*PLAIN)
    scoped = (
        near.withColumn("scope", F.sum(_kind("break").cast("int")).over(line))
        .withColumn("_before", F.max(F.when(plain, F.col("end"))).over(line))
        .withColumn("_after", F.min(F.when(plain, F.col("start"))).over(line.rangeBetween(W.currentRow, W.unboundedFollowing)))
        .filter(~_kind("break"))
    )
    overlaps = (F.coalesce("_before", F.lit(0)) > F.col("start")) | (F.coalesce("_after", F.col("end")) < F.col("end"))
    scoped = stage(scoped.filter(plain | ~overlaps).select("row", "kind", "start", "end", "scope"), "scoped")
    bin_of = lambda c: F.floor(F.col(c) / reach)
    role = F.when(_kind(*IDENTIFIERS), "identifier").when(_kind(*SECRETS), "secret")
    # a part offers its end to those after it and its start to those before it
    offers = scoped.withColumn("role", role).filter("role is not null").select(
        "row", "scope", "role",
        F.explode(F.array(F.struct(F.lit("ends").alias("side"), bin_of("end").alias("bin"), F.col("end").alias("place")),
                          F.struct(F.lit("starts").alias("side"), bin_of("start").alias("bin"), F.col("start").alias("place")))).alias("o"),
    ).select("row", "scope", "role", "o.*")
    roles = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*map(F.lit, v)))])
    asks = scoped.filter(_kind(*WEAK)).select("*", F.explode(roles[F.col("kind")]).alias("role")).select(
        "row", "scope", "kind", "start", "end", "role",
        F.explode(F.array(*[F.struct(F.lit(side).alias("side"), (bin_of(c) + step).alias("bin"))
                            for side, c, steps in (("ends", "start", (0, -1)), ("starts", "end", (0, 1))) for step in steps])).alias("a"),
    ).select("row", "scope", "kind", "start", "end", "role", "a.*")
    met = asks.alias("a").join(
        offers.alias("o"),
        F.expr(
            "a.row = o.row AND a.scope = o.scope AND a.role = o.role AND a.side = o.side AND a.bin = o.bin"
            f" AND CASE WHEN a.side = 'ends' THEN a.start - o.place BETWEEN 0 AND {reach} ELSE o.place - a.end BETWEEN 0 AND {reach} END"
        ),
        "left_semi",
    )
    needed = F.element_at(F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.lit(len(v)))]), F.col("kind"))
    return met.groupBy("row", "kind", "start").agg(F.count_distinct("role").alias("roles")).filter(F.col("roles") == needed).select("row", "kind", "start")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """All rows (row, id), and their reported parts (row, kind, start, end, found); ``kind`` indexes ``KINDS``.

    Places count code points, ``end`` is exclusive.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = stage(read.select("row", "id", F.concat(*[_matches(F.col("text"), k) for k in KINDS]).alias("found")), "matches")
    size = F.char_length("found")
    ended = F.sum(F.col("gap") + size).over(W.partitionBy("row", "kind").orderBy("i"))
    parts = rows.select("row", F.explode("found").alias("m")).select("row", "m.*").withColumn("end", ended).filter("keep")
    parts = stage(parts.select("row", "kind", (F.col("end") - size).alias("start"), "end", "found"), "parts")
    weak = parts.join(_linked(parts.drop("found"), reach), ["row", "kind", "start"], "left_semi")
    return rows.select("row", "id"), parts.filter(_kind(*PLAIN)).unionByName(weak)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: numbers of plain finds, digest of their spans, and all spans."""
    rows, parts = scan(docs.select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start"), F.col("end"))
    per = parts.groupBy("row").agg(
        *[F.sum(_kind(k).cast("long")).alias(f"n_{k}") for k in PLAIN],
        F.sort_array(F.collect_list(F.struct("start", "kind", span.alias("span")))).alias("all"),
    )
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    spans = F.coalesce(joined(F.col("all")), F.lit(""))
    base = F.coalesce(joined(F.filter("all", lambda x: x["kind"] < len(PLAIN))), F.lit(""))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in PLAIN]
    return rows.join(per, "row", "left").select(F.col("id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_parts() -> str:
    """A SELECT per kind: rows (r, kind, start, end) of its matches that are kept."""
    out = []
    for at, kind in enumerate(KINDS):
        pattern = PATTERNS[kind].replace("'", "''")
        keep = f"length(g) >= {LEAST_VALUE[kind]}" if kind in LEAST_VALUE else "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if kind == "opaque" else "true"
        out.append(
            f"SELECT r, kind, e - length(m) AS s, e FROM (SELECT r, {at} AS kind, i, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM"
            f" (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM"
            f" (SELECT r, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {2 if kind in LEAST_VALUE else 0}) AS gs, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))) WHERE {keep}"
        )
    return " UNION ALL ".join(out)


def _sql_met(role: str) -> str:
    kinds = ", ".join(str(KINDS.index(k)) for k in (IDENTIFIERS if role == "identifier" else SECRETS))
    return f"EXISTS (FROM sc y WHERE y.r = x.r AND y.scope = x.scope AND y.kind IN ({kinds}) AND (x.s - y.e BETWEEN 0 AND {REACH} OR y.s - x.e BETWEEN 0 AND {REACH}))"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 p AS MATERIALIZED ({_sql_parts()}),
 sc AS MATERIALIZED (SELECT *, (SELECT count(*) FROM p b WHERE b.r = x.r AND b.kind = 6 AND b.s < x.s) AS scope FROM p x WHERE kind < 6
   AND (kind < 3 OR NOT EXISTS (FROM p b WHERE b.r = x.r AND b.kind < 3 AND b.s < x.e AND x.s < b.e))),
 o AS (FROM sc x WHERE kind < 3 OR (kind = 3 AND {_sql_met("secret")}) OR (kind = 4 AND {_sql_met("identifier")})
   OR (kind = 5 AND {_sql_met("identifier")} AND {_sql_met("secret")})),
 n AS (SELECT *, (['assign', 'access', 'hex', 'account', 'opaque', 'endpoint'])[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM o)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN n USING (r) GROUP BY r
"""
